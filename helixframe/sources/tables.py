"""Readers of interval, map, matrix and sequence files, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.operators.newick import leaves  # noqa: F401
from helixframe.sources.vcf import entries, first_of_each


def _cut(spark: SparkSession, path: str, sep: str, *skip: str) -> DataFrame:
    rows = spark.read.text(path).where(F.trim("value") != "")
    for s in skip:
        rows = rows.where(~F.col("value").startswith(s))
    return rows.select("value", F.split(F.trim("value") if sep == r"\s+" else "value", sep).alias("c"))


def _at(i: int):
    return F.get("c", F.lit(i))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """seqid, source, type, start, end (1-based inclusive), score, strand, phase, attributes (map)."""
    c = _cut(spark, path, "\t", "#").where(F.size("c") >= 5)
    return c.select(_at(0).alias("seqid"), _at(1).alias("source"), _at(2).alias("type"), _at(3).cast("long").alias("start"), _at(4).cast("long").alias("end"), _at(5).alias("score"), _at(6).alias("strand"), _at(7).alias("phase"), first_of_each(entries(F.trim(_at(8)))).alias("attributes"))


def gff_mask(spark: SparkSession, path: str, source: str | None = "RepeatMasker", types: list[str] | None = None, seqids: list[str] | None = None) -> DataFrame:
    g = read_gff(spark, path)
    for col, want in (("source", [source] if source else None), ("type", types), ("seqid", seqids)):
        g = g.where(F.col(col).isin(want)) if want else g
    return g.select(F.col("seqid").alias("chrom"), "start", "end")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, made 1-based inclusive."""
    c = _cut(spark, path, "\t", "#", "track", "browser")
    return c.select(_at(0).alias("chrom"), (_at(1).cast("long") + 1).alias("start"), _at(2).cast("long").alias("end"))


def bed_lines(mask: DataFrame) -> DataFrame:
    return mask.orderBy("chrom", "start").select(F.concat_ws("\t", "chrom", (F.col("start") - 1).cast("string"), F.col("end").cast("string")).alias("line"))


def read_repeatmasker(spark: SparkSession, path: str) -> DataFrame:
    c = _cut(spark, path, r"\s+").where(_at(0).rlike(r"^\d+$"))
    return c.select(_at(4).alias("chrom"), _at(5).cast("long").alias("start"), _at(6).cast("long").alias("end"))


def read_popfile(spark: SparkSession, path: str) -> DataFrame:
    return _cut(spark, path, "\t").select(_at(0).alias("sample"), _at(1).alias("pop"))


def read_list(spark: SparkSession, path: str, number: bool = False) -> DataFrame:
    """Values of a one-a-line file; numbers are distinct, names get _ for -."""
    c = _cut(spark, path, "\n", "#").select(F.trim("value").alias("value"))
    return c.select(F.col("value").cast("long").alias("value")).distinct() if number else c.select(F.replace("value", F.lit("-"), F.lit("_")).alias("value"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """set, chrom, marker, phys, gen up to the first line that is malformed."""
    c = _cut(spark, path, r"\s+").withColumn("n", F.monotonically_increasing_id())
    c = c.withColumn("ok", (F.size("c") >= 5) & _at(3).try_cast("long").isNotNull() & _at(4).try_cast("double").isNotNull())
    rows = c.where((F.col("n") > 0) | F.col("ok"))  # a line of names may stand first
    bad = rows.where("not ok").agg(F.min("n").alias("bad"))
    rows = rows.crossJoin(F.broadcast(bad)).where("bad is null or n < bad")
    return rows.select(_at(0).alias("set"), _at(1).alias("chrom"), _at(2).alias("marker"), _at(3).cast("long").alias("phys"), _at(4).cast("double").alias("gen"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, values): numbers split by blanks, rows in file order."""
    c = _cut(spark, path, r"\s+").withColumn("n", F.monotonically_increasing_id())
    row = F.row_number().over(Window.orderBy("n")) - 1  # a matrix of a cohort's samples
    return c.select(row.alias("row"), F.transform("c", lambda x: x.cast("double")).alias("values"))


def read_msmc(spark: SparkSession, path: str) -> DataFrame:
    c = _cut(spark, path, r"\s+").where(_at(0).try_cast("int").isNotNull())
    return c.select(_at(0).cast("int").alias("t_ix"), _at(1).cast("double").alias("t_left"), F.when(_at(2) == "inf", float("inf")).otherwise(_at(2).try_cast("double")).alias("t_right"), F.transform(F.slice("c", 4, F.size("c")), lambda x: x.cast("double")).alias("lambdas"))


def read_fasta(spark: SparkSession, path: str, chunk: int = 10_000) -> DataFrame:
    """(contig, chunk, seq): sequence in upper case, cut into chunks; a base is found by contig and (pos - 1) div chunk."""
    rows = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    name = F.regexp_extract("value", r"^(\S+)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    whole = rows.select(name.alias("contig"), seq.alias("seq"))
    return whole.select("contig", "seq", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(length(seq) - 1) div {chunk}")))).alias("chunk")).select("contig", F.col("chunk").cast("long").alias("chunk"), F.substring(F.col("seq"), F.col("chunk").cast("int") * chunk + 1, F.lit(chunk)).alias("seq"))


def base_at(sites: DataFrame, fasta: DataFrame, name: str, chunk: int = 10_000) -> DataFrame:
    """``sites`` with the base at their position, null outside the sequence."""
    s = sites.withColumn("__chunk", F.expr(f"(pos - 1) div {chunk}"))
    f = fasta.select(F.col("contig").alias("chrom"), F.col("chunk").alias("__chunk"), F.col("seq").alias("__seq"))
    base = F.nullif(F.substring(F.col("__seq"), ((F.col("pos") - 1) % chunk + 1).cast("int"), F.lit(1)), F.lit(""))
    return s.join(f, ["chrom", "__chunk"], "left").withColumn(name, base).drop("__chunk", "__seq")


# The columns of TreeMix files, in order.
EDGES = "pnode long, cnode long, length double, weight double, mig string, mstart string, blank string"
VERTICES = "id long, label string, root string, mig string, tip string, pid long, c1id long, nc1 long, c2id long, nc2 long, subtree string"


def read_treemix(spark: SparkSession, edges: str, vertices: str) -> tuple[DataFrame, DataFrame]:
    """TreeMix edges and vertices, plain or gzip; NA is null."""
    read = lambda path, schema: spark.read.csv(path, schema=schema, sep=" ", nullValue="NA")
    return read(edges, EDGES), read(vertices, VERTICES)


def migrations(rows: DataFrame) -> DataFrame:
    """The migration edges or vertices."""
    return rows.where("mig = 'MIG'")


def read_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """(site, p): P(major is ancestral) of EST-SFS output by the site's number; lines that start with 0 are comments."""
    c = _cut(spark, path, r"\s+", "0").where(F.size("c") >= 3)
    return c.select(_at(0).try_cast("long").alias("site"), _at(2).try_cast("double").alias("p"))


def read_states(spark: SparkSession, path: str, node: str = "Node1") -> DataFrame:
    """(site, base): IQ-TREE states of one node."""
    c = _cut(spark, path, "\t").where(_at(0) == node)
    return c.select(_at(1).cast("long").alias("site"), _at(2).alias("base"))


def gene_rows(gff: DataFrame, gene: str, order: str = "n") -> DataFrame:
    """Rows of a gene, from the first ``gene`` row that names it on: those whose attribute ``gene`` is its name, quoted or not."""
    own = gff.where(F.regexp_replace(F.col("attributes")["gene"], "^(['\"])(.*)\\1$", "$2") == gene)
    first = own.where("type = 'gene'").agg(F.min(order).alias("__first"))
    return own.join(F.broadcast(first), F.col(order) >= F.col("__first")).drop("__first")  # one number


def without_contigs(fasta: DataFrame, names: list[str]) -> DataFrame:
    return fasta.where(~F.col("contig").isin(names))


def extract_region(fasta: DataFrame, contig: str, start: int, end: int, chunk: int = 10_000) -> DataFrame:
    """(chunk, seq): bases start..end, 1-based inclusive, of a contig's chunks."""
    first = F.col("chunk") * chunk
    lo, hi = F.greatest(F.lit(start) - first, F.lit(1)), F.least(F.lit(end) - first, F.lit(chunk))
    part = fasta.where((F.col("contig") == contig) & F.col("chunk").between((start - 1) // chunk, (end - 1) // chunk))
    return part.select("chunk", F.substring(F.col("seq"), lo.cast("int"), (hi - lo + 1).cast("int")).alias("seq"))


def fasta_lines(fasta: DataFrame, width: int = 40, chunk: int = 10_000) -> DataFrame:
    """(contig, ord, line): a name, then the sequence in lines of ``width`` bases; a chunk holds a whole number of lines."""
    if chunk % width:
        raise ValueError(f"chunks of {chunk} bases are no whole number of lines of {width}")
    rows = F.expr(f"transform(sequence(0, (length(seq) - 1) div {width}), i -> struct(chunk * {chunk // width} + i + 1 as ord, substring(seq, int(i * {width} + 1), {width}) as line))")
    body = fasta.where(F.length("seq") > 0).select("contig", F.explode(rows).alias("x")).select("contig", "x.ord", "x.line")
    return fasta.select("contig").distinct().select("contig", F.lit(0).cast("long").alias("ord"), F.concat(F.lit(">"), "contig").alias("line")).unionByName(body)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files under a folder, at any depth, whose name fits the pattern; no file is read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return r.load(folder).select("path", "length")
