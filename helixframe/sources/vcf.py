"""VCF text, plain or gzip, to site tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources import bgzf, sinks

FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
# The categories of header lines, in the order they are written.
CATEGORIES = ("fileformat", "FILTER", "FORMAT", "INFO", "ALT", "contig", "other")


def header(spark: SparkSession, path: str) -> list[str]:
    """The lines that start with # at the head of a file, plain, gzip or BGZF; no more of the file is read."""
    jvm, p = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    if stream.read() == 0x1F:
        stream.seek(0)
        stream = jvm.java.util.zip.GZIPInputStream(stream)
    else:
        stream.seek(0)
    reader, lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")), []
    try:
        while (line := reader.readLine()) is not None and line.startswith("#"):
            lines.append(line)
    finally:
        reader.close()
    return lines


def samples(lines: list[str]) -> list[str]:
    return next(x for x in reversed(lines) if x.startswith("#CHROM")).split("\t")[9:]


def parse_header(lines: list[str], duplicates: str = "gentle") -> dict[str, dict[str, str]]:
    """{category: {id: line}}; a repeated id keeps the first line (gentle), the last (overwrite), or fails (throw)."""
    out: dict[str, dict[str, str]] = {c: {} for c in CATEGORIES}
    for n, line in enumerate(x for x in lines if x.startswith("##")):
        kind, _, rest = line[2:].partition("=")
        name = rest[rest.find("ID=") + 3 :].split(",")[0].rstrip(">") if rest.startswith("<") and "ID=" in rest else str(n)
        own = out[kind if kind in out else "other"]
        if name in own and duplicates == "throw":
            raise ValueError(f"header has {kind} {name} twice")
        if name not in own or duplicates == "overwrite":
            own[name] = line
    return out


def _field(key: str) -> Column:
    """Each sample's text of a FORMAT key, null where the key or the value is absent."""
    at = F.array_position(F.col("keys"), key).cast("int") - 1
    return F.transform("calls", lambda c: F.when(at >= 0, F.nullif(F.get(F.split(c, ":"), at), F.lit("."))))


def _gt(t: Column) -> Column:
    """A genotype's text as alleles (-1 missing) and whether it is phased."""
    both = F.split(F.coalesce(t, F.lit(".|.")), "[/|]")
    allele = lambda i: F.coalesce(F.get(both, F.lit(i)).try_cast("int"), F.lit(-1))
    return F.struct(allele(0).alias("a0"), allele(1).alias("a1"), F.coalesce(t.contains("|"), F.lit(True)).alias("phased"))


def _numbers(t: Column, kind: str) -> Column:
    return F.transform(F.split(t, ","), lambda x: x.try_cast(kind))


#: How a value of these FORMAT keys is read from a sample's text, and the column it is in.
READ = {
    "GT": ("gt", _gt),
    "DP": ("dp", lambda t: t.try_cast("int")),
    "AD": ("ad", lambda t: _numbers(t, "int")),
    "PL": ("pl", lambda t: _numbers(t, "double")),
}


def entries(text: Column, kind: str = "=") -> Column:
    """(key, value) of ``a=1;b;c=2`` in file order, repeated keys too; null values of flags."""
    parts = F.filter(F.split(F.coalesce(F.nullif(text, F.lit(".")), F.lit("")), ";"), lambda x: x != "")
    key = lambda x: F.substring_index(x, kind, 1)
    return F.transform(parts, lambda x: F.struct(key(x).alias("key"), F.when(x.contains(kind), x.substr(F.length(key(x)) + 2, F.length(x))).alias("value")))


def first_of_each(pairs: Column) -> Column:
    """A map of (key, value) entries; a repeated key keeps its first value."""
    keys = F.transform(pairs, lambda x: x["key"])
    return F.map_from_entries(F.filter(pairs, lambda x, i: F.array_position(keys, x["key"]) == i + 1))


def read_vcf(spark: SparkSession, paths: str | list[str], parts: int | None = None) -> DataFrame:
    """The site table of one or more files: file_ix, site_ord, chrom, pos, id, ref, alt, qual, filter, info, gt, dp, ad, pl, raw.

    Missing alleles are -1. A BGZF file is read in splits. A plain gzip file is one partition: give ``parts`` to
    spread its rows by position. Files whose samples differ are an error. ``raw`` has what a writer needs to give unchanged
    fields back as they were: the text of QUAL, INFO in file order, FORMAT keys and each sample's text.
    """
    paths = [paths] if isinstance(paths, str) else paths
    if len(paths) > 1:
        names = [samples(header(spark, p)) for p in paths]
        for p, own in zip(paths, names, strict=True):
            if own != names[0]:
                raise ValueError(f"{p} has other samples than {paths[0]}")
    frames = []
    for n, path in enumerate(paths):
        if bgzf.is_bgzf(spark, path):
            lines = bgzf.read_lines(spark, path).select(F.col("line").alias("value"), F.col("ord").alias("site_ord"))
        else:
            lines = spark.read.text(path).withColumn("site_ord", F.monotonically_increasing_id())
        frames.append(lines.withColumn("file_ix", F.lit(n)))
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    out = parse_lines(rows)
    return out.repartition(parts, "chrom", F.expr("pos div 1000000")) if parts else out


def parse_lines(rows: DataFrame) -> DataFrame:
    """Sites of (file_ix, site_ord, value) lines; header lines and blank ones go."""
    rows = rows.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    c = F.split("value", "\t")
    rows = rows.select("file_ix", "site_ord", *[F.get(c, F.lit(i)).alias(k) for i, k in enumerate(FIXED)], F.slice(c, 10, F.greatest(F.size(c), F.lit(1))).alias("calls"))
    rows = rows.withColumn("keys", F.split("format", ":")).withColumn("pairs", entries(F.col("info")))
    values = [F.transform(_field(key), read).alias(col) for key, (col, read) in READ.items()]
    return rows.select(
        "file_ix",
        "site_ord",
        "chrom",
        F.col("pos").cast("long").alias("pos"),
        F.nullif("id", F.lit(".")).alias("id"),
        "ref",
        F.when(F.col("alt") == ".", F.array().cast("array<string>")).otherwise(F.split("alt", ",")).alias("alt"),
        F.col("qual").try_cast("double").alias("qual"),
        F.nullif("filter", F.lit(".")).alias("filter"),
        first_of_each(F.col("pairs")).alias("info"),
        *values,
        F.struct(F.col("qual").alias("qual"), F.col("pairs").alias("info"), F.col("keys").alias("format"), "calls").alias("raw"),
    )


def _number(x: Column) -> Column:
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def _call_texts(sites: DataFrame) -> dict[str, tuple]:
    """{FORMAT key: (whether a site has it, its text for sample i)}, in the order of the keys."""
    allele = lambda a: F.when(a < 0, ".").otherwise(a.cast("string"))
    many = lambda c: lambda g, i: F.coalesce(F.array_join(F.transform(F.get(c, i), lambda x: F.coalesce(_number(x), F.lit("."))), ","), F.lit("."))
    out = {"GT": (F.lit(True), lambda g, i: F.concat(allele(g["a0"]), F.when(g["phased"], "|").otherwise("/"), allele(g["a1"])))}
    if "dp" in sites.columns:
        out["DP"] = (F.exists("dp", lambda x: x.isNotNull()), lambda g, i: F.coalesce(F.get("dp", i).cast("string"), F.lit(".")))
    for key, col in (("AD", "ad"), ("PL", "pl")):
        if col in sites.columns:
            out[key] = (F.exists(col, lambda x: x.isNotNull()), many(col))
    return {k: (F.coalesce(has, F.lit(False)), text) for k, (has, text) in out.items()}


def lines_of(sites: DataFrame, keep: tuple[str, ...] = ("file_ix", "site_ord")) -> DataFrame:
    """(keep, line): VCF lines with GT and those of DP, AD and PL that any sample of the site has.

    Where sites have ``raw``, all FORMAT keys are written, and fields whose values are still those of their text are written as that text.
    """
    parts, raw = _call_texts(sites), "raw" in sites.columns
    old = F.coalesce(F.col("raw.format"), F.array().cast("array<string>")) if raw else F.array().cast("array<string>")
    added = {k: (has & ~F.array_contains(old, k), text) for k, (has, text) in parts.items()}
    keys = F.concat_ws(":", old, *[F.when(has, F.lit(k)) for k, (has, _) in added.items()])

    def call(g: Column, i: Column) -> Column:
        fields = F.split(F.get(F.col("raw.calls"), i), ":") if raw else None

        def field(k: Column, j: Column) -> Column:
            was, out = F.get(fields, j), None
            for key, (_, text) in parts.items():
                col, read = READ[key]
                same = read(F.nullif(was, F.lit("."))).eqNullSafe(g if key == "GT" else F.get(col, i))
                value = F.when(same, was).otherwise(text(g, i))
                out = F.when(k == key, value) if out is None else out.when(k == key, value)
            return out.otherwise(was)

        own = [F.array_join(F.transform(old, field), ":")] if raw else []
        return F.concat_ws(":", *[F.nullif(x, F.lit("")) for x in own], *[F.when(has, text(g, i)) for has, text in added.values()])

    entry = lambda k, v: F.when(v.isNull(), k).otherwise(F.concat(k, F.lit("="), v))
    if raw:
        pairs, names = F.coalesce(F.col("raw.info"), F.array().cast("array<struct<key:string,value:string>>")), F.transform(F.col("raw.info"), lambda x: x["key"])
        first = lambda x, n: F.array_position(names, x["key"]) == n + 1
        # a key's first entry has the present value, later ones stay as they were
        value = lambda x, n: F.when(first(x, n), F.element_at("info", x["key"])).otherwise(x["value"])
        text = F.transform(pairs, lambda x, n: F.when(F.map_contains_key("info", x["key"]), entry(x["key"], value(x, n))))
        new = F.filter(F.array_sort(F.map_entries("info")), lambda e: ~F.coalesce(F.array_contains(names, e["key"]), F.lit(False)))
        info = F.array_join(F.concat(text, F.transform(new, lambda e: entry(e["key"], e["value"]))), ";")
        qual = F.when(F.col("raw.qual").try_cast("double").eqNullSafe(F.col("qual")), F.col("raw.qual")).otherwise(_number(F.col("qual")))
    else:
        info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: entry(e["key"], e["value"])), ";")
        qual = _number(F.col("qual"))
    dot = lambda c: F.coalesce(c, F.lit("."))
    alt = F.when(F.size("alt") > 0, F.array_join("alt", ",")).otherwise(".")
    calls = F.array_join(F.transform("gt", call), "\t")
    return sites.select(*keep, F.concat_ws("\t", "chrom", F.col("pos").cast("string"), dot(F.col("id")), "ref", alt, dot(qual), dot(F.col("filter")), dot(F.nullif(info, F.lit(""))), keys, calls).alias("line"))


def header_lines(head: dict[str, dict[str, str]], names: list[str]) -> list[str]:
    """Header lines by category, in the order they are written, and the line of columns."""
    columns = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])
    return [*(line for c in CATEGORIES for line in head.get(c, {}).values()), columns]


def check_samples(names: list[str], wanted: list[str]) -> list[int]:
    """The places of the wanted samples; a name that the file lacks is an error."""
    lacking = [n for n in wanted if n not in names]
    if lacking:
        raise ValueError(f"no samples {', '.join(lacking)}")
    return [names.index(n) for n in wanted]


def write_vcf(sites: DataFrame, head: list[str], path: str, order: tuple[str, ...] = ("file_ix", "site_ord")) -> None:
    """One file in record order, BGZF if its name ends in .gz, written by many tasks (``sinks``)."""
    sinks.write_lines(lines_of(sites, order), list(order), path, head)
