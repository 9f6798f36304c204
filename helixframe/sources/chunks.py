"""Sites cut into files of a fixed length of a chromosome, and the header lines of such files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources.vcf import read_vcf

# Arms of the three chromosomes in bp, and the rate of mutation, from the literature.
LEFT_ARMS = ((0, 150_000_000), (0, 227_000_000), (0, 196_000_000))
RIGHT_ARMS = ((154_000_000, 310_827_022), (232_000_000, 474_425_716), (201_000_000, 409_777_670))
MUTATION_RATE = 4.85e-09


def chunk_names(spans: DataFrame, width: int, prefix: str = "", postfix: str = "") -> DataFrame:
    """``spans`` (chrom, start, end, length) with ``chunk`` and ``name`` (prefix chrom:first-last postfix) of each file that
    holds a part of the span; the last file ends with the chromosome. Positions count from 1."""
    s = spans.withColumn("chunk", F.explode(F.expr(f"sequence((start - 1) div {width}, (end - 1) div {width})")))
    first, last = F.col("chunk") * width + 1, F.least((F.col("chunk") + 1) * width, F.col("length"))
    return s.withColumn("name", F.concat(F.lit(prefix), "chrom", F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(postfix)))


def read_range(spark: SparkSession, folder: str, chrom: str, start: int, end: int, length: int, width: int = 10_000_000, prefix: str = "", postfix: str = "", suffix: str = ".vcf.gz", colon: str = "_") -> DataFrame:
    """Sites start..end of a chromosome, read from the chunk files that cover them and no others, in order.

    ``colon`` stands for the colon of ``chunk_names``: Hadoop paths cannot hold one, so files are renamed before.
    """
    ks = range((start - 1) // width, (min(end, length) - 1) // width + 1)
    paths = [f"{folder}/{prefix}{chrom}{colon}{k * width + 1}-{min((k + 1) * width, length)}{postfix}{suffix}" for k in ks]
    return read_vcf(spark, paths).where((F.col("chrom") == chrom) & F.col("pos").between(start, end))


def gather(spark: SparkSession, folder: str, chrom: str, length: int, width: int = 10_000_000, prefix: str = "", postfix: str = "", colon: str = "_") -> DataFrame:
    """All chunk files of a chromosome, in order."""
    return read_range(spark, folder, chrom, 1, length, length, width, prefix, postfix, colon=colon)


def region(spark: SparkSession, path: str, text: str) -> DataFrame:
    """Sites of ``chr`` or ``chr:a-b`` in a table that was written by chromosome and bin (``write_binned``): other bins are not read."""
    chrom, _, span = text.rpartition(":") if ":" in text else (text, "", "")
    s = spark.read.parquet(path).where(F.col("chrom") == chrom)
    if span:
        width = spark.read.parquet(path).select("bin_width").first()[0]  # one number
        a, b = (int(x) for x in span.split("-"))
        s = s.where(F.col("bin").between((a - 1) // width, (b - 1) // width) & F.col("pos").between(a, b))
    return s.drop("bin", "bin_width")


def write_binned(sites: DataFrame, path: str, width: int = 10_000_000) -> None:
    """Parquet in folders by chromosome and position bin; each bin is written by one task."""
    s = sites.withColumn("bin_width", F.lit(width)).withColumn("bin", F.expr(f"(pos - 1) div {width}"))
    s.repartition("chrom", "bin").sortWithinPartitions("chrom", "bin", "pos").write.mode("overwrite").partitionBy("chrom", "bin").parquet(path)


def _kept(line: Column, kind: str, wanted: str | None) -> Column:
    return F.lit(True) if wanted is None else ~line.startswith(f"##{kind}") | line.startswith(f"##{kind}=<ID={wanted}")


def strip_header(lines: DataFrame, chrom: str | None = None, info: str | None = None) -> DataFrame:
    """Lines (line) without the contig lines of other chromosomes and the INFO lines of other fields; a name is what an ID begins with."""
    line = F.col("line")
    return lines.where(_kept(line, "contig", chrom) & _kept(line, "INFO", info))


def reheader(lines: DataFrame, template: DataFrame, contigs: str | None = "NC") -> DataFrame:
    """(part, ord, line): the template's ## lines, contigs only where the ID begins so, then the lines from #CHROM on (ord, line)."""
    line = F.col("line")
    head = template.where(line.startswith("##") & _kept(line, "contig", contigs)).select(F.lit(0).alias("part"), "ord", "line")
    return head.unionByName(lines.where(~line.startswith("##")).select(F.lit(1).alias("part"), "ord", "line"))


def arm(chrom: int, which: str = "left", rounding: int = 1_000_000) -> tuple[int, int]:
    """(start, end) of a chromosome's arm or centromere (chromosomes count from 0); starts are rounded up, ends down."""
    spans = {"left": LEFT_ARMS[chrom], "right": RIGHT_ARMS[chrom], "centromere": (LEFT_ARMS[chrom][1], RIGHT_ARMS[chrom][0])}
    if which not in spans:
        raise ValueError(f"arm {which} is none of left, right, centromere")
    a, b = spans[which]
    a, b = -(-a // rounding) * rounding, b // rounding * rounding
    if a >= b:
        raise ValueError(f"rounding {rounding} leaves nothing of the arm")
    return a, b
