"""Names, intervals and rates: expressions over text and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes of file names that are stripped.
SUFFIXES = (".gz", ".vcf", ".bcf", ".zarr", ".trees", ".samples", ".fa", ".fasta", ".bed", ".gff", ".txt", ".csv", ".tsv")


def interval(text: str) -> Column:
    """``chr:a-b`` as (chrom, start, end); null parts where the text has another form."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"^(.+):([0-9]+)-([0-9]+)$", i), F.lit(""))
    return F.struct(part(1).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"))


def intervals_of(spark, chosen: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """(chrom, start, end) of a dictionary of intervals."""
    return spark.createDataFrame([(c, a, b) for c, spans in chosen.items() for a, b in spans], "chrom string, start long, end long")


def strip_suffixes(name: str | Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The name without the known suffixes at its end, however many."""
    ends = "|".join(s.replace(".", "[.]") for s in suffixes)
    return F.regexp_replace(name, f"(?:{ends})+$", "")


def rename_clades(tree: str | Column, names: dict[str, str]) -> Column:
    """Listed pieces of a tree's text replaced one after another, in order."""
    out = F.col(tree) if isinstance(tree, str) else tree
    for old, new in names.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def adjusted_rate(rate: str | Column, missing: str | Column) -> Column:
    """The mutation rate over the share of sites that is there."""
    return (F.col(rate) if isinstance(rate, str) else rate) * (1 - (F.col(missing) if isinstance(missing, str) else missing))


def haplotype_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair): ``a-b`` for each haplotype (h) of two samples' lists, which are dimensions."""
    return left.select(F.col("h").alias("a")).crossJoin(F.broadcast(right.select(F.col("h").alias("b")))).select(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("pair"))


def grid(groups: DataFrame, k: int) -> DataFrame:
    """(i0, ..., i{k-1}): all k-tuples of a dimension's indices (ix), repeated ones included."""
    out = groups.select(F.col("ix").alias("i0"))
    for n in range(1, k):
        out = out.crossJoin(F.broadcast(groups.select(F.col("ix").alias(f"i{n}"))))
    return out


def haplotypes_in_turn(gt: str = "gt") -> Column:
    """All first alleles of the samples, then all second ones."""
    return F.concat(F.transform(gt, lambda g: g["a0"]), F.transform(gt, lambda g: g["a1"]))


def is_null_call(g: Column) -> Column:
    """Whether a call's first allele is missing."""
    return g["a0"] < 0


def first_differs(one: Column, two: Column) -> Column:
    """Whether two calls differ in their first allele."""
    return one["a0"] != two["a0"]
