"""Counts over site tables, lists of sites, and genotype classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.sites import filter_outgroup


def calls_of(index: list[int] | None = None, gt: str = "gt") -> Column:
    """How many alleles 0 or 1 the samples at these places have (all of them without)."""
    own = F.col(gt) if index is None else F.transform(F.array(*[F.lit(i) for i in index]), lambda i: F.get(gt, i))
    return F.aggregate(own, F.lit(0), lambda n, g: n + g["a0"].isin(0, 1).cast("int") + g["a1"].isin(0, 1).cast("int"))


def outgroup_missing(sites: DataFrame, outgroup: list[int]) -> DataFrame:
    """One row: sites without any call of the outgroup, all sites, and the share."""
    out = sites.agg(F.count_if(calls_of(outgroup) == 0).alias("missing"), F.count("*").alias("sites"))
    return out.withColumn("frac", F.try_divide(F.col("missing").cast("double"), F.col("sites").cast("double")))


def mean_called(sites: DataFrame, ingroup: list[int]) -> DataFrame:
    """One row: the mean number of alleles called in the ingroup, over sites with any."""
    n = calls_of(ingroup)
    return sites.where(n > 0).agg(F.avg(n).alias("mean_called"), F.count("*").alias("sites"))


def site_density(sites: DataFrame) -> DataFrame:
    """For each chromosome: sites, first and last position, and sites for each base between them."""
    out = sites.groupBy("chrom").agg(F.count("*").alias("sites"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return out.withColumn("density", F.try_divide(F.col("sites").cast("double"), (F.col("last") - F.col("first")).cast("double")))


def genotype_classes(sites: DataFrame, chrom: str, pos: int, least: int = 3) -> DataFrame:
    """(sample_ix, factor, kind) at one position: the sum of a call's codes, -2 below ``least`` reads; kind is low, wt, het, hom or bad."""
    e = sites.where((F.col("chrom") == chrom) & (F.col("pos") == pos)).select(F.posexplode(F.arrays_zip("gt", "dp")).alias("sample_ix", "z"))
    total, low = F.col("z.gt.a0") + F.col("z.gt.a1"), F.coalesce(F.col("z.dp"), F.lit(0)) < least
    kind = F.when(low, "low").when(total == 0, "wt").when(total == 1, "het").when(total == 2, "hom").otherwise("bad")
    return e.select("sample_ix", F.when(low, -2).otherwise(total).alias("factor"), kind.alias("kind"))


def listed_sites(sites: DataFrame, wanted: DataFrame, file: str = "file_ix") -> DataFrame:
    """The sites at the listed positions (chrom, pos), each from the first file that has it."""
    w = Window.partitionBy("chrom", "pos").orderBy(file)
    s = sites.join(wanted.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")
    return s.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def with_template_outgroup(sites: DataFrame, template: DataFrame, outgroup: list[int]) -> DataFrame:
    """The sites whose position has outgroup calls in another table."""
    return sites.join(filter_outgroup(template, outgroup).select("chrom", "pos"), ["chrom", "pos"], "left_semi")
