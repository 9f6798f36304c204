"""Registered queries that go through files: a cohort written as one BGZF VCF by many tasks and read back in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import site as S
from helixframe.plans.catalog import query
from helixframe.session import Kept
from helixframe.sources import bgzf
from helixframe.sources import vcf as V

HEAD = ["##fileformat=VCFv4.2", '##INFO=<ID=AC,Number=1,Type=Integer,Description="calls of the first ALT">']


def as_file(s: DataFrame, spark: SparkSession) -> Kept:
    """The cohort in order of position as ``cohort.vcf.gz`` in a folder of its own."""
    kept = Kept(spark, "cohort")
    counts = S.counts()
    total = F.aggregate("dp", F.lit(0).cast("long"), lambda a, x: a + x)
    info = F.create_map(F.lit("AC"), F.get(counts, F.lit(1)).cast("string"), F.lit("SITE"), F.lit(None).cast("string"))
    rows = s.select("site_id", "chrom", "pos", F.concat(F.lit("p"), F.col("site_id").cast("string")).alias("id"), "ref", "alt", (total / 4).alias("qual"), F.lit("PASS").alias("filter"), info.alias("info"), "gt", "dp")
    columns = V.header_lines(V.parse_header(HEAD), [f"S{k}" for k in range(25)])
    V.write_vcf(rows, columns, f"{kept.root}/cohort.vcf.gz", ("chrom", "pos", "site_id"))
    return kept


@query("vcf_round_trip", "select site_id, chrom, pos, n0, n1, n2, dp, cast(dp as double) / 4 as qual, n1 as ac, 2 as fields from sa")
def _(s, spark, _):
    back = V.read_vcf(spark, f"{as_file(s, spark).root}/cohort.vcf.gz")
    n = lambda k: F.get(S.counts(), F.lit(k)).cast("long").alias(f"n{k}")
    total = F.aggregate("dp", F.lit(0).cast("long"), lambda a, x: a + x)
    return back.select(F.substring("id", 2, 20).cast("long").alias("site_id"), "chrom", "pos", n(0), n(1), n(2), total.alias("dp"), "qual", F.col("info")["AC"].cast("long").alias("ac"), F.size("info").alias("fields"))


@query("vcf_region", "select site_id, pos, dp from sa where chrom = 'c2' and pos between 501 and 2500")
def _(s, spark, _):
    root = as_file(s, spark).root
    bgzf.write_index(spark, f"{root}/cohort.vcf.gz", f"{root}/index")
    lines = bgzf.region_lines(spark, f"{root}/index", "c2", 501, 2500)
    sites = V.parse_lines(lines.select(F.lit(0).alias("file_ix"), F.col("ord").alias("site_ord"), F.col("line").alias("value")))
    return sites.select(F.substring("id", 2, 20).cast("long").alias("site_id"), "pos", F.aggregate("dp", F.lit(0).cast("long"), lambda a, x: a + x).alias("dp"))


@query("vcf_order", "select n, site_id from (select site_id, cast(row_number() over (order by chrom, pos, site_id) as bigint) as n from sa) where n % 3 = 0")
def _(s, spark, _):
    """Every third record by its place in the file: the order that virtual offsets give."""
    back = V.read_vcf(spark, f"{as_file(s, spark).root}/cohort.vcf.gz").select("site_ord", "id")
    kept = Kept(spark, "order")
    rows = kept.keep(back.orderBy("site_ord").select(F.monotonically_increasing_id().alias("m"), "id")).withColumn("part", F.shiftright("m", 33))
    # partitions are few: a row each
    before = rows.groupBy("part").agg(F.count("*").alias("k")).selectExpr("part", "coalesce(sum(k) over (order by part rows between unbounded preceding and 1 preceding), 0) as before")
    placed = rows.join(F.broadcast(before), "part").selectExpr("before + row_number() over (partition by part order by m) as n", "cast(substring(id, 2) as bigint) as site_id")
    return placed.where("n % 3 = 0")
