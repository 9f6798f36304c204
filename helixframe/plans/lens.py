"""A cohort seen in the star schema: parts are sites, supplier nations samples, regions populations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = """
lens_sites as (
  select p_partkey as site_id, concat('c', cast(p_partkey % 3 + 1 as varchar(8))) as chrom,
    cast((p_partkey - p_partkey % 3) / 3 as bigint) * 5 + p_size % 5 + 1 as pos, cast(p_size % 25 as bigint) as af25 from part),
lens_calls as (
  select l_partkey as site_id, cast(s_nationkey as bigint) as sample_ix, cast(sum(l_quantity) as bigint) as dp,
    cast(sum(l_orderkey) as bigint) as h1, cast(sum(l_orderkey + 7 * l_suppkey + l_linenumber) as bigint) as h2
  from lineitem join supplier on l_suppkey = s_suppkey group by l_partkey, s_nationkey),
lens_geno as (
  select s.site_id, chrom, pos, n_nationkey as sample_ix, n_regionkey as pop,
    case when c.site_id is null or dp % 17 = 0 then -1 when h1 % 211 = 0 then 2 when h1 % 50 < af25 then 1 else 0 end as a1,
    case when c.site_id is null or dp % 17 = 0 then -1 when h2 % 50 < af25 then 1 else 0 end as a2, coalesce(dp, 0) as dp
  from lens_sites s cross join nation n left join lens_calls c on c.site_id = s.site_id and c.sample_ix = n.n_nationkey),
st as (
  select site_id, any_value(chrom) as chrom, any_value(pos) as pos,
    count(*) filter (a1 = 0) + count(*) filter (a2 = 0) as n0, count(*) filter (a1 = 1) + count(*) filter (a2 = 1) as n1,
    count(*) filter (a1 = 2) + count(*) filter (a2 = 2) as n2, count(*) as ns, cast(sum(dp) as bigint) as dp,
    count(*) filter (dp < 3) as low3, count(*) filter (dp > 3) as over3, count(*) filter (a1 < 0 or a2 < 0) as smiss from lens_geno group by site_id),
sa as (
  select *, n0 + n1 + n2 as an, (n0 > 0)::int + (n1 > 0)::int + (n2 > 0)::int as alc,
    case when n0 = 0 and n1 = 0 and n2 = 0 then null when n0 >= n1 and n0 >= n2 then 0 when n1 >= n2 then 1 else 2 end as maj from st)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a site and sample: (site_id, chrom, pos, sample_ix, pop, a1, a2, dp)."""
    line = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    got = line.groupBy(F.col("l_partkey").alias("site_id"), F.col("s_nationkey").alias("sample_ix")).agg(F.sum("l_quantity").cast("long").alias("dp"), F.sum("l_orderkey").alias("h1"), F.sum(F.col("l_orderkey") + 7 * F.col("l_suppkey") + F.col("l_linenumber")).alias("h2"))
    key = F.col("p_partkey")
    sites = read(spark, sf_dir, "part").select(key.alias("site_id"), F.concat(F.lit("c"), (key % 3 + 1).cast("string")).alias("chrom"), (F.expr("p_partkey div 3") * 5 + F.col("p_size") % 5 + 1).alias("pos"), (F.col("p_size") % 25).alias("af"))
    samples = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sample_ix"), F.col("n_regionkey").alias("pop"))
    # nations: a fixed dimension of 25 rows
    full = sites.crossJoin(F.broadcast(samples)).join(got, ["site_id", "sample_ix"], "left")
    out = F.col("h1").isNull() | (F.col("dp") % 17 == 0)
    one = F.when(out, -1).when(F.col("h1") % 211 == 0, 2).when(F.col("h1") % 50 < F.col("af"), 1).otherwise(0)
    two = F.when(out, -1).when(F.col("h2") % 50 < F.col("af"), 1).otherwise(0)
    return full.select("site_id", "chrom", "pos", "sample_ix", "pop", one.alias("a1"), two.alias("a2"), F.coalesce("dp", F.lit(0)).cast("long").alias("dp"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a site, in the schema of the readers: arrays in the order of samples, ref A, alt C and G."""
    row = F.struct("sample_ix", F.struct(F.col("a1").alias("a0"), F.col("a2").alias("a1"), F.lit(True).alias("phased")).alias("g"), F.col("dp").cast("int").alias("d"))
    out = calls(spark, sf_dir).groupBy("site_id", "chrom", "pos").agg(F.array_sort(F.collect_list(row)).alias("s"))
    return out.select("site_id", "chrom", "pos", F.lit("A").alias("ref"), F.array(F.lit("C"), F.lit("G")).alias("alt"), F.col("s.g").alias("gt"), F.col("s.d").alias("dp"))
