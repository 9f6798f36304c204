from pyspark.sql import functions as F

from helixframe.llm.exact_blocks import blocks, meet


def test_copies_of_what_is_asked_are_not_broadcast(spark, tmp_path):
    """The driver holds no copies of the blocks that are asked, however small their file is; each block meets each."""
    rows = spark.range(2_000).select(F.col("id").alias("vec_id"), F.lit(1).cast("long").alias("label"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("d"))
    blocks(rows, 100).write.parquet(f"{tmp_path}/data")
    data = spark.read.parquet(f"{tmp_path}/data")
    asked = data.select("dim", *[F.col(c).alias(f"q_{c}") for c in ("wide", "ids", "labels", "vecs")])
    met = meet(data, asked, 64)
    n = data.count()
    assert met.select(F.xxhash64("ids").alias("a"), F.xxhash64("q_ids").alias("b")).distinct().count() == met.count() == n * n
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
