"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.session import shared_dir

#: ``[^\x20\x09-\x0D]+``, the words of the contracts, as Java's regex reads it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by any path Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared checkpoint folder and read again.

    Each one cuts the lineage at files every executor can read, so a lost
    executor costs only the tasks that were running on it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, **options: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of ``keep`` that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def join_small(big: DataFrame, small: DataFrame, on: str | list[str], how: str, rows: int, most: int = 500_000, hashed: bool = False) -> DataFrame:
    """Join with a side whose row count has been measured: broadcast up to ``most``, else shuffled. With ``hashed``, for
    a small side of few rows a key, it is hashed then, and the large side's rows are not sorted."""
    if rows > most and hashed:
        return big.join(small.hint("shuffle_hash"), on, how)
    return big.join(F.broadcast(small) if rows <= most else small, on, how)


def crc_of_id(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string"))
