"""Window depths over a stream of site files: the batch operator on each batch of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixframe.functions import site as S


def depth_by_window(sites: DataFrame, width: int, most_missing: float = 0.5) -> DataFrame:
    """The running sums of ``window_depth`` over a streaming site table."""
    s = sites.where(S.missing_frac() <= most_missing).select("chrom", F.expr(f"(pos - 1) div {width}").alias("win"), F.posexplode("dp").alias("sample_ix", "d"))
    return s.groupBy("chrom", "win", "sample_ix").agg(F.sum(F.greatest("d", F.lit(0))).cast("long").alias("depth_sum"), F.count("*").alias("sites"))


def start(windows: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return windows.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
