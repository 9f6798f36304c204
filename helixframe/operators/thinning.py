"""Thinning by random jumps, in parallel.

From a record a jump is drawn; the first record beyond it is kept, and the walk goes on at the record after that.
A record's jump depends on itself alone, so the record where the walk would go on is known for all of them at once.
The walk is then marked in three steps: in each bin, where a walk that stands at a record leaves the bin; over bins, by pointer
doubling over the few records where walks enter bins; and in each bin again, from the one record where the walk enters it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators import binned as B
from helixframe.session import Kept


def unit(seed: int, *columns: str) -> Column:
    """A number in (0, 1) that a row always has: from the first 32 bits of the md5 of ``seed:column:...``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") + 0.5) / 2.0**32


def jump(mean: float, least: float, most: float, seed: int, *columns: str) -> Column:
    """An exponential distance of this mean, within [least, most]."""
    return F.greatest(F.least(-F.log(unit(seed, *columns)) * mean, F.lit(float(most))), F.lit(float(least)))


def _leave(rows: pd.DataFrame) -> pd.DataFrame:
    """Of records n of a bin with the record where the walk goes on: the first one outside the bin."""
    rows = rows.sort_values("n")
    first, to = int(rows["n"].iloc[0]), rows["to"].to_numpy().copy()
    end = first + len(to)
    for i in range(len(to) - 1, -1, -1):
        if to[i] < end:
            to[i] = to[to[i] - first]
    return pd.DataFrame({"chrom": rows["chrom"], "n": rows["n"], "to": to})


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Records that are kept from a bin's entry on: ``kept`` of each record that the walk stands at."""
    rows = rows.sort_values("n")
    first, to, kept = int(rows["n"].iloc[0]), rows["to"].to_numpy(), rows["kept"].to_numpy()
    at, out = int(rows["n"][rows["entry"]].iloc[0]), []
    while at < first + len(to):
        out.append(kept[at - first])
        at = int(to[at - first])
    return pd.DataFrame({"chrom": rows["chrom"].iloc[0], "n": np.array(out, np.int64)})


def thin_exponential(sites: DataFrame, mean: float, least: float, most: float, seed: int = 0, order: tuple[str, ...] = (), width: int = B.WIDTH) -> DataFrame:
    """Sites kept by jumps of an exponential distance within [least, most], from a chromosome's first site on.

    ``order`` tells records of one position apart; a record's draw depends on ``seed``, chromosome, position and these.
    """
    spark = sites.sparkSession
    keys = ["chrom", "pos", *order]
    kept = Kept(spark, "thin")
    # records alike in all keys are told apart by nothing, so they stay or go together
    slim = sites.select(*keys).where("chrom is not null and pos is not null").distinct()
    s = kept.keep(B.numbered(slim, ["pos", *order], width, "n").withColumn("goal", F.col("pos") - 1 + jump(mean, least, most, seed, *keys)))
    last = s.groupBy("chrom", "pos").agg(F.max("n").alias("below"))
    rows = s.select("chrom", F.floor("goal").alias("pos"), "n", F.col("pos").alias("at"))
    # the first record beyond the goal follows all records up to it
    rows = B.as_of(rows, last, "below", width).withColumn("kept", F.greatest(F.col("n"), F.coalesce("below", F.lit(0)) + 1))
    rows = kept.keep(rows.select("chrom", F.expr(f"at div {width}").alias("bin"), "n", "kept", (F.col("kept") + 1).alias("to")))
    leave = kept.keep(rows.groupBy("chrom", "bin").applyInPandas(_leave, "chrom string, n long, to long"))
    # where walks enter bins: the first record of a chromosome, and all records where a bin is left to
    entries = leave.select("chrom", F.col("to").alias("n")).union(leave.groupBy("chrom").agg(F.min("n").alias("n"))).distinct()
    step = kept.keep(entries.join(leave, ["chrom", "n"]))
    marked = kept.keep(step.groupBy("chrom").agg(F.min("n").alias("n")))
    while True:
        more = marked.join(step, ["chrom", "n"]).select("chrom", F.col("to").alias("n"))
        grown = kept.keep(marked.union(more).distinct())
        nxt = step.select("chrom", F.col("n").alias("to"), F.col("to").alias("__to"))
        step = kept.keep(step.join(nxt, ["chrom", "to"]).select("chrom", "n", F.col("__to").alias("to")))
        marked = grown
        if not step.limit(1).count():
            break
    entry = marked.withColumn("entry", F.lit(True))
    stood = rows.join(entry, ["chrom", "n"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    visited = marked.join(rows.select("chrom", "n", "bin"), ["chrom", "n"]).select("chrom", "bin").distinct()
    chosen = stood.join(visited, ["chrom", "bin"]).groupBy("chrom", "bin").applyInPandas(_walk, "chrom string, n long")
    return sites.join(s.join(chosen, ["chrom", "n"], "left_semi").select(*keys), keys, "left_semi")


def walk(rows: Iterator[tuple[str, int, float]]) -> Iterator[int]:
    """The same one record after another: places of the records (chrom, pos, goal) that are kept."""
    chrom = goal = None
    for k, (c, pos, own) in enumerate(rows):
        if c != chrom:
            chrom, goal = c, None
        goal = own if goal is None else goal
        if pos > goal:
            yield k
            goal = None
