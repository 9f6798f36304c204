"""Hard negatives: rows of another label that score just below an anchor's positives.

Every anchor is scored against every row, in blocks, and each block's scores are
sorted whole, from high to low with ties by smaller id. First the anchor's
positives are read off: the first rows of its own label, of each block and then of
all. Then, block by block, the place where each positive's upper limit falls is found by
binary search in the sorted scores, and the first ``k`` rows of another label from
there to the lower limit are read; the first ``k`` of all blocks are the
result. Anchors are a stated query set; a task holds one block of anchors and one of rows.

Scores are exact integers of any size; in the result, one beyond 64 bits is the nearest long.
Limits are whole-number comparisons: ``low * positive <= 100 * negative <= high * positive``. A
positive below zero has limits that no score meets.

Edge cases: rows with a null id, label or vector, or a null or non-finite component, take no part; rows that
repeat an id are one (of different ones the smallest label, then vector, counts); vectors of
other lengths than the anchor's are neither its positives nor its negatives; rows without components all score 0; anchors without
positives, positives without negatives and empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch
from helixframe.llm.exact_blocks import as_long, best_first, blocks, meet, order_key, scores, sound_rows, unpack

FOUND = "anchor_id long, vec_id long, score string, ordered string"
MINED = "anchor_id long, positive_id long, positive_score string, place int, negative_id long, negative_score string, ordered string"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[k] for k in kinds]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], list(names))


def _positives(count: int):
    """A block of anchors and one of rows to each anchor's first ``count`` rows of its label here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (ids, labels, v, v_wide), (aid, al, q, q_wide) = unpack(row), unpack(row, "q_")
                s, out = scores(q, q_wide, v, v_wide), []
                for i in range(len(aid)):
                    own = np.flatnonzero((labels == al[i]) & (ids != aid[i]))
                    for j in own[best_first(s[i, own], ids[own])[:count]]:
                        n = int(s[i, j])
                        out.append((int(aid[i]), int(ids[j]), str(n), order_key(n)))
                yield _batch(out, FOUND)

    return run


def _negatives(k: int, low: int, high: int):
    """A block of anchors, with their positives, and one of rows to each positive's first ``k`` negatives here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (ids, labels, v, v_wide), (aid, al, q, q_wide) = unpack(row), unpack(row, "q_")
                asked: dict[int, list] = {}
                for p in row["positives"]:
                    asked.setdefault(p["anchor_id"], []).append(p)
                s, out = scores(q, q_wide, v, v_wide), []
                for i in range(len(aid)):
                    if int(aid[i]) not in asked:
                        continue
                    order = best_first(s[i], ids)
                    down, other = -s[i][order], labels[order] != al[i]
                    places = np.flatnonzero(other)
                    for p in asked[int(aid[i])]:
                        n = int(p["score"])
                        # whole numbers x with low * n <= 100 * x <= high * n
                        top, bottom = high * n // 100, -(-low * n // 100)
                        if top < bottom:
                            continue
                        first = int(np.searchsorted(places, _place(down, -top)))
                        for r in range(first, min(first + k, len(places))):
                            j = order[places[r]]
                            x = int(s[i, j])
                            if x < bottom:
                                break
                            out.append((int(aid[i]), p["vec_id"], p["score"], p["place"], int(ids[j]), str(x), order_key(x)))
                yield _batch(out, MINED)

    return run


def _place(down: np.ndarray, at: int) -> int:
    """The first place in a rising row that is not below ``at``, by binary search; ``at`` may be beyond 64 bits."""
    if down.dtype != object:
        return int(np.searchsorted(down, np.int64(max(-(2**63), min(2**63 - 1, at)))))
    lo, hi = 0, len(down)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if down[mid] < at else (lo, mid)
    return lo


def mine(rows: DataFrame, anchors: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scratch: Scratch | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, label and embedding; ``anchors`` is a condition on vec_id. ``low`` and
    ``high`` are the limits in hundredths of the positive's score.
    """
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "negatives")
    sound = sound_rows(rows, F.col("label").cast("long").alias("label")).where("label is not null")
    one = sound.groupBy("vec_id").agg(F.min(F.struct("label", "d")).alias("r")).select("vec_id", "r.label", "r.d")
    one = scratch.keep(one)
    data = scratch.keep(blocks(one))
    asked = scratch.keep(blocks(one.where(anchors), 256).select("dim", *[F.col(c).alias(f"q_{c}") for c in ("wide", "ids", "labels", "vecs")]))
    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = scratch.keep(meet(data, asked, parts).mapInArrow(_positives(positives), FOUND))
    w = Window.partitionBy("anchor_id").orderBy(F.desc("ordered"), "vec_id")
    best = found.withColumn("place", F.row_number().over(w)).where(f"place <= {positives}")
    # an anchor is in one block of those asked
    block = F.xxhash64("q_ids")
    members = asked.select(block.alias("blk"), F.explode("q_ids").alias("anchor_id"))
    per_block = best.join(members, "anchor_id").groupBy("blk").agg(F.collect_list(F.struct("anchor_id", "vec_id", "score", "place")).alias("positives"))
    with_positives = scratch.keep(asked.withColumn("blk", block).join(per_block, "blk").drop("blk"))
    mined = scratch.keep(meet(data, with_positives, parts).mapInArrow(_negatives(k, low, high), MINED))
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("ordered"), "negative_id")
    out = mined.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", as_long("positive_score").alias("positive_score"), as_long("negative_score").alias("negative_score"))
