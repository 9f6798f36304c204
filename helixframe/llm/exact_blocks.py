"""Integer vectors in blocks, and their exact inner products whatever their size.

A component x counts as floor(256 x), x as double. That is a whole double, so
blocks hold doubles. A row whose components are small enough that no inner
product of two such rows of its length can leave the 53 bits in which doubles are exact is
``plain``; all others are ``wide`` and are multiplied as Python integers. The two kinds
are never in one block, so a few wide rows cost what they cost and no more.

Scores that may have any number of digits travel as text, with a text beside it whose order is
that of the numbers (``order_key``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "dim int, wide boolean, ids array<long>, labels array<long>, vecs binary"
ROWS, VALUES = 4096, 1 << 19


def sound_rows(vectors: DataFrame, *more: str) -> DataFrame:
    """(vec_id, d array<double>, more) of rows with an id whose components are all there and finite."""
    d = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), d.alias("d"), *more)


def plain_bound(dim: int) -> float:
    """Components below it keep every partial sum of ``dim`` products within 2 ** 53."""
    return 2.0 ** ((52 - math.ceil(math.log2(max(dim, 1)))) // 2)


def _blocks(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(2)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sizes = np.diff(offsets)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                v = flat[offsets[at][:, None] + np.arange(n)]
                with np.errstate(over="ignore"):  # wide rows keep x itself: 256 x may be beyond doubles
                    f = np.floor(v * 256.0)
                    wide = (np.abs(f) >= plain_bound(int(n))).any(axis=1) if n else np.zeros(len(at), bool)
                for kind in (False, True):
                    own = np.flatnonzero(wide == kind)
                    step = max(1, min(rows, VALUES // max(int(n), 1)))
                    for b in range(0, len(own), step):
                        some = own[b : b + step]
                        some = some[np.argsort(ids[at[some]], kind="stable")]
                        values = (v if kind else f)[some]
                        cols = ([int(n)], [kind], [ids[at[some]]], [labels[at[some]]], [np.ascontiguousarray(values).tobytes()])
                        kinds = (pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["dim", "wide", "ids", "labels", "vecs"])

    return run


def blocks(rows: DataFrame, size: int = ROWS) -> DataFrame:
    """Rows (vec_id, label long, d) as blocks of at most ``size`` rows of one length and kind, sorted by id."""
    return rows.select("vec_id", "label", "d").mapInArrow(_blocks(size), BLOCK)


def meet(data: DataFrame, asked: DataFrame, parts: int) -> DataFrame:
    """Each block of ``data`` with each block of ``asked`` (columns dim, q...) of its length. Blocks of data are dealt to
    ``parts``, each of which gets all that is asked, so neither side has to fit one task. They are merged, not broadcast: a
    plan takes the copies for no larger than the file they are made of, and the driver would hold all of them."""
    copies = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return data.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")).join(copies.hint("merge"), ["dim", "part"]).drop("part")


def unpack(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(ids, labels, matrix, wide) of a block; a block that is asked has its columns under ``prefix``."""
    ids, labels = (np.array(row[prefix + c], np.int64) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(row[prefix + "vecs"], np.float64).reshape(len(ids), row["dim"]), row[prefix + "wide"]


def whole(row: np.ndarray, wide: bool) -> list[int]:
    """Components as Python integers."""
    if not wide:
        return [int(x) for x in row]
    return [math.floor(x * 256.0) if abs(x) < 2.0**900 else 256 * int(x) for x in row.tolist()]


def scores(q: np.ndarray, q_wide: bool, v: np.ndarray, v_wide: bool) -> np.ndarray:
    """Exact inner products: int64 for plain rows, Python integers else."""
    if not (q_wide or v_wide):
        return (q @ v.T).astype(np.int64)
    a, b = [whole(x, q_wide) for x in q], [whole(x, v_wide) for x in v]
    out = np.empty((len(a), len(b)), object)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i, j] = sum(s * t for s, t in zip(x, y, strict=True))
    return out


def best_first(row: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of a row of scores from high to low, ties by smaller id."""
    if row.dtype == object:
        return np.array(sorted(range(len(row)), key=lambda i: (-row[i], ids[i])), np.int64)
    return np.lexsort((ids, -row))


def order_key(n: int) -> str:
    """A text that sorts as the number does."""
    s = str(abs(n))
    if n >= 0:
        return f"1{len(s):07d}{s}"
    return f"0{9_999_999 - len(s):07d}{s.translate(NINES)}"


def order_key_of(text: str) -> Column:
    """The same of a column of whole numbers in text."""
    digits = F.ltrim(F.lit("-"), F.col(text))
    size = F.length(digits)
    over = F.concat(F.lit("1"), F.lpad(size.cast("string"), 7, "0"), digits)
    under = F.concat(F.lit("0"), F.lpad((9_999_999 - size).cast("string"), 7, "0"), F.translate(digits, "0123456789", "9876543210"))
    return F.when(F.col(text).startswith("-"), under).otherwise(over)


NINES = str.maketrans("0123456789", "9876543210")


def as_long(text: str | Column) -> Column:
    """A number in text as a long; beyond 64 bits the nearest one."""
    text = F.col(text) if isinstance(text, str) else text
    limit = F.when(text.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    return F.coalesce(text.try_cast("long"), F.when(text.isNotNull(), limit))
