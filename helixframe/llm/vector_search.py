"""Exact top-k by inner product over a vector-approximation file.

Vectors are integers, floor(256 x). Rows with a component of ``LARGE`` or more are few or none; they are scored against the
queries, and as queries against all rows, block by block in integers of any size (``exact_blocks``), so that
one odd row never ends a job; a score beyond 64 bits is given as the nearest long, after ranking. Bounds are widened by the rounding error where doubles are not exact. Each distinct vector is stored once in
two tables: cells (one byte a component, from equal steps between the least
and the largest value of the component) and exact components. A query bounds
every vector's score from its cells alone. The k-th best lower bound over all
blocks leaves few candidates; their exact components are read in the order
of their upper bounds, the first k of each query first, and then only those
whose bound still reaches the k-th exact score.

Copies: a vector that many rows share is scored once; of its rows only the
k + 1 with the smallest ids can be among the first k (ties go to the smaller
id, and one may be the query's own row), which loses no result.

Edge cases: null vectors, null or non-finite components and null ids take no part;
vectors of another length than the query's take part in no score with it;
rows that repeat a vec_id are one, as queries too, and of different vectors of an
id the smallest (as arrays compare) counts; vectors without components have no score; empty
tables give no rows. Extra columns are ignored. Blocks of queries meet blocks of cells in a
join, so neither side has to fit one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm import exact_blocks
from helixframe.llm.common import Scratch, join_small

STEPS = 255
#: Components below it give scores within 64 bits for vectors of up to 32,768 components.
LARGE = 2.0**16


def integer_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v array<bigint>) of rows (vec_id, d) whose components fit 64 bits."""
    return vectors.select("vec_id", F.transform("d", lambda x: F.floor(x * scale)).alias("v"))


def _best_of_blocks(k: int):
    """A block of queries and one of rows to each query's first ``k`` rows here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (ids, _, v, v_wide), (qid, _, q, q_wide) = exact_blocks.unpack(row), exact_blocks.unpack(row, "q_")
                s, out = exact_blocks.scores(q, q_wide, v, v_wide), []
                for i in range(len(qid)):
                    others = np.flatnonzero(ids != qid[i])
                    for j in others[exact_blocks.best_first(s[i, others], ids[others])[:k]]:
                        n = int(s[i, j])
                        out.append((int(qid[i]), int(ids[j]), str(n), exact_blocks.order_key(n)))
                cols = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["query_id", "vec_id", "score", "ordered"])

    return run


def _in_blocks(rows: DataFrame, queries: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(query_id, vec_id, score, ordered): the first ``k`` rows of each block for each query."""
    labelled = lambda df: df.withColumn("label", F.lit(0).cast("long"))
    asked = scratch.keep(exact_blocks.blocks(labelled(queries), 256).select("dim", *[F.col(c).alias(f"q_{c}") for c in ("wide", "ids", "labels", "vecs")]))
    parts = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = exact_blocks.meet(exact_blocks.blocks(labelled(rows)), asked, parts).where("dim > 0")
    return met.mapInArrow(_best_of_blocks(k), "query_id long, vec_id long, score string, ordered string")


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one length with lo and hi of each component to blocks of cells."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            lengths = np.diff(part.column(1).offsets.to_numpy())
            for n in np.unique(lengths):
                own = part.filter(pa.array(lengths == n))
                v, lo, step = _matrix(own.column(1)), _matrix(own.column(2))[0], _matrix(own.column(3))[0]
                # differences of longs are exact as unsigned ones
                c = np.minimum((v.astype(np.int64).view(np.uint64) - lo.astype(np.int64).view(np.uint64)) // step.astype(np.uint64), np.uint64(STEPS)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([int(n)], pa.int32()), pa.array([own.column(0).to_numpy().tobytes()]), pa.array([c.tobytes()]), pa.array([lo.astype(np.int64).tobytes()]), pa.array([step.astype(np.int64).tobytes()])], ["dim", "ids", "cells", "lo", "step"])


def _scan(k: int, own: int):
    """Blocks of queries with blocks of cells to (query_id, cls, lower, upper): those that may be among the first k + own here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["dim"]
                ids, cells = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["cells"], np.uint8).reshape(-1, max(n, 1))
                qid, q = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["q"], np.int64).reshape(-1, max(n, 1)).astype(np.float64)
                lo, step = (np.frombuffer(row[c], np.int64).astype(np.float64) for c in ("lo", "step"))
                low = lo + cells * step
                wide = step - 1
                at_low = q @ low.T
                # no sum is greater than reach: below 2 ** 53 all are exact in double
                reach = np.abs(q) @ (np.abs(lo) + (STEPS + 2) * step)
                slack = np.where(reach < 2.0**53, 0, reach * (n + 8) * 2.0**-50)
                lower, upper = at_low + (np.minimum(q, 0) @ wide - slack)[:, None], at_low + (np.maximum(q, 0) @ wide + slack)[:, None]
                m = min(k + own, lower.shape[1])
                kth = -np.partition(-lower, m - 1, axis=1)[:, m - 1]
                i, j = np.nonzero(upper >= kth[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(ids[j]), pa.array(lower[i, j]), pa.array(upper[i, j])], ["query_id", "cls", "lower", "upper"])

    return run


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            lengths = np.diff(part.column(1).offsets.to_numpy())
            for n in np.unique(lengths):
                own = part.filter(pa.array(lengths == n))
                yield pa.RecordBatch.from_arrays([pa.array([int(n)], pa.int32()), pa.array([own.column(0).to_numpy().tobytes()]), pa.array([_matrix(own.column(1)).astype(np.int64).tobytes()])], ["dim", "qids", "q"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries``, a subset of the rows of ``vectors`` (vec_id, v array<bigint>)."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "vectors")
    # an id has one vector: of several, the smallest
    vectors, queries = (x.groupBy("vec_id").agg(F.min("v").alias("v")) for x in (vectors, queries))
    queries = scratch.keep(queries)
    rows = scratch.keep(vectors.withColumn("h", F.xxhash64("v")))
    lead = Window.partitionBy("h", "v").orderBy("vec_id")
    members = rows.withColumn("r", F.row_number().over(lead)).where(f"r <= {k + 1}")
    members = scratch.keep(members)
    # a class is named by its smallest row
    exact = scratch.keep(members.where("r = 1").select(F.col("vec_id").alias("cls"), "v"))
    named = members.join(members.where("r = 1").select("h", "v", F.col("vec_id").alias("cls")), ["h", "v"]).select("cls", "vec_id")
    named = scratch.keep(named)
    spread = exact.select(F.size("v").alias("dim"), F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    step = F.greatest(F.lit(1), F.ceil((F.col("hi").cast("decimal(20,0)") - F.col("lo") + 1) / (STEPS + 1)).cast("long"))
    spread = spread.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("at", "lo", step.alias("step")))).alias("s")).select("dim", F.col("s.lo").alias("lo"), F.col("s.step").alias("step"))
    marked = exact.withColumn("dim", F.size("v")).where("dim > 0").join(F.broadcast(spread), "dim")
    blocks = scratch.keep(marked.select("cls", "v", "lo", "step").mapInArrow(_cells, "dim int, ids binary, cells binary, lo binary, step binary"))
    asked = scratch.keep(queries.where("size(v) > 0").mapInArrow(_query_blocks, "dim int, qids binary, q binary"))
    if asked.count() <= 64:
        met = blocks.join(F.broadcast(asked), "dim")
    else:  # blocks of cells are dealt to parts, each of which gets all queries
        parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
        copies = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        met = blocks.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")).join(copies, ["dim", "part"]).drop("part")
    bounds = scratch.keep(met.mapInArrow(_scan(k, 1), "query_id long, cls long, lower double, upper double"))
    w = Window.partitionBy("query_id").orderBy(F.desc("lower"), "cls")
    floor_ = bounds.withColumn("r", F.row_number().over(w)).where(f"r <= {k + 1}").groupBy("query_id").agg(F.when(F.count("*") > k, F.min("lower")).alias("least"))
    open_ = scratch.keep(bounds.join(floor_, "query_id").where("least is null or upper >= least").select("query_id", "cls", "upper"))

    asker = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))

    def product(kind: str) -> Column:
        return F.aggregate(F.zip_with("qv", "v", lambda a, b: a.cast(kind) * b.cast(kind)), F.lit(0).cast(kind if kind == "long" else "decimal(38,0)"), lambda s, x: (s + x).cast(kind if kind == "long" else "decimal(38,0)"))

    most = lambda c: F.array_max(F.transform(c, lambda x: F.abs(x.cast("double"))))
    # a score of more than 64 bits is an error, as in the SQL
    dot = F.when(F.size("v") * most("qv") * most("v") < 2.0**62, product("long")).otherwise(product("decimal(19,0)").cast("long"))

    def read(part: DataFrame) -> DataFrame:
        return part.join(exact, "cls").join(asker, "query_id").select("query_id", "cls", dot.alias("score"))

    order = Window.partitionBy("query_id").orderBy(F.desc("upper"), "cls")
    ranked = open_.withColumn("r", F.row_number().over(order))
    first = scratch.keep(read(ranked.where(f"r <= {k + 1}").select("query_id", "cls")))
    sure = first.groupBy("query_id").agg(F.when(F.count("*") > k, F.min("score")).alias("kth"))
    rest = ranked.where(f"r > {k + 1}").join(sure, "query_id").where("kth is null or upper >= kth")
    scored = first.unionByName(read(rest.select("query_id", "cls")))
    full = scored.join(named, "cls").where("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return full.withColumn("rank", F.row_number().over(last)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def top_k_of_every(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k best rows for each row whose id ``every`` divides."""
    sound = exact_blocks.sound_rows(vectors)
    asked = F.col("vec_id") % every == 0
    large = F.exists("d", lambda x: F.abs(x) >= LARGE)
    scratch = Scratch(vectors.sparkSession, "vectors")
    if not sound.where(large).limit(1).count():
        v = integer_vectors(sound)
        return top_k(v, v.where(asked), k, scratch)
    # of different vectors of an id the smallest counts, large or not
    one = scratch.keep(sound.groupBy("vec_id").agg(F.min("d").alias("d")).withColumn("large", large))
    small, odd = one.where("not large"), one.where("large")
    v = integer_vectors(small)
    plain = top_k(v, v.where(asked), k, scratch).select("query_id", "vec_id", F.col("score").cast("string").alias("score"))
    plain = plain.withColumn("ordered", exact_blocks.order_key_of("score"))
    others = _in_blocks(odd, small.where(asked), k, scratch).unionByName(_in_blocks(one, odd.where(asked), k, scratch))
    best = Window.partitionBy("query_id").orderBy(F.desc("ordered"), "vec_id")
    ranked = plain.unionByName(others).withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
    return ranked.select("query_id", "rank", "vec_id", exact_blocks.as_long("score").alias("score"))
