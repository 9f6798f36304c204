"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's target is its share of ``share`` times all words, capped at
twice the source with the excess reshared by weight. The mix holds whole
blocks of ``block`` words: sources get integer numbers of blocks by the
highest quotients target / (2 k - 1), and so do the shards of each source
by their words. A shard's documents stand in a seeded order; of its n blocks
it gives q div n whole passes and q mod n further blocks, in a circle from a
seeded block. A block may end inside a document, so a document's taken words
need not be a multiple of its size; none exceeds twice its size.

Everything is DataFrame and SQL functions: no Python runs on the executors,
and no window holds more than a shard's documents or a source's shards.

Edge cases: a null text has no words; sources are ordered by code point, the
null source last; rows with a null doc_id are mixed like others; repeated rows are
documents of their own, in one order with their twins; an empty table gives
no rows. Extra columns are ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import WORD, Scratch

WEIGHTS = (5, 2, 1)


def seats(cells: DataFrame, by: list[str], total: str, share: str) -> DataFrame:
    """``cells`` with ``seats``: Sainte-Laguë numbers that add up to column ``total`` within each ``by``.

    A cell has round(share / d) seats for a common divisor d. From d = sum of shares /
    total the rounded numbers miss the total by D seats; all of them then move
    one way, so each by D at most, and only the quotients of those seats are
    ranked. ``by`` may be empty: then the cells are few (one a source). Ties go
    to the larger share, then the cell's ``cell``. Cells of no share get nothing.
    """
    own = Window.partitionBy(*[F.col(c) for c in by]) if by else Window.partitionBy(F.lit(1))
    c = cells.withColumn("__sum", F.sum(share).over(own))
    c = c.withColumn("__at", F.when(F.col("__sum") > 0, F.floor(F.col(share) * F.col(total) / F.col("__sum") + 0.5)).otherwise(F.lit(0)).cast("long"))
    c = c.withColumn("__off", F.abs(F.col(total) - F.sum("__at").over(own)))
    c = c.withColumn("__base", F.greatest(F.lit(0).cast("long"), F.col("__at") - F.col("__off")))
    c = c.withColumn("__open", F.when(F.col("__sum") > 0, F.col(total) - F.sum("__base").over(own)).otherwise(F.lit(0)))
    q = c.where(f"__off > 0 and {share} > 0").select(*by, "cell", F.col(share).alias("__s"), "__open", F.explode(F.expr("sequence(__base + 1, __at + __off)")).alias("__k"))
    rank = own.orderBy(F.desc(F.col("__s") / (2 * F.col("__k") - 1)), F.desc("__s"), "cell")
    won = q.withColumn("__r", F.row_number().over(rank)).where("__r <= __open").groupBy(*by, "cell").agg(F.count("*").alias("__won"))
    out = c.join(won, [*by, "cell"], "left")
    exact = F.col("__base") + F.coalesce("__won", F.lit(0))
    return out.withColumn("seats", F.when(F.col("__off") == 0, F.col("__at")).otherwise(exact)).drop("__sum", "__at", "__off", "__base", "__open", "__won")


def targets(sources: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): filled by weight up to twice each size.

    In the order of size / weight the capped sources come first, so one
    running sum finds the level at which no source is above its cap.
    """
    order = Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("__w", w)
    every = Window.partitionBy(F.lit(1))
    up = every.orderBy((F.col("source_size") / F.col("__w")).asc(), F.asc_nulls_last("source"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__all", F.sum("source_size").over(every))
    s = s.withColumn("__left", F.lit(share) * F.col("__all") - 2 * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("__rest", F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0)))
    s = s.withColumn("__level", F.col("__left") / F.col("__rest"))
    free = F.col("__level") * F.col("__w") <= 2 * F.col("source_size")
    s = s.withColumn("__n", F.row_number().over(up)).withColumn("__free", free)
    first = s.where("__free").agg(F.min_by("__level", "__n").alias("__lam"), F.min("__n").alias("__from"))
    s = s.crossJoin(F.broadcast(first))
    target = F.when(F.col("__n") >= F.col("__from"), F.col("__lam") * F.col("__w")).otherwise(F.lit(2.0) * F.col("source_size"))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _place(docs: DataFrame, share: float, weights: tuple[int, ...], block: int, shard_words: int, seed: int, scratch: Scratch) -> DataFrame:
    """``docs`` with __size, __source_size, __target, __passes, and the words of its further blocks: __ahead words from word
    __from on, then __behind words from the start."""
    # the null source has a name of its own; names that begin like it get one more of its first character
    src = F.coalesce(F.when(F.col("source").startswith("\x00"), F.concat(F.lit("\x00"), "source")).otherwise(F.col("source")), F.lit("\x00null"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    number = lambda x: F.conv(F.substring(x, 1, 8), 16, 10).cast("long")
    sized = scratch.keep(docs.select(F.col("source"), src.alias("__src"), number(order).alias("__n"), _size().alias("__size")))
    per = targets(sized.groupBy("source").agg(F.sum("__size").alias("source_size")), share, weights)
    per = per.withColumn("cell", src).withColumn("blocks", F.floor(F.sum("target").over(Window.partitionBy(F.lit(1))) / block + 0.5).cast("long"))
    per = seats(per, [], "blocks", "target").select(F.col("cell").alias("__src"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("seats").alias("__quota"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).alias("__shards"))
    per = scratch.keep(per)
    few = per.count() <= 10_000
    per_side = F.broadcast(per) if few else per
    shard = F.pmod(F.col("__n"), F.col("__shards")).alias("__shard")
    shards = sized.join(per_side, "__src").groupBy("__src", "__quota", shard).agg(F.sum("__size").alias("__words"))
    shards = seats(shards.withColumn("cell", F.col("__shard")), ["__src"], "__quota", "__words").withColumn("__blocks", F.ceil(F.col("__words") / block))
    start = F.pmod(number(F.md5(F.concat(F.lit(f"{seed}/"), "__src", F.lit("/"), F.col("__shard").cast("string")))), F.greatest("__blocks", F.lit(1)))
    # at most two passes in all: a last block that is short never asks for a third
    q, n = F.least("seats", 2 * F.col("__blocks")), F.greatest("__blocks", F.lit(1))
    shards = shards.withColumn("__q", q).withColumn("__nb", n)
    shards = scratch.keep(shards.select("__src", "__shard", "__words", "__blocks", F.expr("__q div __nb").alias("__passes"), F.expr("__q % __nb").alias("__r"), start.alias("__first")))
    rows = docs.withColumns({"__src": src, "__o": order, "__n": number(order), "__size": _size()}).join(per_side, "__src").withColumn("__shard", F.pmod(F.col("__n"), F.col("__shards")))
    run = Window.partitionBy("__src", "__shard").orderBy("__o", "__size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__c", F.coalesce(F.sum("__size").over(run), F.lit(0)))
    rows = rows.join(F.broadcast(shards) if few and shards.count() <= 100_000 else shards, ["__src", "__shard"])
    lo, hi = F.col("__first") * block, (F.col("__first") + F.col("__r")) * block
    cut = lambda a, b: F.greatest(F.lit(0), F.least(F.col("__c") + F.col("__size"), b) - F.greatest(F.col("__c"), a))
    return rows.withColumns({"__ahead": cut(lo, F.least(hi, F.col("__words"))), "__behind": cut(F.lit(0), F.greatest(F.lit(0), hi - F.col("__blocks") * block)), "__from": F.greatest(F.lit(0), lo - F.col("__c"))})


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, block: int = 16, shard_words: int = 2_000_000, seed: int = 7, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``; taken counts repeats."""
    p = _place(docs.select("doc_id", "source", "text"), share, weights, block, shard_words, seed, scratch or Scratch(docs.sparkSession, "mix"))
    taken = F.col("__passes") * F.col("__size") + F.col("__ahead") + F.col("__behind")
    return p.select("doc_id", "source", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.cast("long").alias("taken"))


def take(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, block: int = 16, shard_words: int = 2_000_000, seed: int = 7, scratch: Scratch | None = None) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each time a text is taken.

    A text that a block's edge cuts gives a row with the words taken, white
    space between them as it was, and two rows where its end and its start are
    taken but not its middle; all others come whole.
    """
    p = _place(docs, share, weights, block, shard_words, seed, scratch or Scratch(docs.sparkSession, "mix"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})[\\x20\\x09-\\x0D]*"), F.lit(0))
    ahead, behind = (F.col(c).cast("int") for c in ("__ahead", "__behind"))
    cut = lambda at, n: F.when(n > 0, F.rtrim(F.array_join(F.slice(words, at, n), "")))
    some = F.array_compact(F.array(cut(F.col("__from").cast("int") + 1, ahead), cut(F.lit(1), behind)))
    whole = (F.col("__ahead") + F.col("__behind")) == F.col("__size")
    part = F.when((ahead + behind > 0) & whole, F.array(F.col("text"))).otherwise(some)
    copies = F.when(F.col("__size") > 0, F.concat(F.array_repeat("text", F.col("__passes").cast("int")), part)).otherwise(F.array().cast("array<string>"))
    out = p.select(*[F.col(c) for c in docs.columns if c != "text"], F.explode(copies).alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
