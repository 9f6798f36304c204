from pyspark.sql import functions as F

from helixframe.llm.common import Scratch
from helixframe.llm.links import connected_components, forest, in_blocks, links_in_blocks


def _members(spark, ids, keys):
    """Ids 0 ... ids - 1 under each of some keys; the last 40 are groups of their own, all others are one group."""
    comp = F.when(F.col("id") < ids - 40, 0).otherwise(F.col("id"))
    return spark.range(ids).select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(keys).cast("long"))).alias("key"), "id", comp.alias("comp"))


def test_pairs_of_blocks_grow_with_ids(spark):
    """A key of four times as many ids gives about as many times more pairs of blocks, not sixteen times; each pair across groups is in one."""
    n = {}
    for ids in (1_000, 4_000):
        scratch = Scratch(spark, "links")
        blocks, met = in_blocks(_members(spark, ids, 3), 64, scratch)
        assert blocks.select("id").distinct().count() == blocks.count() == ids
        n[ids] = met.count()
        blk = {r.id: r.blk for r in blocks.where(f"id < 20 or id >= {ids - 40}").collect()}
        pairs = {(r.x, r.y) for r in met.collect()}
        for a in blk:
            for b in blk:
                if a < b and b >= ids - 40:
                    assert (min(blk[a], blk[b]), max(blk[a], blk[b])) in pairs
    assert n[1_000] <= 1_000 / 64 and n[4_000] <= 4_000 / 64, n


def test_links_between_groups_in_large_blocks(spark):
    """Bodies that are equal link, whatever blocks they are in, within large groups and between small ones."""
    import numpy as np

    ids = 700
    members = _members(spark, ids, 2)
    signed = spark.range(ids).select("id", F.lit(1).cast("long").alias("n"), F.lit(b"12345678").alias("sig"))
    body = F.when(F.col("id").isin(3, ids - 1), "a").when(F.col("id").isin(ids - 5, ids - 9), "b").otherwise(F.col("id").cast("string"))
    bodies = spark.range(ids).select("id", body.cast("binary").alias("body"))
    near = lambda na, nb, sa, sb: np.ones((len(na), len(nb)), bool)
    found = links_in_blocks(members, signed, near, lambda i: bodies.join(i, "id"), lambda pairs: [x == y for x, y in pairs], Scratch(spark, "links"))
    assert {(min(r), max(r)) for r in found.collect()} == {(3, ids - 1), (ids - 9, ids - 5)}


def test_edges_of_a_large_group_are_met_once(spark):
    """Forty edges a node leave no more than a tree, and the same groups."""
    edges = spark.range(4_000).select((F.col("id") % 200 + 1).alias("a"), (F.xxhash64("id") % 50).alias("b")).where("a <> b")
    want = {(r.node, r.comp) for r in connected_components(edges, Scratch(spark, "links")).collect()}
    left = forest(edges, Scratch(spark, "links"))
    nodes = edges.select("a").union(edges.select("b")).distinct().count()
    assert left.count() == nodes - 1 and len({c for _, c in want}) == 1 and len(want) == nodes
    two = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 5), (None, 7), (6, 5)], "a long, b long")
    assert {tuple(r) for r in connected_components(two, Scratch(spark, "links")).collect()} == {(1, 1), (2, 1), (4, 4), (5, 4), (6, 4)}


def test_memory_of_words_is_bounded():
    """What a packing worker remembers does not grow beyond twice its bound and a text's own words, and no id depends on it."""
    from helixframe.llm import packing
    from helixframe.llm.queries import vocabulary

    small, large = (packing.WordIds(vocabulary("word_bpe_49k.json"), most) for most in (100, 500_000))
    for k in range(60):
        text = " ".join(f"w{(k * 31 + i) % 900}" for i in range(50))
        assert small(text) == large(text)
        assert len(small.seen) + len(small.seen.old) <= 300


def test_a_chain_becomes_a_star(spark):
    """What a task leaves of a chain are edges to its smallest node, so groups settle in few rounds."""
    chain = spark.range(1, 300, 1, 1).select("id", (F.col("id") - 1).alias("b")).withColumnRenamed("id", "a").orderBy(F.xxhash64("a"))
    assert {tuple(r) for r in forest(chain, Scratch(spark, "links")).collect()} == {(k, 0) for k in range(1, 300)}
    assert {tuple(r) for r in connected_components(chain, Scratch(spark, "links"), most_rounds=1).collect()} == {(k, 0) for k in range(300)}
