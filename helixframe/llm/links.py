"""Connected groups from shared keys, without listing the pairs of a group.

Every member of a key's bucket is compared with one representative of the
bucket; groups found that way are contracted, and buckets that still hold two
groups or more are compared in blocks, of which only links come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch, join_small


#: So many edges go to one task, which leaves one of them a node at most.
TOGETHER = 1 << 17


def _find(x: int, root: dict[int, int]) -> int:
    while root.get(x, x) != x:
        root[x] = x = root.get(root[x], root[x])
    return x


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest) of the nodes that the edges of a task join, but for the smallest ones themselves."""
    root = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = _find(a, root), _find(b, root)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    for at in range(0, len(nodes), 1 << 15):
        part = nodes[at : at + (1 << 15)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([_find(x, root) for x in part], pa.int64())], ["a", "b"])


def forest(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that join the same nodes; a node of a large group may have an edge for each of its
    keys, and of a group in one task there is left a star about its smallest node."""
    kept = scratch.keep(edges)
    out = scratch.keep(kept.coalesce(max(1, -(-kept.count() // TOGETHER))).mapInArrow(_stars, "a long, b long"))
    scratch.drop(kept)
    return out


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, comp) for all nodes of ``edges`` (a, b), comp being the smallest node reachable.

    Hooking and pointer jumping over tables: the rounds needed grow with the
    logarithm of a group's diameter. Null ends and loops take no part; an
    empty table gives an empty one.
    """
    e = forest(edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), scratch)
    e = scratch.keep(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    f = scratch.keep(e.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")))
    for _ in range(most_rounds):
        up = f.select(F.col("node").alias("comp"), F.col("comp").alias("gf"))
        g = f.join(up, "comp", "left").select("node", "comp", F.coalesce("gf", "comp").alias("gf"))
        g = scratch.keep(g)
        near = e.join(g.select(F.col("node").alias("b"), F.col("gf").alias("v")), "b").groupBy("a").agg(F.min("v").alias("v"))
        own = g.join(near.withColumnRenamed("a", "node"), "node")
        new = own.select("node", F.least("gf", "v").alias("comp")).union(own.select(F.col("comp").alias("node"), "v"))
        new = scratch.keep(new.groupBy("node").agg(F.min("comp").alias("comp")))
        changed = new.join(f.withColumnRenamed("comp", "old"), "node").where("comp <> old").limit(1).count()
        scratch.drop(g, f)
        f = new
        if not changed:
            scratch.drop(e)
            return f
    raise RuntimeError("connected components did not settle")


def link(keys: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, across: Callable[[DataFrame], DataFrame], spread: bool = True) -> DataFrame:
    """(node, comp) of nodes that a verified pair links to another.

    ``keys`` (key long, id long) is read twice and may repeat rows; ``verify`` takes distinct
    pairs (a, b) with a < b and returns those that hold. A pair that shares a
    key is compared unless its ends are already in one group, so no link
    between groups is lost. The bucket's representative is its smallest id; with
    ``spread``, the id that comes first in an order which differs from key to key
    (id XOR key). ``across`` takes the members (key, id, comp) of buckets that still
    hold two groups and returns links between them.
    """
    mixed = F.col("id").bitwiseXOR(F.col("key"))
    aggs = [F.min("id").alias("head"), F.max("id").alias("hi")] + ([F.min(mixed).alias("m")] if spread else [])
    heads = keys.groupBy("key").agg(*aggs).where("head < hi")
    heads = scratch.keep(heads.select("key", F.col("m").bitwiseXOR(F.col("key")).alias("head") if spread else "head"))
    shared = scratch.keep(join_small(keys, heads, "key", "inner", heads.count()).distinct())
    scratch.drop(heads)
    return _link(shared, verify, scratch, across)


def link_shared(shared: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, across: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``link`` of (key, id) of which it is known that each key has two ids at least; the smallest represents them."""
    shared = scratch.keep(shared.distinct())
    heads = shared.groupBy("key").agg(F.min("id").alias("head"))
    full = scratch.keep(shared.join(heads, "key"))
    scratch.drop(shared)
    return _link(full, verify, scratch, across)


def _link(shared: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, across: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``link`` of distinct (key, id, head)."""
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    star = shared.where("id <> head").select(*pair("id", "head")).distinct()
    found = scratch.keep(verify(star))
    comps = connected_components(found, scratch)

    grouped = shared.join(comps.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    grouped = scratch.keep(grouped)
    scratch.drop(shared, found)
    mixed_keys = grouped.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
    # a bucket of two was settled by its representative
    left = scratch.keep(grouped.join(mixed_keys.where("lo <> hi and n > 2").select("key"), "key"))
    more = across(left)
    scratch.drop(grouped)
    if more.limit(1).count() == 0:
        return comps
    # groups are contracted: only links between them are followed again
    own = lambda end, name: comps.select(F.col("node").alias(end), F.col("comp").alias(name))
    between = more.select("a", "b").join(own("a", "ca"), "a", "left").join(own("b", "cb"), "b", "left")
    top = connected_components(between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), scratch)
    up = top.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    lifted = comps.join(up, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    return lifted.union(top.join(comps.select("node"), "node", "left_anti").select("node", "comp"))


def in_blocks(members: DataFrame, size: int, scratch: Scratch, most: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Blocks of ids that tend to share keys (they have the same smallest
    representative): (id, comp, blk), and the pairs of blocks
    (x, y), x <= y, with a key in common that may hold a link between groups.

    n ids with one representative give blocks of ``size`` ids, of (size * n) ** 0.5 if that is more, ``most`` at
    most: so up to most ** 2 / size ids there are no more pairs of blocks than about n / size, whatever their keys. A
    group that fills a block has blocks of its own, which do not meet each other.
    """
    mixed = F.col("id").bitwiseXOR(F.col("key"))
    heads = members.groupBy("key").agg(F.min(mixed).alias("m")).select("key", F.col("m").bitwiseXOR(F.col("key")).alias("b"))
    ids = scratch.keep(members.join(heads, "key").groupBy("id", "comp").agg(F.min("b").alias("g")))
    full = F.least(F.lit(most), F.greatest(F.lit(size), F.ceil(F.sqrt(F.lit(size) * F.sum("n"))))).alias("full")
    per = scratch.keep(ids.groupBy("g", "comp").agg(F.count("*").alias("n")))
    per = per.join(per.groupBy("g").agg(full), "g").select("g", "comp", "n", "full", F.when(F.col("n") >= F.col("full"), F.col("comp")).alias("own"))
    many = per.groupBy("g", "own").agg(F.sum("n").alias("n"), F.first("full").alias("full"))
    placed = per.select("g", "comp", "own").join(many.withColumnsRenamed({"g": "h", "own": "o"}), F.expr("g = h and own <=> o")).drop("h", "o")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / F.col("full")))
    blocks = scratch.keep(ids.join(placed, ["g", "comp"]).select("id", "comp", "own", F.xxhash64("g", "own", part).alias("blk")))
    met = scratch.keep(members.select("key", "id").join(blocks.select("id", "blk", "own"), "id").select("key", "blk", "own").distinct())
    # keys of the same blocks count once; sets whose hashes happen to be equal only meet more
    sets = met.groupBy("key").agg(F.bit_xor(F.xxhash64("blk")).alias("set"))
    met = scratch.keep(met.join(sets, "key").select("set", "blk", "own").distinct())
    x, y = met.alias("x"), met.alias("y")
    pairs = x.join(y, F.expr("x.set = y.set and x.blk <= y.blk and (x.own is null or y.own is null or x.own <> y.own)"))
    met = scratch.keep(pairs.select(F.col("x.blk").alias("x"), F.col("y.blk").alias("y")).distinct())
    return blocks, met


def _members(lists: pa.ListArray) -> Callable[[int], tuple[np.ndarray, ...]]:
    """What gives the ids, groups, n and signatures (a row of bytes each) of a list of members (id, comp, n, sig)."""
    cut, m = lists.offsets.to_numpy(), lists.values
    ids, comps, n = (m.field(c).to_numpy() for c in ("id", "comp", "n"))
    sig = m.field("sig").cast(pa.large_binary())
    _, begin, data = sig.buffers()
    begin = np.frombuffer(begin, np.int64)[sig.offset :] if len(sig) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)

    def member(r: int) -> tuple[np.ndarray, ...]:
        own = slice(cut[r], cut[r + 1])
        return ids[own], comps[own], n[own], data[begin[cut[r]] : begin[cut[r + 1]]].reshape(cut[r + 1] - cut[r], -1)

    return member


def _candidates(near: Callable):
    """Pairs of blocks to the pairs of ids across groups that may hold: a row a pair of blocks."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, sides = *(batch.column(c).to_numpy() for c in ("x", "y")), [_members(batch.column(c)) for c in ("ma", "mb")]
            for r, (x, y) in enumerate(zip(xs, ys, strict=True)):
                (ia, ca, na, sa), (ib, cb, nb, sb) = (side(r) for side in sides)
                found = []
                for at in range(0, len(ia), 64):
                    own = slice(at, at + 64)
                    may = (ca[own, None] != cb) & near(na[own], nb, sa[own], sb)
                    if x == y:
                        may &= ia[own, None] < ib
                    i, j = np.nonzero(may)
                    found.append((i + at, j))
                i, j = (np.concatenate(k) for k in zip(*found, strict=True))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([y]), pa.array([ia[i]], pa.list_(pa.int64())), pa.array([ib[j]], pa.list_(pa.int64()))], schema=schema)

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids in the lists a and b of a task, each once."""
    seen = np.empty(0, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            seen = np.unique(np.concatenate([seen, *(part.column(c).flatten().to_numpy() for c in ("a", "b"))]))
    yield pa.RecordBatch.from_arrays([pa.array(seen)], ["id"])


def _links(holds: Callable):
    """Confirms pairs on bodies, a batch of blocks at once. Each round takes twice as many pairs of a pair of
    blocks as the one before; pairs that confirmed ones have already put in one group are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, comp, root, todo = {}, {}, {}, []
            for r in range(batch.num_rows):
                pairs = list(zip(batch.column("a")[r].as_py(), batch.column("b")[r].as_py(), strict=True))
                todo.append(pairs)
                for k, c in enumerate(("ma", "mb")):
                    asked, m = np.array(sorted({p[k] for p in pairs}), np.int64), batch.column(c)[r].values
                    ids, groups, bodies = (m.field(f) for f in ("id", "comp", "body"))
                    for i in np.flatnonzero(np.isin(ids.to_numpy(), asked)):
                        if (id_ := ids[i].as_py()) not in body:
                            body[id_], comp[id_] = bodies[i].as_py(), groups[i].as_py()
            take, held = 4, []
            while todo:
                now, later = {}, []
                for pairs in todo:
                    pairs = [(a, b) for a, b in pairs if _find(comp[a], root) != _find(comp[b], root)]
                    now |= dict.fromkeys(pairs[:take])
                    later.append(pairs[take:])
                for (a, b), yes in zip(now, holds([(body[a], body[b]) for a, b in now]), strict=True):
                    if yes:
                        root[_find(comp[a], root)] = _find(comp[b], root)
                        held.append((a, b))
                todo, take = [p for p in later if p], 2 * take
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64())], ["a", "b"])

    return run


def links_in_blocks(members: DataFrame, signed: DataFrame, near: Callable, fetch: Callable[[DataFrame], DataFrame], holds: Callable[[list[tuple[bytes, bytes]]], list[bool]], scratch: Scratch, size: int = 64) -> DataFrame:
    """(a, b): links between the groups of ``members`` (key, id, comp), enough of them to join all that are linked.

    Blocks of ``size`` ids and more meet where they share a key. ``signed`` (id, n, sig) has what
    ``near(na, nb, sa, sb)`` prunes with, a matrix for two blocks; ``fetch`` turns
    ids into (id, body binary), on pairs of which ``holds`` decides.
    """
    blocks, met = in_blocks(members, size, scratch)
    side = lambda df, name, m: df.select(F.col("blk").alias(name), F.col("m").alias(m))
    sums = scratch.keep(blocks.join(signed, "id").groupBy("blk").agg(F.collect_list(F.struct("id", "comp", "n", "sig")).alias("m")))
    may = met.join(side(sums, "x", "ma"), "x").join(side(sums, "y", "mb"), "y").select("x", "y", "ma", "mb")
    may = scratch.keep(may.mapInArrow(_candidates(near), "x long, y long, a array<long>, b array<long>"))
    ids = scratch.keep(may.select("a", "b").mapInArrow(_asked, "id long").distinct())
    full = scratch.keep(blocks.join(fetch(ids), "id").groupBy("blk").agg(F.collect_list(F.struct("id", "comp", "body")).alias("m")))
    both = may.join(side(full, "x", "ma"), "x").join(side(full, "y", "mb"), "y").select("a", "b", "ma", "mb")
    # a pair of blocks may hold one pair of ids or thousands: dealt at random to many tasks, however few bytes they are
    parts = max(64, 2 * int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
    out = scratch.keep(both.repartition(parts).mapInArrow(_links(holds), "a long, b long"))
    scratch.drop(sums, may, ids, full, met, blocks)
    return out
