"""Tree sequences by edge differences: what changes at a breakpoint is what its edges bring and take.

Counts over trees (edges, internal nodes, roots) are sums of changes, so they need no tree: each node's children and
parents are running sums over its own breakpoints, and a tree's counts running sums over those of all nodes. Both are
cut into stretches of the genome whose sums are carried. Results that need a tree's shape (nearest neighbours,
restriction to samples) sweep a stretch in a task: it starts from the edges over its left end and then puts in and takes out
edges at each breakpoint. Work and shuffles grow with edges, and not with trees times edges.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stretch(position: Column, width: float) -> Column:
    return F.floor(position / width)


def tree_counts(edges: DataFrame, width: float = 1_000.0) -> DataFrame:
    """(left, right, n_edges, internal, roots) of each tree that has edges; internal nodes have a child there, roots no parent besides."""
    event = lambda node, pos, dc, dp: F.struct(F.col(node).alias("node"), F.col(pos).alias("pos"), F.lit(dc).alias("dc"), F.lit(dp).alias("dp"))
    ends = F.array(event("parent", "left", 1, 0), event("parent", "right", -1, 0), event("child", "left", 0, 1), event("child", "right", 0, -1))
    events = edges.where("left < right").select(F.explode(ends).alias("e")).select("e.*")
    events = events.groupBy("node", "pos").agg(F.sum("dc").alias("dc"), F.sum("dp").alias("dp")).withColumn("__bin", _stretch(F.col("pos"), width))
    # a node has a row a stretch where something changes
    per = events.groupBy("node", "__bin").agg(F.sum("dc").alias("c"), F.sum("dp").alias("p"))
    before = Window.partitionBy("node").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("node", "__bin", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p"))
    own = Window.partitionBy("node", "__bin").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = events.join(per, ["node", "__bin"]).withColumns({"c": F.col("c") + F.sum("dc").over(own), "p": F.col("p") + F.sum("dp").over(own)})
    was = {"c": F.col("c") - F.col("dc"), "p": F.col("p") - F.col("dp")}
    change = lambda now, old: now.cast("int") - old.cast("int")
    s = s.select("pos", "__bin", "dc", change(F.col("c") > 0, was["c"] > 0).alias("di"), change((F.col("c") > 0) & (F.col("p") == 0), (was["c"] > 0) & (was["p"] == 0)).alias("dr"))
    names = {"n_edges": "dc", "internal": "di", "roots": "dr"}
    at = s.groupBy("__bin", "pos").agg(*[F.sum(d).alias(d) for d in names.values()], F.lit(1).alias("one"))
    # a row a stretch of the genome
    bins = at.groupBy("__bin").agg(*[F.sum(d).alias(f"b_{d}") for d in names.values()], F.min("pos").alias("m"))
    w = Window.orderBy("__bin")
    bins = bins.select("__bin", *[F.coalesce(F.sum(f"b_{d}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"b_{d}") for d in names.values()], F.lead("m").over(w).alias("__next"))
    own = Window.partitionBy("__bin").orderBy("pos")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    out = at.join(bins, "__bin").select(F.col("pos").alias("left"), F.coalesce(F.lead("pos").over(own), F.col("__next")).alias("right"), *[(F.col(f"b_{d}") + F.sum(d).over(upto)).alias(n) for n, d in names.items()])
    return out.where("n_edges > 0 and right is not null")


def covered(edges: DataFrame, trees: DataFrame, width: float = 1_000.0) -> DataFrame:
    """Edges that lie over at least one of ``trees`` (left, right), which are trees of theirs: by the number of trees that start before each end."""
    points = edges.select(F.col("left").alias("at")).union(edges.select("right")).distinct()
    p = points.join(trees.select(F.col("left").alias("at"), F.lit(1).alias("k")), "at", "left").withColumn("__bin", _stretch(F.col("at"), width))
    bins = p.groupBy("__bin").agg(F.count("k").alias("b"))
    bins = bins.select("__bin", F.coalesce(F.sum("b").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    n = F.count("k").over(Window.partitionBy("__bin").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    p = p.join(bins, "__bin").select("at", (F.col("b") + n).alias("n"))
    end = lambda side: p.select(F.col("at").alias(side), F.col("n").alias(f"__{side}"))
    return edges.join(end("left"), "left").join(end("right"), "right").where("__right > __left").drop("__left", "__right")


def _in_stretches(edges: DataFrame, width: float) -> DataFrame:
    """Edges in each stretch that they lie over, cut at its ends."""
    # an edge that ends where a stretch starts has no part of it
    last = F.ceil(F.col("right") / width) - 1
    e = edges.where("left < right").withColumn("__bin", F.explode(F.sequence(_stretch(F.col("left"), width), last)))
    return e.select("__bin", F.greatest(F.col("left"), F.col("__bin") * F.lit(width)).alias("left"), F.least(F.col("right"), (F.col("__bin") + 1) * F.lit(width)).alias("right"), "parent", "child")


def sweep(rows: pd.DataFrame) -> Iterator[tuple[float, float, list[tuple[int, int]], list[tuple[int, int]]]]:
    """(left, right, edges taken out, edges put in) of each tree of a stretch, as (parent, child)."""
    ins, outs = defaultdict(list), defaultdict(list)
    for left, right, p, c in zip(rows["left"], rows["right"], rows["parent"], rows["child"], strict=True):
        ins[left].append((p, c))
        outs[right].append((p, c))
    points = sorted({*ins, *outs})
    for left, right in zip(points[:-1], points[1:], strict=True):
        yield left, right, outs.get(left, []), ins.get(left, [])


def nearest_neighbours(edges: DataFrame, sets: DataFrame, focal: DataFrame | None = None, width: float = 1_000.0) -> DataFrame:
    """(node, set, gnn): for each focal node the share of each reference set among its nearest neighbours.

    In each tree a focal node's neighbours are the other reference nodes below
    its first ancestor that has any; shares are averaged over trees by span.
    ``sets`` is (set, node), a sample table. Focal nodes default to all reference nodes. A tree's
    counts are those of the tree before, changed on the ways from changed edges to the root.
    """
    # the samples: bounded by the cohort
    of = {r["node"]: r["set"] for r in sets.select("set", "node").collect()}
    names = sorted(set(of.values()))
    ask = sorted(r["node"] for r in focal.select("node").collect()) if focal is not None else sorted(of)
    place = {s: i for i, s in enumerate(names)}
    kind = sets.schema["set"].dataType.simpleString()

    def one_stretch(rows: pd.DataFrame) -> pd.DataFrame:
        up: dict[int, int] = {}
        below = defaultdict(lambda: np.zeros(len(names), np.int64))
        for node, s in of.items():
            below[node][place[s]] += 1
        total, spans = {u: np.zeros(len(names)) for u in ask}, dict.fromkeys(ask, 0.0)
        for left, right, out, new in sweep(rows):
            for sign, changed in ((-1, out), (1, new)):
                for p, c in changed:
                    if sign < 0:
                        up.pop(c, None)
                    at, n = p, sign * below[c]
                    while at is not None:
                        below[at] = below[at] + n
                        at = up.get(at)
                    if sign > 0:
                        up[c] = p
            for u in ask:
                own, at = of.get(u), u
                while at is not None and below[at].sum() <= (own is not None):
                    at = up.get(at)
                if at is None:
                    continue
                n = below[at].astype(float)
                if own is not None:
                    n[place[own]] -= 1
                total[u] += (right - left) * n / n.sum()
                spans[u] += right - left
        out = [(u, s, total[u][i], spans[u]) for u in ask if spans[u] for i, s in enumerate(names)]
        return pd.DataFrame(out, columns=["node", "set", "w", "span"])

    per = _in_stretches(edges, width).groupBy("__bin").applyInPandas(one_stretch, f"node long, set {kind}, w double, span double")
    return per.groupBy("node", "set").agg((F.sum("w") / F.sum("span")).alias("gnn"))


def simplify(edges: DataFrame, samples: list[int], width: float = 1_000.0) -> DataFrame:
    """Edges (left, right, parent, child) of the trees of ``samples`` alone: of other nodes those stay at which lines of samples meet.

    Each stretch gives the edges of its restricted trees, and equal edges that touch become one, over stretches too.
    """
    wanted = frozenset(samples)

    def one_stretch(rows: pd.DataFrame) -> pd.DataFrame:
        up: dict[int, int] = {}
        kids = defaultdict(set)
        open_: dict[tuple[int, int], float] = {}
        out: list[tuple[float, float, int, int]] = []
        for left, _right, gone, new in sweep(rows):
            for p, c in gone:
                kids[p].discard(c)
                up.pop(c, None)
            for p, c in new:
                kids[p].add(c)
                up[c] = p
            now = set(_restricted(up, kids, wanted))
            for e in [e for e in open_ if e not in now]:
                out.append((open_.pop(e), left, *e))
            for e in now:
                open_.setdefault(e, left)
            last = _right
        out += [(start, last, *e) for e, start in open_.items()]
        return pd.DataFrame(out, columns=["left", "right", "parent", "child"])

    cut = _in_stretches(edges, width).groupBy("__bin").applyInPandas(one_stretch, "left double, right double, parent long, child long")
    w = Window.partitionBy("parent", "child").orderBy("left")
    # parts of an edge do not overlap
    s = cut.withColumn("__new", F.coalesce(F.col("left") > F.lag("right").over(w), F.lit(True)).cast("int"))
    s = s.withColumn("__g", F.sum("__new").over(w))
    return s.groupBy("parent", "child", "__g").agg(F.min("left").alias("left"), F.max("right").alias("right")).select("left", "right", "parent", "child")


def _restricted(up: dict[int, int], kids: dict[int, set[int]], wanted: frozenset[int]) -> Iterator[tuple[int, int]]:
    """(parent, child) of the tree of the wanted nodes: nodes above none of them go, and so do those with one line below."""
    lines: dict[int, set[int]] = defaultdict(set)  # children with wanted nodes below
    for s in wanted:
        at = s
        while (p := up.get(at)) is not None and at not in lines[p]:
            lines[p].add(at)
            at = p
    stays = lambda n: n in wanted or len(lines[n]) > 1
    for node in [*wanted, *[n for n in list(lines) if n not in wanted and len(lines[n]) > 1]]:
        at = up.get(node)
        while at is not None and not stays(at):
            at = up.get(at)
        if at is not None:
            yield at, node
