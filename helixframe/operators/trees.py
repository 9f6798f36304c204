"""Tree-sequence tables, admixture and coalescence matrices, sample groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.sweeps import covered, tree_counts


def group_nodes(meta: DataFrame, group: str, ix: str) -> DataFrame:
    """(group, node): a sample's two nodes are 2 ix and 2 ix + 1."""
    return meta.select(group, F.explode(F.array(2 * F.col(ix), 2 * F.col(ix) + 1)).alias("node"))


def q_members(q: DataFrame, least: float) -> DataFrame:
    """(k, members): samples whose share of k is ``least`` or more."""
    return q.where(F.col("q") >= least).groupBy("k").agg(F.array_sort(F.collect_list("ix")).alias("members"))


def gnn_alignment(q: DataFrame, gnn: DataFrame) -> DataFrame:
    """The mean over samples of the mean over their two nodes of sum over k of min(Q, GNN)."""
    g = gnn.withColumn("ix", F.expr("node div 2"))
    m = g.join(q, ["ix", "k"]).groupBy("ix", "node").agg(F.sum(F.least("q", "gnn")).alias("m"))
    return m.groupBy("ix").agg(F.avg("m").alias("m")).agg(F.avg("m").alias("alignment"))


def ratios(edges: DataFrame, mutations: DataFrame) -> DataFrame:
    e = edges.agg(F.count("*").alias("edges"), F.avg(F.col("right") - F.col("left")).alias("mean_span"), F.max("right").alias("length"))
    m = mutations.agg(F.countDistinct("site_id").alias("sites"), F.count("*").alias("muts"))
    out = e.crossJoin(F.broadcast(m))  # one row each
    return out.withColumn("muts_per_site", F.col("muts").cast("double") / F.col("sites")).withColumn("sites_per_edge", F.col("sites").cast("double") / F.col("edges"))


def trees_of(edges: DataFrame, width: float = 1_000.0) -> DataFrame:
    """(left, right) of each tree: the stretches between neighbouring breakpoints.

    The next point is looked up within bins of ``width``; only a bin's last point looks at the first
    of the next bin, so one window holds a row a bin and the others a bin's points.
    """
    b = edges.select(F.col("left").alias("left")).union(edges.select("right")).distinct().withColumn("__bin", F.floor(F.col("left") / width))
    bins = b.groupBy("__bin").agg(F.min("left").alias("m"))
    bins = bins.withColumn("__next", F.lead("m").over(Window.orderBy("__bin"))).select("__bin", "__next")
    own = F.lead("left").over(Window.partitionBy("__bin").orderBy("left"))
    return b.withColumn("__own", own).join(bins, "__bin").select("left", F.coalesce("__own", "__next").alias("right")).where("right is not null")


def span_histogram(edges: DataFrame) -> DataFrame:
    """(span, n): how many trees have that whole length."""
    return trees_of(edges).groupBy(F.floor(F.col("right") - F.col("left")).cast("long").alias("span")).agg(F.count("*").alias("n"))


def tree_bits(edges: DataFrame, samples: int, width: float = 1_000.0) -> DataFrame:
    """For each tree: edges, edges - samples, that over samples - 2, internal nodes."""
    t = tree_counts(edges, width).drop("roots")
    bits = F.col("n_edges") - samples
    return t.withColumn("bits", bits).withColumn("rel_bits", bits.cast("double") / (samples - 2))


def tree_mask(bits: DataFrame, quantile: float, reverse: bool = False) -> DataFrame:
    """mask = 1 where bits are at or above the quantile (or below, reversed), else 0."""
    cut = bits.agg(F.percentile("bits", F.lit(quantile)).alias("cut"))
    keep = F.col("bits") <= F.col("cut") if reverse else F.col("bits") >= F.col("cut")
    return bits.crossJoin(F.broadcast(cut)).withColumn("mask", keep.cast("int")).drop("cut")


def root_counts(edges: DataFrame, width: float = 1_000.0) -> DataFrame:
    """How many trees have how many roots (parents that are no child in the same tree)."""
    return tree_counts(edges, width).where("roots > 0").groupBy("roots").agg(F.count("*").alias("trees"))


def mask_intervals(mask: DataFrame, reverse: bool = False) -> DataFrame:
    """(left, right) of the trees that a mask leaves out: those of 0, reversed of 1."""
    return mask.where(F.col("mask") == int(reverse)).select("left", "right")


def used_nodes(edges: DataFrame, mask: DataFrame, reverse: bool = False, width: float = 1_000.0) -> DataFrame:
    """(node) of all trees whose mask is 1, reversed 0."""
    t = covered(edges, mask.where(F.col("mask") == int(not reverse)).select("left", "right"), width)
    return t.select(F.col("parent").alias("node")).union(t.select("child")).distinct()


def local_stats(edges: DataFrame, mutations: DataFrame, width: float = 1_000.0) -> DataFrame:
    """For each tree: span, edges, internal nodes, mutations and sites in it, mutations a site."""
    per = tree_counts(edges, width).drop("roots")
    t = trees_of(edges, width).withColumn("__bin", F.explode(F.sequence(F.floor(F.col("left") / width), F.floor(F.col("right") / width))))
    m = mutations.select("mut_id", "site_id", "position", F.floor(F.col("position") / width).alias("__bin"))
    hit = m.join(t, "__bin").where("position >= left and position < right")
    hit = hit.groupBy("left", "right").agg(F.count("*").alias("muts"), F.countDistinct("site_id").alias("sites"))
    out = per.join(hit, ["left", "right"], "left").fillna(0, ["muts", "sites"]).withColumn("span", F.col("right") - F.col("left"))
    return out.withColumn("muts_per_site", F.try_divide(F.col("muts").cast("double"), F.col("sites").cast("double")))


def downsample_groups(members: DataFrame, group: str, most: int, seed: int = 1) -> DataFrame:
    """At most ``most`` members (group, ix) of each group, by a seeded order."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("ix").cast("string"))), "ix")
    return members.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def permute_groups(members: DataFrame, group: str, seed: int = 1) -> DataFrame:
    """The members dealt anew, groups keeping their sizes. A group list is a dimension: its samples fit one window."""
    k = lambda *by: F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by)).alias("__k")
    places = members.select(group, k(group, "ix"))
    dealt = members.select("ix", k(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("ix").cast("string"))), "ix"))
    return places.join(dealt, "__k").drop("__k")


def index_sound(meta: DataFrame, ix: str = "ix") -> DataFrame:
    """One row: whether the index runs 0..n - 1, each number once."""
    s = meta.agg(F.count("*").alias("n"), F.countDistinct(ix).alias("k"), F.min(ix).alias("lo"), F.max(ix).alias("hi"))
    return s.select("n", F.coalesce((F.col("n") == F.col("k")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1), F.col("n") == 0).alias("sound"))


def vertices_of(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges (parent, child, ...) with the rows of both ends, as ``p`` and ``c``; ends that no vertex has stay null."""
    side = lambda end, name: vertices.select(F.col("id").alias(end), F.struct(*vertices.columns).alias(name))
    return edges.join(side("parent", "p"), "parent", "left").join(side("child", "c"), "child", "left")


def population_pairs(pops: DataFrame, joint: DataFrame) -> DataFrame:
    """All ordered pairs of different populations (pop), with the joint row (pop0, pop1, ...) of either order."""
    a, b = pops.select(F.col("pop").alias("one")), pops.select(F.col("pop").alias("two"))
    both = a.join(b, F.col("one") != F.col("two")).withColumns({"pop0": F.least("one", "two"), "pop1": F.greatest("one", "two")})
    j = joint.withColumns({"__a": F.least("pop0", "pop1"), "__b": F.greatest("pop0", "pop1")}).drop("pop0", "pop1").withColumnsRenamed({"__a": "pop0", "__b": "pop1"})
    return both.join(j, ["pop0", "pop1"], "left").drop("pop0", "pop1")


def mutation_edges(mutations: DataFrame, edges: DataFrame) -> DataFrame:
    """Mutations with the edges above their node; both ends of an edge count.

    Both meet by node and bin of the genome, a bin being the edges' mean span, so an edge is in three bins on average and
    a mutation is compared with few edges but those above it. Places beyond the mutations' are in the outermost bins.
    """
    finite = F.when(F.abs("position") < float("inf"), F.col("position").cast("double"))
    low, high = mutations.agg(F.min(finite), F.max(finite)).first()
    low, high = low or 0.0, high or 0.0
    within = lambda c: F.least(F.greatest(F.col(c).cast("double"), F.lit(low)), F.lit(high))
    sound = edges.where("left <= right")
    width = sound.agg(F.avg(within("right") - within("left"))).first()[0] or max(high - low, 1.0)
    bin_of = lambda c: F.floor((within(c) - F.lit(low)) / F.lit(width))
    m = mutations.where("position is not null").withColumn("__bin", bin_of("position"))
    e = sound.withColumn("__at", F.explode(F.sequence(bin_of("left"), bin_of("right"))))
    met = m.join(e, (m["node"] == e["child"]) & (m["__bin"] == e["__at"]) & (m["position"] >= e["left"]) & (m["position"] <= e["right"]))
    return met.drop("__bin", "__at")


def population_sizes(msmc: DataFrame, mu: float, gen: float) -> DataFrame:
    return msmc.withColumn("years", F.col("t_left") * gen / mu).withColumn("size", 1 / F.col("lam") / (2 * mu))


def cross_coalescence(joint: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """Joint intervals with the mean rate within each population at ten points of them, and 2 l01 / (l00 + l11).

    An interval open to the right takes each population's last rate; a point beyond all of a
    population's intervals gives null.
    """
    open_ = F.col("t_right") == float("inf")
    at = F.col("t_left") + F.col("j") / F.lit(10.0) * (F.col("t_right") - F.col("t_left"))
    g = joint.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("t", F.when(open_, float("inf")).otherwise(at))
    for n, pop in (("00", one), ("11", two)):
        p = pop.select(F.col("t_left").alias("lo"), F.col("t_right").alias("hi"), F.col("lam").alias(f"l{n}"))
        last = p.agg(F.max("lo").alias("top"))
        p = p.crossJoin(F.broadcast(last))  # one row
        hit = F.when(F.col("t") == float("inf"), F.col("lo") == F.col("top")).otherwise((F.col("lo") <= F.col("t")) & (F.col("t") < F.col("hi")))
        g = g.join(F.broadcast(p), hit, "left").drop("lo", "hi", "top")  # a row a time interval
    out = g.groupBy("t_ix").agg(F.first("lam").alias("l01"), F.when(F.count("l00") == 10, F.avg("l00")).alias("l00"), F.when(F.count("l11") == 10, F.avg("l11")).alias("l11"))
    return out.withColumn("rccr", 2 * F.col("l01") / (F.col("l00") + F.col("l11")))


def cross_coalescence_pairs(joint: DataFrame, within: DataFrame) -> DataFrame:
    """(pop0, pop1, t_ix, l01, l00, l11, rccr) of all pairs at once: as ``cross_coalescence`` for each pair of ``joint`` (pop0, pop1,
    t_ix, t_left, t_right, lam), with the rates ``within`` (pop, t_left, t_right, lam) of all populations.

    Points of time meet their population's intervals in one ordered pass over both: the last interval that starts at or
    before a point. A population's points are ten an interval of its pairs.
    """
    inf = F.lit(float("inf"))
    at = F.col("t_left") + F.col("j") / F.lit(10.0) * (F.col("t_right") - F.col("t_left"))
    g = joint.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("t", F.when(F.col("t_right") == inf, inf).otherwise(at))
    sides = F.array(F.struct(F.col("pop0").alias("pop"), F.lit(0).alias("side")), F.struct(F.col("pop1").alias("pop"), F.lit(1).alias("side")))
    points = g.withColumn("s", F.explode(sides)).select("s.pop", "t", F.struct("pop0", "pop1", "t_ix", F.col("lam").alias("l01"), "s.side").alias("point"))
    rates = within.select("pop", F.col("t_left").alias("t"), F.struct("t_right", "lam").alias("rate"))
    both = rates.unionByName(points, allowMissingColumns=True)
    w = Window.partitionBy("pop").orderBy("t", F.col("point").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("r", F.last("rate", ignorenulls=True).over(w)).where("point is not null")
    lam = F.when((F.col("t") == inf) | (F.col("t") < F.col("r.t_right")), F.col("r.lam"))
    met = met.select("point.*", lam.alias("lam"))
    side = lambda k: F.when(F.count(F.when(F.col("side") == k, F.col("lam"))) == 10, F.avg(F.when(F.col("side") == k, F.col("lam"))))
    out = met.groupBy("pop0", "pop1", "t_ix").agg(F.first("l01").alias("l01"), side(0).alias("l00"), side(1).alias("l11"))
    return out.withColumn("rccr", 2 * F.col("l01") / (F.col("l00") + F.col("l11")))
