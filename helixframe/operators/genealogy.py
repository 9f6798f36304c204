"""Genealogical neighbours, tree distances, f3, coalescence times, bootstrap summaries and path factors."""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.operators.newick import leaves  # noqa: F401
from helixframe.operators.sweeps import nearest_neighbours  # noqa: F401


def group_means(gnn: DataFrame, group: str = "group") -> DataFrame:
    """(group, k, mean, z): the mean of each group and its z-score among the groups' means of k; null where they are all equal."""
    m = gnn.groupBy(group, "k").agg(F.avg("gnn").alias("mean"))
    w = Window.partitionBy("k")
    return m.withColumn("z", F.try_divide(F.col("mean") - F.avg("mean").over(w), F.stddev_pop("mean").over(w)))


def topology_vector(child: np.ndarray, parent: np.ndarray, samples: list[int]) -> np.ndarray:
    """Edges from the root to the common ancestor of each pair of samples, then 1 for each sample; 0 for pairs without one."""
    below = defaultdict(list)
    for c, p in zip(child, parent, strict=True):
        below[p].append(c)
    index = {s: i for i, s in enumerate(samples)}
    got = np.zeros((len(samples), len(samples)))
    depth, order, stack = {}, [], [(r, 0) for r in set(below) - set(child)]
    while stack:
        node, d = stack.pop()
        depth[node] = d
        order.append(node)
        stack += [(c, d + 1) for c in below.get(node, ())]
    leaves: dict[int, list[int]] = {}
    for node in reversed(order):
        parts = [leaves.pop(c) for c in below.get(node, ())]
        parts += [[index[node]]] if node in index else []
        for x, y in itertools.combinations(parts, 2):
            got[np.ix_(x, y)] = got[np.ix_(y, x)] = depth[node]
        leaves[node] = [i for p in parts for i in p]
    return np.concatenate([got[np.triu_indices(len(samples), 1)], np.ones(len(samples))])


def kc_distances(one: DataFrame, two: DataFrame, samples: list[int], positions: DataFrame, width: float = 1_000.0) -> DataFrame:
    """(pos, kc): the Kendall-Colijn distance of both trees at each of ``positions``, by topology alone.

    A position's two trees meet in one group; the vectors have a place for each pair of samples.
    """
    bins = positions.select(F.col("pos").cast("double").alias("pos")).distinct().withColumn("__bin", F.floor(F.col("pos") / width))

    def at(edges: DataFrame, name: str) -> DataFrame:
        e = edges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("left") / width), F.floor(F.col("right") / width))))
        return e.join(bins, "__bin").where("left <= pos and pos < right").select(F.col("pos").alias(name), "parent", "child")

    def compare(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = (topology_vector(t["child"].to_numpy(), t["parent"].to_numpy(), samples) for t in (a, b))
        return pd.DataFrame({"pos": [key[0]], "kc": [float(np.linalg.norm(x - y))]})

    return at(one, "p1").groupBy("p1").cogroup(at(two, "p2").groupBy("p2")).applyInPandas(compare, "pos double, kc double")


def kc_sample(spark: SparkSession, one: DataFrame, two: DataFrame, samples: list[int], left: int, right: int, n: int = 1000, seed: int = 0) -> DataFrame:
    """One row: the mean distance over ``n`` random positions of [left, right), repeats counted."""
    draws = spark.range(n).select((left + F.floor(F.rand(seed) * (right - left))).cast("double").alias("pos"))
    return draws.join(kc_distances(one, two, samples, draws), "pos").agg(F.avg("kc").alias("kc"))


def f3(pop_counts: DataFrame, target: str, one: str, two: str) -> DataFrame:
    """One row (sites, f3): the mean of (t - a)(t - b) - t(1 - t) / (n - 1) over sites called in all three, n > 1 in the target."""
    def part(pop: str) -> list[Column]:
        own = F.col("pop") == pop
        return [F.sum(F.when(own, F.col("n1"))), F.sum(F.when(own, F.col("n0") + F.col("n1")))]

    cols = [c.cast("double").alias(f"{v}{i}") for i, p in enumerate((target, one, two)) for v, c in zip("xn", part(p), strict=True)]
    s = pop_counts.where(F.col("pop").isin(target, one, two)).groupBy("chrom", "pos").agg(*cols).where("n0 > 1 and n1 > 0 and n2 > 0")
    t, a, b = (F.col(f"x{i}") / F.col(f"n{i}") for i in range(3))
    return s.agg(F.count("*").alias("sites"), F.avg((t - a) * (t - b) - t * (1 - t) / (F.col("n0") - 1)).alias("f3"))


def tmrca(msmc: DataFrame, mu: float = 1.25e-8, gen: float = 30.0, points: int = 10, run: str | None = None) -> DataFrame:
    """(…run, t_ix, j, years, pdf, cdf): the distribution of coalescence times at points of each interval but the last.

    Intervals are some tens a run, so the running sum is a window over a small group.
    """
    w = Window.partitionBy(*([run] if run else [F.lit(0)])).orderBy("t_ix")
    width = F.col("t_right") - F.col("t_left")
    flat = msmc.withColumn("__area", F.when(F.lead("t_ix").over(w).isNotNull(), width * F.col("lam")))
    before = F.coalesce(F.sum("__area").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    p = flat.withColumn("__before", before).where("__area is not null").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    t = F.col("t_left") + F.col("j") / F.lit(float(points)) * width
    gone = F.exp(-(F.col("__before") + (t - F.col("t_left")) * F.col("lam")))
    return p.select(*([run] if run else []), "t_ix", "j", (t * gen / mu).alias("years"), (F.col("lam") * gone).alias("pdf"), (1 - gone).alias("cdf"))


def migration_events(events: DataFrame, found: int, threshold: float = 0.5) -> DataFrame:
    """(parent, child, source, n, weight) of events in at least ``threshold`` of ``found`` replicates: (boot, parent, child, source, weight), leaf sets in any order."""
    key = [F.array_sort(c).alias(c) for c in ("parent", "child", "source")]
    return events.groupBy(*key).agg(F.count("*").alias("n"), F.avg("weight").alias("weight")).where(F.col("n") >= threshold * found)


def without_child(parent: Column, child: Column) -> Column:
    """A parent's leaves that are not the child's."""
    return F.array_sort(F.array_except(parent, child))


def factor_paths(spark: SparkSession, levels: dict[str, list[str]], chosen: dict[str, str | list[str]] | None = None, depth: int | None = None) -> DataFrame:
    """A row for each combination of the levels' factors, with ``path``; ``chosen`` narrows levels, ``depth`` cuts them.

    An unknown level or factor is an error. The lists are short by nature.
    """
    use = {}
    for name, allowed in list(levels.items())[:depth]:
        pick = (chosen or {}).get(name, allowed)
        pick = [pick] if isinstance(pick, str) else list(pick)
        if bad := [p for p in pick if p not in allowed]:
            raise ValueError(f"{name} has no factor {bad}")
        use[name] = pick
    if bad := set(chosen or {}) - set(levels):
        raise ValueError(f"no level {sorted(bad)}")
    rows = [(*c, "/".join(c)) for c in itertools.product(*use.values())]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in [*use, "path"]))


def path_factors(files: DataFrame, levels: dict[str, list[str]], path: str = "path") -> DataFrame:
    """``files`` with a column for each level: that part of the folder's path below the root if it is a factor, else 'NA'."""
    parts = F.split(path, "/")
    folder = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    part = lambda i: F.get(folder, F.lit(i))
    return files.withColumns({n: F.when(part(i).isin(a), part(i)).otherwise("NA") for i, (n, a) in enumerate(levels.items())})


def gnn_file_factors(files: DataFrame, path: str = "path") -> DataFrame:
    """The parameters that names of GNN files hold (adx_kK_tT_nN_ind_pop_random_dd_nN); null for others."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    p = lambda i: F.when(stem.startswith("adx_"), F.get(F.split(stem, "_"), F.lit(i)))
    tail = lambda i: F.substring(p(i), F.lit(2), F.length(p(i)))
    return files.withColumns({
        "gnn_type": p(0), "gnn_k": tail(1).try_cast("int"), "gnn_thresh": F.concat(F.lit("0."), tail(2)).try_cast("double"), "gnn_nodes": tail(3),
        "gnn_has_ind_pairs": p(4), "gnn_has_pop_pairs": p(5), "gnn_is_randomized": p(6), "gnn_discrim": p(7) == "dd", "gnn_num_neighbours": tail(8).try_cast("int"),
    })


#: The factors of a tree file's path, level by level.
TREE_LEVELS = {
    "ancestry": ["est", "maj", "rule"],
    "subset": ["Aaa", "Aaa_in", "all", "apac", "apac_in"],
    "missing": ["m10", "m25"],
    "imputed": ["impute", "miss"],
    "initdate": ["nodate", "date_rule", "rep_date"],
    "program": ["relate", "singer", "tsinfer"],
}


def tree_factors(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with the factors below the folder tree_inference, 'undefined' if unknown, and ``params`` ('default' if no folder names them)."""
    below = F.split(F.regexp_extract(path, r"(?:^|/)tree_inference/(.*)/[^/]*$", 1), "/")
    part = lambda i: F.get(below, F.lit(i))
    cols = {n: F.when(part(i).isin(a), part(i)).otherwise("undefined") for i, (n, a) in enumerate(TREE_LEVELS.items())}
    return files.withColumns(cols | {"params": F.coalesce(part(len(TREE_LEVELS)), F.lit("default"))})
