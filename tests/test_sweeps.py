"""Trees by edge differences against each tree built from nothing."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.operators import sweeps as R
from helixframe.operators import trees as T


def random_trees(seed, n=9, length=60):
    """Edges of random binary trees over [0, length) with nodes by age: 0..n - 1 samples, then others; parents are older."""
    rng, out, open_ = random.Random(seed), [], {}
    for at in range(0, length, 4):
        if at and rng.random() < 0.3:
            continue
        tops, up = list(range(n)), {}
        while len(tops) > rng.choice([1, 1, 1, 2]):
            a, b = rng.sample(tops, 2)
            p = rng.choice([x for x in range(n + n * len(up), n + n * len(up) + n)])
            up[a] = up[b] = p
            tops = [x for x in tops if x not in (a, b)] + [p]
        for c, p in list(open_):
            if up.get(c) != p:
                out.append((float(open_.pop((c, p))), float(at), p, c))
        for c, p in up.items():
            open_.setdefault((c, p), at)
    return out + [(float(s), float(length), p, c) for (c, p), s in open_.items()]


def trees_of(edges):
    points = sorted({e[0] for e in edges} | {e[1] for e in edges})
    for lo, hi in zip(points[:-1], points[1:], strict=True):
        yield lo, hi, {c: p for a, b, p, c in edges if a <= lo and hi <= b}


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    edges = random_trees(request.param)
    return edges, spark.createDataFrame(edges, "left double, right double, parent long, child long").repartition(4).cache()


@pytest.mark.parametrize("width", [3.0, 8.0, 1000.0])
def test_counts(case, width):
    edges, frame = case
    want = {(lo, hi): (len(up), len(set(up.values())), len(set(up.values()) - set(up))) for lo, hi, up in trees_of(edges)}
    assert {(r.left, r.right): (r.n_edges, r.internal, r.roots) for r in R.tree_counts(frame, width).collect()} == want
    some = sorted(want)[::3]
    mask = frame.sparkSession.createDataFrame([(lo, hi) for lo, hi in some], "left double, right double")
    got = {tuple(r) for r in R.covered(frame, mask, width).select("left", "right", "parent", "child").collect()}
    assert got == {e for e in edges if any(e[0] <= lo and hi <= e[1] for lo, hi in some)}
    assert T.used_nodes(frame, mask.withColumn("mask", F.lit(1)), width=width).count() == len({x for e in got for x in e[2:]})


@pytest.mark.parametrize("width", [5.0, 1000.0])
def test_nearest_neighbours(spark, case, width):
    edges, frame = case
    of = {u: "AB"[u % 2] for u in range(7)}
    total, spans = defaultdict(float), defaultdict(float)
    for lo, hi, up in trees_of(edges):
        below = defaultdict(set)
        for u in of:
            at = u
            while at is not None:
                below[at].add(u)
                at = up.get(at)
        for u in range(9):
            at = u
            while at is not None and not below[at] - {u}:
                at = up.get(at)
            if at is None:
                continue
            others = below[at] - {u}
            spans[u] += hi - lo
            for s in "AB":
                total[u, s] += (hi - lo) * sum(of[x] == s for x in others) / len(others)
    sets = spark.createDataFrame([(s, u) for u, s in of.items()], "set string, node long")
    got = {(r.node, r.set): r.gnn for r in R.nearest_neighbours(frame, sets, spark.range(9).toDF("node"), width).collect()}
    assert set(got) == set(total) and all(got[k] == pytest.approx(total[k] / spans[k[0]]) for k in got)


@pytest.mark.parametrize("width", [5.0, 1000.0])
@pytest.mark.parametrize("samples", [[0, 1, 2, 3, 4, 5, 6, 7, 8], [1, 4, 6], [2], []])
def test_simplify(case, samples, width):
    edges, frame = case
    got = [tuple(r) for r in R.simplify(frame, samples, width).collect()]
    for lo, hi, up in trees_of(edges):
        lines = defaultdict(set)
        for s in samples:
            at = s
            while at in up:
                lines[up[at]].add(at)
                at = up[at]
        stay = set(samples) | {n for n, k in lines.items() if len(k) > 1}
        want = {}
        for n in stay:
            at = up.get(n)
            while at is not None and at not in stay:
                at = up.get(at)
            if at is not None:
                want[n] = at
        assert {c: p for a, b, p, c in got if a <= lo and hi <= b} == want, (lo, hi)
    # equal edges that touch are one
    assert not [(x, y) for x in got for y in got if x[1] == y[0] and x[2:] == y[2:]]


def test_rates_of_all_pairs(spark):
    inf, schema = float("inf"), "pop string, t_ix int, t_left double, t_right double, lam double"
    within = spark.createDataFrame([("a", 0, 0.0, 50.0, 2.0), ("a", 1, 50.0, inf, 8.0), ("b", 0, 0.0, inf, 4.0), ("c", 0, 0.0, 12.0, 1.0)], schema)
    joint = spark.createDataFrame([(x, y, k, lo, hi, lam) for x, y in (("a", "b"), ("b", "a"), ("a", "c")) for k, lo, hi, lam in ((0, 0.0, 10.0, 1.0), (1, 10.0, inf, 3.0), (2, 10.0, 20.0, 5.0))], "pop0 string, pop1 string, t_ix int, t_left double, t_right double, lam double")
    got = {(r.pop0, r.pop1, r.t_ix): r.rccr for r in T.cross_coalescence_pairs(joint, within).collect()}
    assert got["a", "b", 0] == 2 / 6 and got["a", "b", 1] == 6 / 12 and got["b", "a", 1] == 6 / 12
    assert got["a", "c", 0] == 2 / 3 and got["a", "c", 2] is None  # beyond all of c's intervals
    for x, y in (("a", "b"), ("b", "a")):
        one = {r.t_ix: r.rccr for r in T.cross_coalescence(joint.where((F.col("pop0") == x) & (F.col("pop1") == y)), within.where(F.col("pop") == x), within.where(F.col("pop") == y)).collect()}
        assert one == {k: got[x, y, k] for k in one}
