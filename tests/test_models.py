import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import count_models as C
from helixframe.operators import genealogy as G
from helixframe.operators import thinning as Z


def test_poisson_and_nb_tails_against_sums():
    for lam in (0.3, 4.0, 60.0, 900.0):
        for k in (0, 1, 5, 60, 850, 1000):
            pm = [math.exp(i * math.log(lam) - lam - math.lgamma(i + 1)) for i in range(k + 1)]
            low, high = C.poisson_tails(np.array([float(k)]), np.array([lam]))
            assert low[0] == pytest.approx(math.fsum(pm), abs=1e-10) and high[0] == pytest.approx(1 - math.fsum(pm[:-1]), abs=1e-10)
            for phi in (1e-6, 0.05, 2.0):
                r = 1 / (phi + C.EPS)
                p = r / (r + lam)
                nb = [math.exp(math.lgamma(i + r) - math.lgamma(r) - math.lgamma(i + 1) + r * math.log(p) + i * math.log1p(-p)) for i in range(k + 1)]
                low, high = C.nb_tails(np.array([float(k)]), np.array([lam]), np.array([phi]))
                assert low[0] == pytest.approx(math.fsum(nb), abs=1e-6) and high[0] == pytest.approx(1 - math.fsum(nb[:-1]), abs=1e-6)


def test_count_outliers_find_the_planted_window(spark):
    rows = [("c", w, i, 1000 + 7 * i + (w * 13 + i * 5) % 20 + (900 if w == 3 and i < 4 else 0), 50) for w in range(12) for i in range(8)]
    rows += [("c", 20, 0, None, 50), ("c", 21, 0, 5, 0)]
    df = spark.createDataFrame(rows, "chrom string, win long, sample_ix int, depth_sum long, sites long")
    for model in ("nbinom", "poisson", "normal"):
        got = C.count_outliers(df, model, alpha=1e-4).collect()
        assert [r.win for r in got if r.high_frac > 0] == [3] and got[0].high_frac == 0.5, model
    assert C.count_outliers(df.limit(0), "nbinom").count() == 0
    with pytest.raises(ValueError):
        C.count_outliers(df, "other")


def test_bins_collapse_from_the_right():
    to = C.collapse_bins([9, 9, 5, 1, 2, 7], 10, 20, 6)
    assert to[:2] == [0, 0] and to[5] == 5 and to[2:5] == [2, 2, 2]
    assert C.collapse_bins([0, 0, 1, 8], 10, 20, 6) == [0, 0, 2, 2]


def test_projection_draws_within_counts(spark):
    df = spark.createDataFrame([(1, [5, 3, 0]), (2, [1, 0, 1]), (3, None)], "id long, counts array<int>")
    make = lambda d: {r.id: r.drawn for r in C.project_counts(d, 4, "id", seed=3).collect()}
    got = make(df)
    assert sum(got[1]) == 4 and got[1][0] <= 5 and got[1][1] <= 3 and got[2] is None and got[3] is None
    assert make(df.repartition(3)) == got


def test_thinning_keeps_distances(spark):
    df = spark.createDataFrame([(c, p, "x") for c in ("a", "b") for p in range(1, 3000, 3)] + [(None, 5, "x")], "chrom string, pos long, other string")
    got = Z.thin_exponential(df, 50.0, 30.0, 200.0, seed=1)
    one = [r.pos for r in got.where("chrom = 'a'").orderBy("pos").collect()]
    assert len(one) > 10 and min(np.diff(one)) >= 30 and max(np.diff(one)) <= 206
    assert one == [r.pos for r in Z.thin_exponential(df.repartition(5), 50.0, 30.0, 200.0, seed=1).where("chrom = 'a'").orderBy("pos").collect()]


def test_maps(spark):
    df = spark.createDataFrame([("c", 1_000_000, 2.0, "m1"), ("c", 2_000_000, 100.0, "m2")], "chrom string, phys long, gen double, marker string")
    assert [r.line for r in C.map_lines(df).orderBy("phys").collect()] == ["0\t2.000\t0.00000", "1000000\t25.000\t2.00000", "2000000\t25.000\t100.00000"]
    assert C.beagle_map_lines(df).orderBy("phys").first().line == "c\tm1\t2.00000\t1000000"


@pytest.fixture(scope="module")
def trees(spark):
    """((0,1)4,(2,3)5)6 up to 10, then ((0,2)4,(1,3)5)6 up to 30."""
    rows = [(0.0, 10.0, 4, 0), (0.0, 30.0, 5, 3), (0.0, 10.0, 4, 1), (0.0, 10.0, 5, 2), (10.0, 30.0, 4, 0), (10.0, 30.0, 4, 2), (10.0, 30.0, 5, 1), (0.0, 30.0, 6, 4), (0.0, 30.0, 6, 5)]
    return spark.createDataFrame(rows, "left double, right double, parent long, child long")


def test_nearest_neighbours(spark, trees):
    sets = spark.createDataFrame([("A", 0), ("A", 1), ("B", 2), ("B", 3)], "set string, node long")
    got = {(r.node, r.set): r.gnn for r in G.nearest_neighbours(trees, sets, width=8.0).collect()}
    # node 0 is next to 1 (A) over 10 of 30, next to 2 (B) over 20
    assert got[(0, "A")] == pytest.approx(1 / 3) and got[(0, "B")] == pytest.approx(2 / 3) and got[(3, "A")] == pytest.approx(2 / 3)


def test_topology_distance(spark, trees):
    other = spark.createDataFrame([(0.0, 30.0, 4, 0), (0.0, 30.0, 4, 1), (0.0, 30.0, 5, 2), (0.0, 30.0, 5, 3), (0.0, 30.0, 6, 4), (0.0, 30.0, 6, 5)], "left double, right double, parent long, child long")
    got = {r.pos: r.kc for r in G.kc_distances(trees, other, [0, 1, 2, 3], spark.createDataFrame([(5,), (15,)], "pos int"), width=7.0).collect()}
    # two pairs lose their ancestor at depth 1, two gain one
    assert got == {5.0: 0.0, 15.0: pytest.approx(2.0)}
    mean = G.kc_sample(spark, trees, other, [0, 1, 2, 3], 0, 30, n=40, seed=2).first().kc
    assert 0 < mean < 2


def test_f3_is_unbiased_form(spark):
    df = spark.createDataFrame([("c", 1, "t", 2, 2), ("c", 1, "a", 1, 3), ("c", 1, "b", 4, 0), ("c", 2, "t", 1, 0), ("c", 2, "a", 1, 1), ("c", 2, "b", 1, 1)], "chrom string, pos long, pop string, n0 int, n1 int")
    r = G.f3(df, "t", "a", "b").first()
    assert r.sites == 1 and r.f3 == pytest.approx((0.5 - 0.75) * 0.5 - 0.25 / 3)


def test_migration_events(spark):
    assert spark.range(1).select(G.leaves(F.lit("((b:1,a:2):0.5,c);")).alias("x")).first().x == ["a", "b", "c"]
    df = spark.createDataFrame([(0, ["b", "a"], ["a"], ["c"], 0.2), (1, ["a", "b"], ["a"], ["c"], 0.4), (1, ["x"], ["y"], ["z"], 0.9)], "boot int, parent array<string>, child array<string>, source array<string>, weight double")
    got = G.migration_events(df, found=3).collect()
    assert [(r.parent, r.n, round(r.weight, 6)) for r in got] == [(["a", "b"], 2, 0.3)]


def test_paths_and_factors(spark):
    levels = {"anc": ["est", "maj"], "prog": ["relate", "singer"]}
    assert [r.path for r in G.factor_paths(spark, levels, {"prog": "singer"}).collect()] == ["est/singer", "maj/singer"]
    assert G.factor_paths(spark, levels, depth=1).count() == 2
    with pytest.raises(ValueError):
        G.factor_paths(spark, levels, {"anc": "odd"})
    df = spark.createDataFrame([("est/odd/a.txt",), ("b.txt",), ("x/adx_k4_t75_nall_i_p_r_dd_n5.tsv",), (None,)], "path string")
    got = G.path_factors(df, levels).collect()
    assert [(r.anc, r.prog) for r in got[:2]] == [("est", "NA"), ("NA", "NA")]
    g = G.gnn_file_factors(df).collect()
    assert g[2].gnn_k == 4 and g[2].gnn_thresh == 0.75 and g[2].gnn_discrim and g[2].gnn_num_neighbours == 5 and g[0].gnn_type is None
    t = spark.createDataFrame([("/d/tree_inference/est/all/m10/miss/nodate/relate/t.trees",), ("/d/tree_inference/odd/all/m10/miss/nodate/singer/p9/t.trees",)], "path string")
    t = G.tree_factors(t).collect()
    assert (t[0].ancestry, t[0].params, t[1].ancestry, t[1].program, t[1].params) == ("est", "default", "undefined", "singer", "p9")
