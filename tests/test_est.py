"""Binned ancestral runs and thinning, each against one record after another."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import site as S
from helixframe.operators import est as E
from helixframe.operators import thinning as Z

rng = random.Random(6)
SCHEMA = "key long, chrom string, pos long, ref string, alt array<string>, gt array<struct<a0:int,a1:int,phased:boolean>>, out1 string, out2 string"


def cohort(n=400, samples=15):
    out = []
    for k in range(n):
        q, miss = rng.random() ** 2, rng.random() * 0.8
        call = lambda q=q, miss=miss: -1 if rng.random() < miss else int(rng.random() < q)
        gt = [(call(), call(), True) for _ in range(samples)]
        out.append((k, f"c{rng.randrange(3)}", rng.randrange(1, 3000), rng.choice(["A", "A", "AT"]), [rng.choice(["C", "*", "G"])], gt, rng.choice(["A", "C", "N", None, "T"]), rng.choice(["A", "N", "G"])))
    return out


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(cohort(), SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("bin_width", [1, 200, 10**6])
def test_places_and_lines(sites, bin_width):
    pre = E.preprocess(sites, "key", width=4, least=8, enough=30, bin_width=bin_width).collect()
    ok = {r.key: r for r in E.eligible(sites, least=8).withColumn("an", S.an()).collect()}
    assert {r.key for r in pre} <= set(ok) and len(pre) > 80
    sizes = E.bin_sizes(E.eligible(sites, least=8), 4, 8, 30, 30)
    want, places = sorted((r for r in ok.values() if min(r.an, 30) // 4 in sizes), key=lambda r: (r.chrom, r.pos, r.ref)), {}
    got = {r.key: r for r in pre}
    assert set(got) == {r.key for r in want} and len(set(sizes.values())) > 1
    for r in want:
        own, size = got[r.key], sizes[min(r.an, 30) // 4]
        assert own.bin == size and sum(map(int, own.pop.split(","))) == size
        places.setdefault(size, []).append((r.chrom, r.pos, r.ref))
        assert all(int(n) <= c for n, c in zip([own.pop.split(",")["ACGT".index(a)] for a in [r.ref, *r.alt] if a in "ACGT"], r.counts, strict=False))
    for size, rows in places.items():
        mine = sorted((r for r in pre if r.bin == size), key=lambda r: r.ord)
        assert [r.ord for r in mine] == list(range(1, len(rows) + 1)) and [(r.chrom, r.pos, r.ref) for r in mine] == rows
    again = E.preprocess(sites.repartition(5), "key", width=4, least=8, enough=30).collect()
    assert {(r.key, r.pop) for r in again} == {(r.key, r.pop) for r in pre}


def test_results_come_back_by_place(spark, sites):
    seen = []

    def run(lines):
        seen.append(lines.count())
        return lines.select("bin", "ord", (F.col("ord") % 10 / 9.0).alias("p"))

    out = E.infer(sites, "key", run, cut=0.2, keep_ambiguous=True, width=4, least=8, enough=30).collect()
    assert seen == [len(out)] and {r.aa for r in out} >= {"A", "N"}
    for r in out:
        assert r.p == pytest.approx(r.ord % 10 / 9) and r.aap == pytest.approx(1 - r.p if r.p < 0.2 and sum(c > 0 for c in r.gt and [sum(g.a0 == k for g in r.gt) + sum(g.a1 == k for g in r.gt) for k in (0, 1)]) == 2 else r.p)
    pre = E.preprocess(sites, "key", width=4, least=8, enough=30)
    full = pre.select("bin", "ord", F.lit(0.5).alias("p"))
    with pytest.raises(Exception, match="no result for site"):
        E.gather(pre, full.where("ord > 1")).collect()
    with pytest.raises(Exception, match="no site for result"):
        E.gather(pre, full.union(spark.createDataFrame([(12, 99_999, 0.1)], "bin int, ord long, p double"))).collect()


def test_no_site_at_all(sites):
    assert E.preprocess(sites.limit(0), "key").count() == 0
    assert E.preprocess(sites, "key", least=1000).count() == 0


@pytest.mark.parametrize(("mean", "least", "most", "width"), [(40.0, 0.0, 1e9, 60), (0.5, 0.0, 3.0, 60), (0.5, 0.0, 3.0, 10**6), (300.0, 100.0, 500.0, 1)])
def test_thinning_is_the_walk(spark, mean, least, most, width):
    r = random.Random(width)
    rows = sorted({(f"c{r.randrange(3)}", r.randrange(1, 1500), r.choice("xy")) for _ in range(700)})
    frame = spark.createDataFrame(rows, "chrom string, pos long, id string").repartition(4)
    goals = frame.withColumn("goal", F.col("pos") - 1 + Z.jump(mean, least, most, 9, "chrom", "pos", "id")).orderBy("chrom", "pos", "id").collect()
    want = [rows[k] for k in Z.walk((g.chrom, g.pos, g.goal) for g in goals)]
    got = Z.thin_exponential(frame, mean, least, most, 9, ("id",), width).collect()
    assert sorted(map(tuple, got)) == want and want
