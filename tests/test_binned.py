"""Windows in bins give what one window a chromosome gives, for any width."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.functions import site as S
from helixframe.operators import binned as B
from helixframe.operators import export as X
from helixframe.operators import joins as J
from helixframe.operators import windows as W

rng = random.Random(11)
SITES = [(c, p, k, "A", ["C"], [(rng.choice([0, 0, 1, -1]), rng.choice([0, 1]), True) for _ in range(4)], [rng.randrange(9) for _ in range(4)]) for c in ("c1", "c2", "c3") for k, p in enumerate(sorted(rng.choices(range(1, 900), k={"c1": 300, "c2": 90, "c3": 1}[c])))]
SCHEMA = "chrom string, pos long, site_ord long, ref string, alt array<string>, gt array<struct<a0:int,a1:int,phased:boolean>>, dp array<int>"


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(SITES, SCHEMA).repartition(3).cache()


def rows(df):
    return sorted(tuple(tuple(x) if isinstance(x, list) else round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("width", [1, 7, 100, 5000])
def test_site_windows(sites, width):
    every = Window.partitionBy("chrom").orderBy("pos", "site_ord", "ref")
    span = Window.partitionBy("chrom").orderBy("pos").rangeBetween(-40, 0)
    depth = S.depth().cast("double") / F.size("dp")
    want = sites.withColumns({"n": F.row_number().over(every), "m": F.percentile("pos", F.lit(0.5)).over(span), "d": F.avg(depth).over(span), "k": F.count("*").over(span)})
    got = W.slide_bp(sites, 40, bin_width=width)
    assert rows(got.select("chrom", "pos", "mid", "mean_depth", "density")) == rows(want.select("chrom", "pos", "m", "d", F.col("k") / 40 * 100))
    thin = W.slide_bp_thin(sites, 40, 3, width)
    assert rows(thin.select("chrom", "pos", "n", "mean_depth")) == rows(want.where("n % 3 = 0").select("chrom", "pos", "n", "d"))
    frame = every.rowsBetween(-11, 0)
    want = sites.withColumns({"n": F.row_number().over(every), "m": F.percentile("pos", F.lit(0.5)).over(frame), "d": F.avg(depth).over(frame)}).where("n >= 12 and n % 2 = 0")
    got = W.slide_rows(sites, 12, 2, width, block=width)
    assert rows(got.select("chrom", "pos", "n", "mid", "mean_depth")) == rows(want.select("chrom", "pos", "n", "m", "d"))


@pytest.mark.parametrize("width", [1, 7, 100, 5000])
def test_numbers_and_neighbours(sites, width):
    every = Window.partitionBy("chrom").orderBy("pos", "site_ord", "ref")
    n = sites.withColumn("n", F.row_number().over(every))
    assert rows(B.numbered(sites, S.order(sites), width).select("chrom", "pos", "site_ord", "__n")) == rows(n.select("chrom", "pos", "site_ord", "n"))
    emit = F.col("site_ord") % 4 == 1
    want = n.where(emit).withColumn("nsites", F.col("n") - F.lag("n", 1, 0).over(every))
    assert rows(W.running_counts(sites, emit, width).select("chrom", "site_ord", "nsites")) == rows(want.select("chrom", "site_ord", "nsites"))
    named = sites.withColumn("aa", F.lit("A"))
    assert rows(X.haplotypes(named, bin_width=width)) == rows(X.haplotypes(named, bin_width=10**6))
    c = named.withColumn("counts", S.counts()).withColumn("n", F.row_number().over(every)).where((S.allelicity() == 2) & F.array_contains(S.geno_alleles(), F.col("aa")))
    want = c.select("chrom", "pos", F.coalesce(F.lead("n").over(every) - F.col("n"), F.lit(1)))
    assert rows(X.haplotypes(named, bin_width=width).select("chrom", "pos", "dist")) == rows(want)


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_intervals_and_maps(spark, sites, width):
    r = random.Random(width)
    spans = [(f"c{r.randrange(3)}", a, a + r.choice([0, 1, 5, 60, 400])) for a in (r.randrange(1, 2000) for _ in range(250))]
    want = []
    for c, a, b in sorted(spans):
        if want and want[-1][0] == c and a <= want[-1][2] + 1:
            want[-1] = (c, want[-1][1], max(b, want[-1][2]))
        else:
            want.append((c, a, b))
    assert rows(J.merge_intervals(spark.createDataFrame(spans, "chrom string, start long, end long"), width).select("chrom", "start", "end")) == want
    points = [(c, p, g) for c in ("c1", "c2") for p, g in zip(sorted(r.sample(range(1, 800), 12)), sorted(r.uniform(0, 9) for _ in range(12)), strict=True)]
    frame = spark.createDataFrame(points, "chrom string, phys long, gen double")
    got = rows(J.interpolate_map(sites, frame, width).select("chrom", "site_ord", "gen", "rec"))
    want, was = [], {}
    for c, pos, k, *_ in SITES:
        own = [(0, 0.0)] + [(p, g) for d, p, g in points if d == c] if c != "c3" else []
        low, high = [x for x in own if x[0] <= pos], [x for x in own if x[0] > pos]
        gen = None if not low or not high and low[-1][0] != pos else low[-1][1] if low[-1][0] == pos else low[-1][1] + (high[0][1] - low[-1][1]) * (pos - low[-1][0]) / (high[0][0] - low[-1][0])
        before = was.get(c)
        want.append((c, k, None if gen is None else round(gen, 9), round(gen - (before or 0.0), 9) if gen is not None else 0.0))
        was[c] = gen
    assert got == sorted(want)
    rates = {(x.chrom, x.phys): x.rate for x in W.map_rates(frame, width).collect()}
    last = {}
    for c, p, g in points:
        p0, g0 = last.get(c, (0, 0.0))
        assert abs(rates[c, p] - (g - g0) / (p - p0) * 1e6) < 1e-6
        last[c] = (p, g)


def test_no_task_holds_a_chromosome(sites):
    plan = W.slide_rows(sites, 12, bin_width=100, block=50)._jdf.queryExecution().toString()
    assert "hashpartitioning(chrom" in plan and "__bin" in plan and "__at" in plan


def test_nothing(sites):
    none = sites.limit(0)
    assert W.slide_bp(none, 10).count() == 0 and W.slide_rows(none, 3).count() == 0 and W.running_counts(none, F.lit(True)).count() == 0
