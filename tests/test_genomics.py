import gzip

import pytest
from pyspark.sql import functions as F

from helixframe.functions import site as S
from helixframe.operators import export as X
from helixframe.operators import joins as J
from helixframe.operators import sites as U
from helixframe.operators import trees as TR
from helixframe.operators import windows as W
from helixframe.sources import tables as T
from helixframe.sources import vcf as V
from helixframe.streaming import depth

VCF = """##fileformat=VCFv4.2
##INFO=<ID=AA,Number=1,Type=String>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3
c1\t10\t.\tA\tC\t5\tPASS\tAA=A\tGT:DP:AD:PL\t0/0:5:5,0:0,30,60\t0/1:4:2,2:30,0,60\t./.:0:0,0:0,0,0
c1\t20\trs\tA\tC,G\t.\t.\t.\tGT:DP\t1|2:7\t1|1:3\t0|0:2
c1\t20\t.\tAT\tA\t.\t.\tMTS\tGT:DP\t0/1:9\t0/0:9\t0/0:.
"""


@pytest.fixture(scope="module")
def sites(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("v") / "a.vcf.gz"
    p.write_bytes(gzip.compress(VCF.encode()))
    return V.read_vcf(spark, str(p)).cache()


def test_vcf_reads_and_writes_back(spark, sites, tmp_path):
    rows = sites.orderBy("site_ord").collect()
    assert [r.pos for r in rows] == [10, 20, 20] and rows[1].alt == ["C", "G"]
    assert rows[0].gt[2].a0 == -1 and rows[0].pl[1] == [30.0, 0.0, 60.0] and rows[2].dp[2] is None
    assert rows[0].info["AA"] == "A" and "MTS" in rows[2].info
    V.write_vcf(sites, VCF.splitlines()[:3], str(tmp_path / "b.vcf.gz"))
    again = V.read_vcf(spark, str(tmp_path / "b.vcf.gz"))
    assert [(r.pos, r.gt) for r in again.orderBy("site_ord").collect()] == [(r.pos, r.gt) for r in rows]
    assert gzip.decompress((tmp_path / "b.vcf.gz").read_bytes()).decode().startswith("##fileformat")
    full = [(r.pos, r.gt, r.dp, r.ad, r.pl) for r in again.orderBy("site_ord").collect()]
    assert full == [(r.pos, r.gt, r.dp, r.ad, r.pl) for r in rows] and full[0][3] == [[5, 0], [2, 2], [0, 0]]
    head = V.header_lines(V.parse_header([VCF.splitlines()[1], VCF.splitlines()[0]]), ["s1"])
    assert [x.split("=")[0] for x in head[:2]] == ["##fileformat", "##INFO"] and head[2].endswith("FORMAT\ts1")
    assert V.check_samples(["s1", "s2"], ["s2"]) == [1]
    with pytest.raises(ValueError):
        V.check_samples(["s1"], ["s9"])
    assert V.samples(VCF.splitlines()[:3]) == ["s1", "s2", "s3"]
    with pytest.raises(ValueError):
        V.parse_header(["##INFO=<ID=A>", "##INFO=<ID=A>"], "throw")


def test_site_expressions_on_ties(spark):
    df = spark.createDataFrame([([5, 5],), ([0, 4, 4],), ([0, 0],)], "counts array<int>")
    assert [tuple(r) for r in df.select(S.major(), S.second(), S.minor(), S.allelicity()).collect()] == [(0, 1, 0, 2), (1, 2, 1, 2), (None, None, None, 0)]


def test_lists_of_rules(sites):
    s = sites.withColumn("counts", S.counts()).orderBy("site_ord")
    assert [r[0] for r in s.select(S.passes_filter()).collect()] == [True, False, False]
    assert [r[0] for r in s.select(S.passes_filter(multi=True, nonsnp=True, badref=True)).collect()] == [True, True, True]


def test_likelihoods(spark):
    df = spark.createDataFrame([([0.0, 30.0, 60.0],), ([0.0, None, 3.0],), (None,)], "pl array<double>")
    got = [r[0] for r in df.select(F.transform(S.likelihoods(F.col("pl")), lambda x: F.round(x, 4))).collect()]
    assert got[0] == [0.999, 0.001, 0.0] and got[1] == [0.3333] * 3


def test_masks(spark):
    m = spark.createDataFrame([("q", 11, 40), ("q", 35, 70), ("q", 300, 310), ("r", 5, 9), ("x", 1, 5), ("x", 6, 7), ("x", 9, 20), ("x", 10, 11), ("x", 21, 22), ("x", 30, 31)], "chrom string, start long, end long")
    merged = {tuple(r) for r in J.merge_intervals(m).collect()}
    assert merged == {("q", 11, 70), ("q", 300, 310), ("r", 5, 9), ("x", 1, 7), ("x", 9, 22), ("x", 30, 31)}
    assert {tuple(r) for r in J.merge_intervals(J.merge_intervals(m)).collect()} == merged
    p = spark.createDataFrame([("q", 299), ("q", 310), ("r", 4)], "chrom string, pos long")
    assert [r.pos for r in J.in_intervals(p, m, 64).collect()] == [310]
    spans = spark.createDataFrame([("q", 60, 80), ("q", 20, 100), ("q", 80, 90)], "chrom string, start long, end long")
    got = {r.start: (r.covered, r.overlaps) for r in J.span_cover(spans, m, 64).collect()}
    assert got == {60: (11, True), 20: (51, True), 80: (0, False)}


def test_compare_pairs_duplicates_in_order(spark):
    a = spark.createDataFrame([("c", 1, 1), ("c", 1, 2), ("c", 3, 3)], "chrom string, pos long, k long")
    b = spark.createDataFrame([("c", 1, 9), ("c", 4, 8)], "chrom string, pos long, k long")
    n = {m: J.compare(a, b, m, ["k"]).count() for m in ("intersect", "left", "right", "all", "exclude")}
    assert n == {"intersect": 1, "left": 3, "right": 2, "all": 4, "exclude": 3}


def test_mappability(spark):
    df = spark.createDataFrame([("CANCCA", 13)], "s string, n int")
    assert df.select(X.compress(F.col("s"), 2)).first()[0] == "CNC"
    assert df.select(X.decompress(F.lit("CA"), 5, F.col("n"))).first()[0] == "CCCAAAAANNNNN"
    m = spark.createDataFrame([("x", 1, c) for c in "CCCA"] + [("x", 2, c) for c in "CAAN"] + [("x", 3, c) for c in "CANN"], "contig string, pos int, code string")
    assert {r.pos: r.code for r in X.consensus(m, 0.75, 4).collect()} == {1: "C", 2: "A", 3: "N"}


def test_updates(sites):
    rare = U.lowcount_to_miss(sites, 1).orderBy("site_ord").collect()
    assert rare[0].changed and rare[0].gt[1].a1 == -1
    p = U.polarise(sites.where("pos = 10").withColumn("aa", F.lit("C"))).first()
    assert p.ref == "C" and p.gt[0].a0 == 1
    assert U.polarise(sites.withColumn("aa", F.lit(None).cast("string"))).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "m.bed").write_text("track x\nc1\t0\t10\n#c\nc2\t5\t6\n")
    assert [tuple(r) for r in T.read_bed(spark, str(tmp_path / "m.bed")).collect()] == [("c1", 1, 10), ("c2", 6, 6)]
    (tmp_path / "m.gff").write_text("#x\nc1\tRepeatMasker\tr\t5\t9\t.\t+\t.\tgene=a;k=v\nshort\tline\n")
    g = T.read_gff(spark, str(tmp_path / "m.gff")).collect()
    assert len(g) == 1 and g[0].attributes["gene"] == "a" and T.gff_mask(spark, str(tmp_path / "m.gff")).count() == 1
    (tmp_path / "f.fa").write_text(">c1 x\nacgt\nacgt\n>c2\nTT\n")
    fa = T.read_fasta(spark, str(tmp_path / "f.fa"), 3)
    p = spark.createDataFrame([("c1", 5), ("c1", 9), ("c2", 2)], "chrom string, pos long")
    assert {(r.chrom, r.pos): r.b for r in T.base_at(p, fa, "b", 3).collect()} == {("c1", 5): "A", ("c1", 9): None, ("c2", 2): "T"}
    (tmp_path / "g.map").write_text("set map mkr phys gen\ns 1 m1 100 0.5\ns 1 m2 200 1.0\nbad line\ns 1 m3 300 2\n")
    assert T.read_map(spark, str(tmp_path / "g.map")).count() == 2
    (tmp_path / "r.txt").write_text("i l r a b c\n0 0 1.5 1 2 3\n1 1.5 inf 4 5 6\n")
    assert [r.lambdas for r in T.read_msmc(spark, str(tmp_path / "r.txt")).collect()] == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]
    df = spark.createDataFrame([("((b:1,a:2):0.1,c:3);",)], "n string")
    assert df.select(T.leaves(F.col("n"))).first()[0] == ["a", "b", "c"]


def test_streamed_depth_equals_batch(spark, sites, tmp_path):
    s = sites.select("chrom", "pos", "gt", "dp")
    s.repartition(2).write.parquet(str(tmp_path / "in"))
    q = depth.start(depth.depth_by_window(spark.readStream.schema(s.schema).parquet(str(tmp_path / "in")), 10), "depths", str(tmp_path / "c"))
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.sql("select * from depths").collect())) == sorted(map(tuple, W.window_depth(s, 10).collect()))


def site(gt, ref="A", alt=("C",), **more):
    return {"chrom": "c", "pos": 1, "ref": ref, "alt": list(alt), "gt": [(a, b, False) for a, b in gt], **more}


SITE = "chrom string, pos long, ref string, alt array<string>, gt array<struct<a0:int,a1:int,phased:boolean>>, dp array<int>, ad array<array<int>>, pl array<array<double>>, aa string"


def test_depths_and_likelihoods_follow_the_alleles(spark):
    rows = [site([(0, 1), (1, 1)], dp=[3, 4], ad=[[2, 1], [0, 4]], pl=[[10.0, 0.0, 20.0], [30.0, 5.0, 0.0]], aa="C")]
    df = spark.createDataFrame(rows, SITE)
    for out in (U.polarise(df), U.flip(df)):
        r = out.first()
        assert (r.ref, r.alt, r.ad, r.pl) == ("C", ["A"], [[1, 2], [4, 0]], [[20.0, 0.0, 10.0], [0.0, 5.0, 30.0]])
    three = spark.createDataFrame([site([(0, 2)], alt=("C", "G"), dp=[3], ad=[[2, 1, 9]], pl=[[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]], aa="C")], SITE)
    r = U.polarise(three).first()
    # 00 01 11 02 12 22 becomes 11 01 00 12 02 22
    assert (r.alt, r.ad, r.pl, r.gt[0].a0) == (["A", "G"], [[1, 2, 9]], [[3.0, 2.0, 1.0, 5.0, 4.0, 6.0]], 1)
    r = U.lowcount_to_miss(three, 1).first()
    assert r.ad == [[0, 1, 0]] and r.gt[0].a0 == -1 == r.gt[0].a1


def test_quick_filter_of_rescued_sites(spark):
    two = [(0, 0), (0, 1), (1, 1)]
    rows = [site([*two, (2, 0)], alt=("C", "G"), aa=None), site([*two, (2, 2)], alt=("C", "G"), aa="A"), site([(0, 0), (2, 1), (-1, -1), (0, 1)], alt=("C", "G"), aa="A"), site([(0, 0), (-1, 2), (-1, -1), (1, 1)], alt=("C", "G"), aa="A"), site(two, aa="T")]
    df = spark.createDataFrame([{**r, "pos": k, "dp": None, "ad": None, "pl": None} for k, r in enumerate(rows)], SITE)
    got = {r.pos: r for r in U.quick_filter(df, most_missing=0.45).collect()}
    assert [got[k].reason for k in range(5)] == [None, "nonallelic", None, "missing", "nonancestral"]
    assert [got[k].rescued for k in range(5)] == [True, False, True, True, False]
    assert got[0].gt[3].a0 == -1 and got[0].gt[3].a1 == 0


def test_map_over_many_sites_of_one_chromosome(spark):
    """One growing window: tens of thousands of sites of one chromosome."""
    sites = spark.range(1, 40_001).selectExpr("'c' as chrom", "id as pos")
    points = spark.range(1, 30).selectExpr("'c' as chrom", "id * 1000 as phys", "cast(id as double) as gen")
    out = J.interpolate_map(sites, points).agg(F.count("gen"), F.max("gen"), F.sum(F.abs(F.col("gen") - F.col("pos") / 1000))).first()
    assert out[0] == 29_000 and out[1] == 29.0 and out[2] < 1e-6


def test_spans_are_those_of_trees(spark):
    edges = spark.createDataFrame([(0.0, 30.0, 9, 1), (0.0, 10.0, 8, 2), (10.0, 30.0, 9, 2)], "left double, right double, parent long, child long")
    assert {tuple(r) for r in TR.span_histogram(edges).collect()} == {(10, 1), (20, 1)}
    for width in (3.0, 1000.0):
        assert {tuple(r) for r in TR.trees_of(edges, width).collect()} == {(0.0, 10.0), (10.0, 30.0)}
    mask = spark.createDataFrame([(0.0, 10.0, 0), (10.0, 30.0, 1)], "left double, right double, mask int")
    assert {r.node for r in TR.used_nodes(edges, mask).collect()} == {9, 1, 2} and {r.node for r in TR.used_nodes(edges, mask, True).collect()} == {9, 8, 1, 2}


def test_open_interval_takes_last_rates(spark):
    inf = float("inf")
    pop = lambda rows: spark.createDataFrame(rows, "t_ix int, t_left double, t_right double, lam double")
    got = {r.t_ix: r.rccr for r in TR.cross_coalescence(pop([(0, 0.0, 10.0, 1.0), (1, 10.0, inf, 3.0)]), pop([(0, 0.0, 50.0, 2.0), (1, 50.0, inf, 8.0)]), pop([(0, 0.0, inf, 4.0)])).collect()}
    assert got == {0: 2 / 6, 1: 6 / 12}


def test_outlier_files(spark, tmp_path):
    rows = [("c", w, i, 1000 if (w, i) != (3, 2) else 9000, 100) for w in range(6) for i in range(5)]
    wins = spark.createDataFrame(rows, "chrom string, win long, sample_ix int, depth_sum long, sites long")
    report = W.depth_outliers(wins, alpha=0.01, min_depth=0.0, width=250)
    W.write_outliers(report, spark.createDataFrame([(i, f"s{i}") for i in range(5)], "sample_ix int, name string"), str(tmp_path / "o"))
    high = (tmp_path / "o.windows_high").read_text().splitlines()
    assert len(high) == 2 and high[1].startswith("c:751-1000\t751\t0.20\t0.20") and high[1].endswith("\ts2")
    assert len((tmp_path / "o.windows_low").read_text().splitlines()) == 1
    W.write_tsv(wins, str(tmp_path / "d.tsv"), ["win", "sample_ix"])
    assert (tmp_path / "d.tsv").read_text().splitlines()[1] == "c\t0\t0\t1000\t100"
