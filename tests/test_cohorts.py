import gzip

import pytest
from pyspark.sql import functions as F

from helixframe.operators import ancestry as A
from helixframe.operators import cohorts as H
from helixframe.operators import windows as W
from helixframe.sources import chunks as K
from helixframe.sources import tables as T

SITES = "pos long, ref string, alt array<string>, gt array<struct<a0: int, a1: int, phased: boolean>>, out1 string, out2 string, aa string, p double"


def site(pos, ref, alt, calls, out1="A", out2="N", aa=None, p=None):
    return pos, ref, alt, [(a, b, True) for a, b in calls], out1, out2, aa, p


@pytest.fixture(scope="module")
def some(spark):
    rows = [
        site(1, "A", [], [(0, 0), (0, 0)], p=0.99),
        site(2, "A", ["C"], [(0, 0), (0, 0), (0, 1), (1, 1)], p=0.99),
        site(3, "A", ["C"], [(1, 1), (1, 1), (-1, 1)], "N", "C", p=0.99),
        site(4, "A", ["C"], [(0, 1), (1, 1)], "G", "T", p=0.01),
        site(5, "A", ["C"], [(0, 1), (1, 1)], "N", None, p=0.5),
        site(6, "A", ["C", "G"], [(1, 2), (2, 2)], p=0.99),
        site(7, "AT", ["A"], [(0, 1), (1, 1)], p=None),
        site(8, "A", ["*"], [], "a", "N", p=None),
    ]
    return spark.createDataFrame(rows, SITES).withColumn("chrom", F.lit("c")).cache()


def test_ancestral_by_probability(some):
    got = {r.pos: (r.reason, r.aa, r.against) for r in A.ancestral_by_probability(some).collect()}
    assert got == {1: ("mono", None, False), 2: ("unflipped", "A", False), 3: ("flipped", "C", False), 4: ("unflipped", "A", True), 5: ("ambiguous", None, False), 6: ("multi", None, False), 7: ("ambiguous", None, False), 8: ("mono", None, False)}


def test_outgroup_lines(some):
    got = A.outgroup_lines(some)
    rows = {r.pos: r for r in got.collect()}
    assert {k: r.reason for k, r in rows.items()} == {1: None, 2: None, 3: None, 4: "orthogonal", 5: "missing", 6: "multi", 7: "nonsnp", 8: None}
    assert rows[2].line == "5,3,0,0\t1,0,0,0\t0,0,0,0" and rows[3].line == "0,4,0,0\t0,0,0,0\t0,1,0,0" and rows[8].line == "0,0,0,0\t1,0,0,0\t0,0,0,0"
    assert (rows[2].minor1, rows[2].minor2, rows[4].minor1) == (False, True, None)
    one = A.outgroup_report(got).first()
    assert (one.missing, one.multi, one.orthogonal, one.mono, one.minority1, one.majority1) == (1, 1, 1, 2, 1, 3)
    assert A.outgroup_report(got.limit(0)).first().missing == 0


def test_agreement_and_copies(spark, some):
    s = some.where("pos in (1, 6)").withColumn("gt", F.when(F.col("pos") == 6, F.expr("array(struct(0 as a0, 1 as a1, true as phased), struct(2 as a0, 2 as a1, true as phased))")).otherwise(F.col("gt")))
    r = A.agreement(s.withColumn("aa", F.when(F.col("pos") == 6, "G").otherwise("T"))).first()
    assert (r.ref, r.alt, r.major, r.minor, r.outgroup, r.no_outgroup, r.mono_other, r.ambiguous) == (0, 1, 1, 0, 0, 1, 1, 0)
    assert A.agreement(s).first().ambiguous == 1
    t = some.withColumn("aa", F.col("pos").cast("string"))
    assert {r.pos: r.aa for r in A.copy_ancestral(some, t).collect()} == {k: str(k) for k in range(1, 9)}
    with pytest.raises(Exception, match="only one table has c:3"):
        A.copy_ancestral(some, t.where("pos <> 3")).collect()
    with pytest.raises(Exception, match="no allele of the site: G"):
        some.select(A.ancestral_is_ref(F.lit("G"))).collect()


def test_groups_and_nodes(spark):
    meta = spark.createDataFrame([(0, "a", "y"), (1, "b", "x"), (2, "c", "y"), (3, "d", None)], "ix int, id string, pop_short string")
    got = {r.value: (r.members, r.place) for r in H.groups(meta, "pop_short").collect()}
    assert got == {"y": ([0, 2], 0), "x": ([1], 1), None: ([3], 2)}
    assert {r.value: r.place for r in H.groups(meta, "pop_short", ["x", "y", "x"]).collect()} == {"x": 0, "y": 1}
    assert sorted(r.node for r in H.nodes(meta, "pop_short", "y").collect()) == [0, 1, 4, 5]
    assert all(r.node // 2 == r.ix for r in H.one_node(meta).collect()) and H.members(meta, "id").count() == 4
    assert H.subsample(meta, 9, "id").count() == 4 and H.subsample(meta.limit(0), 2, "id").count() == 0
    labels = H.poplabels(spark.createDataFrame([(0, "b")], "ord int, id string"), meta)
    assert labels.first().line == "b x x NA"
    with pytest.raises(Exception, match="no metadata of zz"):
        H.poplabels(spark.createDataFrame([(0, "zz")], "ord int, id string"), meta).collect()
    assert {r.value: r.nodes for r in H.chosen_nodes(meta, "pop_short", 2).collect()}["y"] == "0,1,4,5"
    assert meta.agg(F.count("*").alias("n"), F.max("ix").alias("top")).select(H.report_line(meta.agg(F.count("*").alias("n"), F.max("ix").alias("top")))).first()[0] == "n: 4\ntop: 3"


HEAD = "##fileformat=VCFv4.2\n##contig=<ID=NC_1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\n"


def test_chunk_files(spark, tmp_path):
    for a, b in ((1, 100), (101, 200), (201, 250)):
        rows = "".join(f"c\t{p}\t.\tA\tC\t.\t.\t.\tGT\t0/1\n" for p in range(a, b + 1, 33))
        (tmp_path / f"x_c_{a}-{b}_y.vcf.gz").write_bytes(gzip.compress((HEAD + rows).encode()))
    every = [p for a, b in ((1, 100), (101, 200), (201, 250)) for p in range(a, b + 1, 33)]
    pos = lambda df: sorted(r.pos for r in df.select("pos").collect())
    assert pos(K.read_range(spark, str(tmp_path), "c", 100, 210, 250, 100, "x_", "_y")) == [p for p in every if 100 <= p <= 210]
    assert pos(K.read_range(spark, str(tmp_path), "c", 90, 100, 250, 100, "x_", "_y")) == [100]
    s = K.gather(spark, str(tmp_path), "c", 250, 100, "x_", "_y")
    assert pos(s) == every
    K.write_binned(s, str(tmp_path / "t"), 50)
    assert pos(K.region(spark, str(tmp_path / "t"), "c:60-140")) == [p for p in every if 60 <= p <= 140]
    assert pos(K.region(spark, str(tmp_path / "t"), "c")) == every and pos(K.region(spark, str(tmp_path / "t"), "d")) == []
    assert "PartitionFilters: [isnotnull(chrom" in K.region(spark, str(tmp_path / "t"), "c:60-140")._jdf.queryExecution().toString()


def test_arms():
    assert K.arm(0) == (0, 150_000_000) and K.arm(1, "right") == (232_000_000, 474_000_000) and K.arm(2, "centromere") == (196_000_000, 201_000_000)
    for bad in (("middle", 1_000_000), ("left", 10**9)):
        with pytest.raises(ValueError):
            K.arm(0, *bad)


def test_other_files(spark, tmp_path):
    with gzip.open(tmp_path / "e.gz", "wt") as f:
        f.write("1 2 0.5 0.25 MIG 0.1 NA\n3 4 0.5 1 NOT_MIG NA NA\n")
    with gzip.open(tmp_path / "v.gz", "wt") as f:
        f.write("1 p NOT_ROOT MIG TIP 7 8 1 9 1 (a:1,b:2)\n")
    e, v = T.read_treemix(spark, str(tmp_path / "e.gz"), str(tmp_path / "v.gz"))
    assert [(r.pnode, r.weight, r.blank) for r in T.migrations(e).collect()] == [(1, 0.25, None)]
    assert T.migrations(v).first().subtree == "(a:1,b:2)"
    (tmp_path / "a.anc").write_text("0 head\n0 head 1\n1 77 0.9 0.1\n2 78 0.25 0.5\n")
    assert sorted(map(tuple, T.read_probabilities(spark, str(tmp_path / "a.anc")).collect())) == [(1, 0.9), (2, 0.25)]
    (tmp_path / "s.state").write_text("# x\nNode\tSite\tState\nNode1\t1\tA\nNode2\t1\tC\nNode1\t2\tG\n")
    assert sorted(map(tuple, T.read_states(spark, str(tmp_path / "s.state")).collect())) == [(1, "A"), (2, "G")]
    gff = "#c\nk\ts\tmRNA\t1\t9\t.\t+\t.\tgene=G1\nk\ts\tgene\t1\t9\t.\t+\t.\tID=x;gene=\"G1\"\nk\ts\texon\t1\t4\t.\t+\t.\tgene=G1\nk\ts\texon\t5\t9\t.\t+\t.\tgene=G2\n"
    (tmp_path / "g.gff").write_text(gff)
    g = T.read_gff(spark, str(tmp_path / "g.gff")).coalesce(1).withColumn("n", F.monotonically_increasing_id())
    assert [r.type for r in T.gene_rows(g, "G1").orderBy("n").collect()] == ["gene", "exon"] and T.gene_rows(g, "G3").count() == 0
    (tmp_path / "f.fa").write_text(">a x\nACGTACG\nTAC\n>b\nTTT\n>c\nGG\n")
    f = T.read_fasta(spark, str(tmp_path / "f.fa"), 4)
    assert [r.seq for r in T.extract_region(f, "a", 3, 9, 4).orderBy("chunk").collect()] == ["GT", "ACGT", "A"]
    lines = T.fasta_lines(T.without_contigs(f, ["b"]), 2, 4).orderBy("contig", "ord")
    assert [r.line for r in lines.collect()] == [">a", "AC", "GT", "AC", "GT", "AC", ">c", "GG"]
    with pytest.raises(ValueError):
        T.fasta_lines(f, 3, 4)


def test_global_index_and_nonrepeats(spark):
    w = spark.createDataFrame([("a", 0), ("a", 2), ("b", 1), ("c", 0)], "chrom string, win long")
    assert {(r.chrom, r.win): r.global_ix for r in W.global_index(w).collect()} == {("a", 0): 0, ("a", 2): 2, ("b", 1): 4, ("c", 0): 5}
    lengths = spark.createDataFrame([("a", 12), ("b", 3)], "chrom string, length long")
    mask = spark.createDataFrame([("a", 1, 2), ("a", 2, 5)], "chrom string, start long, end long")
    got = {r.pos: r.nonrepeat_frac for r in W.nonrepeat(lengths, mask, 4, 4).collect()}
    assert got == {3: 0.0, 7: 0.75, 11: 1.0}


def test_depth_report_and_file_list(spark, tmp_path):
    rows = [("c", w * 250 + k, [9000 if (w, i) == (3, 2) and k == 1 else 100 for i in range(5)]) for w in range(6) for k in range(1, 41)]
    s = spark.createDataFrame(rows, "chrom string, pos long, dp array<int>").withColumn("gt", F.transform("dp", lambda x: F.struct(F.lit(0).alias("a0"), F.lit(0).alias("a1"), F.lit(True).alias("phased"))))
    names = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "sample_ix int, name string")
    W.report_depths(s, names, str(tmp_path / "r"), 250, alpha=0.01, min_depth=0.0)
    high = (tmp_path / "r.windows_high").read_text().splitlines()
    assert len(high) == 2 and high[1].startswith("c:751-1000") and high[1].endswith("s2")
    assert len((tmp_path / "r.depths").read_text().splitlines()) == 31
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.trees").write_text("abc")
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in T.list_files(spark, str(tmp_path), "*.trees").collect()] == [("x.trees", 3)]
