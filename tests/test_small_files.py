"""Readers of small files, rows by their number, merged imputation, lines of likelihoods and counts."""

import pytest
from pyspark.sql import functions as F

from helixframe.functions import site as S
from helixframe.operators import export as X
from helixframe.operators import imputation as I
from helixframe.operators import joins as J
from helixframe.operators import sites as U
from helixframe.sources import tables as T

GT = "array<struct<a0:int,a1:int,phased:boolean>>"


def test_readers(spark, tmp_path):
    (tmp_path / "r.out").write_text("   SW  perc\nscore  div\n\n  463   1.3  0.6  1.7  c1  10 90 (5) + (T)n Simple\n  20 1 1 1 c2 5 6 (0) C x y\n")
    assert sorted(map(tuple, T.read_repeatmasker(spark, str(tmp_path / "r.out")).collect())) == [("c1", 10, 90), ("c2", 5, 6)]
    (tmp_path / "p.tsv").write_text("s1\tnorth\ns2\tsouth\n\n")
    assert sorted(map(tuple, T.read_popfile(spark, str(tmp_path / "p.tsv")).collect())) == [("s1", "north"), ("s2", "south")]
    (tmp_path / "l.txt").write_text("#note\n12\n7\n12\n")
    assert sorted(r.value for r in T.read_list(spark, str(tmp_path / "l.txt"), number=True).collect()) == [7, 12]
    (tmp_path / "n.txt").write_text("a-b\nc \n")
    assert sorted(r.value for r in T.read_list(spark, str(tmp_path / "n.txt")).collect()) == ["a_b", "c"]


def test_rows_meet_by_number(spark):
    left = spark.createDataFrame([("x", 5), ("x", 3), ("y", 1)], "g string, a int")
    right = spark.createDataFrame([("x", 3, "first"), ("x", 9, "second"), ("z", 1, "none")], "g string, b int, w string")
    out = J.ordinal_join(left.withColumn("o", F.col("a")), right.withColumn("o", F.col("b")), ["g"], ["o"])
    assert sorted((r.g, r.ord, r.a, r.w) for r in out.collect()) == [("x", 1, 3, "first"), ("x", 2, 5, "second")]


def test_lines_of_sites(spark):
    schema = f"chrom string, pos long, id string, ref string, alt array<string>, gt {GT}, ad array<array<int>>, pl array<array<double>>"
    rows = [("c", 7, None, "A", ["C"], [(0, 1, True), (1, 1, True)], [[3, 4], [0, 9]], [[0.0, 10.0, 20.0], [None, 1.0, 2.0]]), ("c", 8, "i", "G", ["T", "A"], [(0, 0, True), (0, 1, True)], [[1, 2, 3], [0, 0, 0]], [[0.0], [0.0]])]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in df.orderBy("pos").select(S.depths_from_alleles()).collect()] == [[7, 9], [6, 0]]
    assert [r[0] for r in df.orderBy("pos").select(S.trimmed()).collect()] == ["c\t7\t.\tA\tC", "c\t8\ti\tG\tT,A"]
    out = X.beagle(df).collect()
    assert [(r.marker, r.alleleA, r.alleleB) for r in out] == [("c_7", "A", "C")]
    assert out[0].likelihoods == pytest.approx([0.9009, 0.0901, 0.009, 0.3333, 0.3333, 0.3333])
    counts = spark.createDataFrame([("c", 1, "q", 3, 1), ("c", 1, "p", 0, 4), ("c", 2, "p", 2, 2)], "chrom string, pos long, pop string, n0 int, n1 int")
    assert sorted((r.pos, r.line) for r in X.treemix(counts).collect()) == [(1, "0,4 3,1"), (2, "2,2")]


def test_a_site_of_one_table_is_an_error(spark):
    schema = f"chrom string, pos long, ref string, alt array<string>, gt {GT}"
    site = lambda p, *gt: ("c", p, "A", ["C"], list(gt))
    template = spark.createDataFrame([site(1, (-1, -1, False), (0, 1, False)), site(2, (0, 0, False), (0, 0, False))], schema)
    imputed = spark.createDataFrame([site(1, (1, 1, True), (1, 0, True)), site(2, (0, 0, True), (0, 0, True))], schema)
    got = {r.pos: [tuple(g) for g in r.gt] for r in I.restore_missing(template, imputed, ["ref"]).collect()}
    assert got == {1: [(-1, -1, True), (1, 0, True)], 2: [(0, 0, True), (0, 0, True)]}
    for a, b in ((template, imputed.where("pos = 1")), (template.where("pos = 2"), imputed)):
        with pytest.raises(Exception, match="only one table has c:"):
            I.restore_missing(a, b, ["ref"]).collect()


def test_shallow_and_flat_calls_go(spark):
    rows = [([(0, 1, True)] * 5, [9, 2, 9, None, 9], [[0.0, 3.0, 9.0], [0.0, 3.0, 9.0], [0.0, 0.0, 0.0], [0.0, 3.0, 9.0], None])]
    df = spark.createDataFrame(rows, f"gt {GT}, dp array<int>, pl array<array<double>>")
    assert [g.a0 for g in U.depth_to_miss(df, 3).first().gt] == [0, -1, -1, -1, 0]
    assert [g.a0 for g in U.depth_to_miss(df.drop("pl"), 3).first().gt] == [0, -1, 0, -1, 0]
