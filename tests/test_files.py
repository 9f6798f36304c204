"""BGZF in splits, single files from many tasks."""

import gzip
import random
import struct
import subprocess
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helixframe.operators import sites as U
from helixframe.sources import bgzf, sinks
from helixframe.sources import tables as T
from helixframe.sources import vcf as V


def stored(data: bytes) -> bytes:
    """A block whose bytes are not compressed, so what looks like a header inside it stands there as it is."""
    z = zlib.compressobj(0, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return bgzf.HEAD + bgzf.MARK + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def lines_of(kind: str) -> list[bytes]:
    rng = random.Random(kind)
    if kind == "plain":
        return [f"line {i} {rng.random()}".encode() for i in range(6000)]
    if kind == "long":  # lines over many blocks and splits
        return [bytes(rng.choices(b"ACGT\t", k=rng.choice([3, 50, 40_000, 300_000]))) for _ in range(60)]
    if kind == "marks":  # headers inside blocks
        return [b"x" * rng.randrange(400) + (b"head" + bgzf.MARK) * rng.randrange(3) + bgzf.MARK * rng.randrange(2) + b"y" for _ in range(900)]
    return []


@pytest.fixture
def split_at(spark):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@pytest.mark.parametrize(("kind", "ending"), [("plain", b"\n"), ("plain", b""), ("long", b""), ("marks", b"\n"), ("empty", b"")])
def test_lines_whatever_the_splits(spark, tmp_path, split_at, kind, ending):
    want, rng = lines_of(kind), random.Random(3)
    data = b"\n".join(want) + (ending if want else b"")
    blocks, at = [], 0
    while at < len(data):
        n = rng.choice([1, 70, 3000, bgzf.BLOCK])
        blocks.append((stored if kind == "marks" else bgzf.pack)(data[at : at + n]))
        at += n
        if rng.random() < 0.05:
            blocks.append(bgzf.pack(b""))
    raw = b"".join(blocks) + bgzf.END
    (tmp_path / "a.txt.gz").write_bytes(raw)
    assert gzip.decompress(raw) == data
    path = str(tmp_path / "a.txt.gz")
    assert bgzf.is_bgzf(spark, path)
    for size in (len(raw) // 3 + 1, max(len(raw) // 40, 40)):
        split_at(size)
        got = bgzf.read_lines(spark, path).orderBy("ord").collect()
        assert [r.line.encode() for r in got] == want, size
        assert len({r.ord for r in got}) == len(want)
        if want and size < len(raw) // 2:
            assert bgzf.raw_records(spark, path).rdd.getNumPartitions() > 2
    # an order is where the line starts: block and place in it
    for r in rng.sample(got, min(len(got), 20)):
        block = raw[r.ord >> 16 :]
        assert gzip.decompress(block)[r.ord & 0xFFFF :].startswith(r.line.encode())


def test_not_bgzf_and_broken(spark, tmp_path):
    (tmp_path / "g.gz").write_bytes(gzip.compress(b"a\n"))
    assert not bgzf.is_bgzf(spark, str(tmp_path / "g.gz")) and not bgzf.is_bgzf(spark, str(tmp_path / "none.gz"))
    (tmp_path / "b.gz").write_bytes(bgzf.pack(b"a\nb\n" * 9)[:-7])
    with pytest.raises(Exception, match="ends within a block"):
        bgzf.read_lines(spark, str(tmp_path / "b.gz")).collect()


def test_a_region_reads_its_blocks_only(spark, tmp_path):
    rows = [f"c{k // 400}\t{k % 400 * 10 + 1}\t{'x' * (k % 90)}" for k in range(1200)]
    data = "".join(f"{r}\n" for r in ["#head", *rows]).encode()
    raw = b"".join(bgzf.pack(data[at : at + 700]) for at in range(0, len(data), 700)) + bgzf.END
    path, index = str(tmp_path / "r.gz"), str(tmp_path / "index")
    Path(path).write_bytes(raw)
    bgzf.write_index(spark, path, index)
    for chrom, a, b in (("c1", 501, 1500), ("c0", 1, 1), ("c2", 3900, 9999), ("c1", 2, 9), ("c9", 1, 10)):
        want = [r for r in rows if r.split("\t")[0] == chrom and a <= int(r.split("\t")[1]) <= b]
        assert [r.line for r in bgzf.region_lines(spark, index, chrom, a, b).orderBy("ord").collect()] == want
    assert bgzf.region_lines(spark, index, "c2").count() == 400
    # with other blocks damaged the region is read all the same
    blocks = {r.block for r in spark.read.parquet(index).where("chrom = 'c1' and pos_min <= 1500 and pos_max >= 501").collect()}
    broken = bytearray(raw)
    first = min(blocks)
    broken[30 : first - 30] = b"\xff" * (first - 60)
    Path(path).write_bytes(broken)
    assert bgzf.region_lines(spark, index, "c1", 501, 1500).count() == 100


@pytest.mark.parametrize("head", [[], ["##a", "#b" * 70_000]])
def test_one_file_whatever_the_partitions(spark, tmp_path, head):
    rng = random.Random(4)
    rows = [(k, "é" * (k % 7) + "".join(rng.choices("ACGT\t", k=rng.choice([0, 30, 200, 90_000 if k % 100 == 0 else 10])))) for k in range(2500)]
    want = "".join(f"{x}\n" for x in head + [r[1] for r in rows]).encode()
    files = set()
    for n in (1, 3, 17):
        frame = spark.createDataFrame(rows, "k long, line string").repartition(n)
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        sinks.write_lines(frame, ["k"], str(tmp_path / "o.txt.gz"), head)
        sinks.write_lines(frame, ["k"], str(tmp_path / "o.txt"), head)
        files.add((tmp_path / "o.txt.gz").read_bytes())
        assert (tmp_path / "o.txt").read_bytes() == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    blocks = b"".join(bgzf.pack(want[at : at + bgzf.BLOCK]) for at in range(0, len(want), bgzf.BLOCK))
    assert files == {blocks + bgzf.END}
    assert not list(tmp_path.glob("*.unfinished"))


def test_empty_file(spark, tmp_path):
    none = spark.createDataFrame([], "k long, line string")
    sinks.write_lines(none, ["k"], str(tmp_path / "e.gz"))
    sinks.write_lines(none, ["k"], str(tmp_path / "e.txt"), ["h"])
    assert (tmp_path / "e.gz").read_bytes() == bgzf.END and (tmp_path / "e.txt").read_text() == "h\n"


FAILING = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from helixframe.sources import sinks
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()

def once(batches):
    for b in batches:
        yield b
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")

rows = spark.range(5000).selectExpr("id as k", "concat('line ', id) as line").repartition(3).mapInArrow(once, "k long, line string")
sinks.write_lines(rows, ["k"], sys.argv[1])
"""


def test_a_failed_task_leaves_one_part(tmp_path):
    root = Path(__file__).resolve().parent.parent
    ran = subprocess.run([sys.executable, "-c", FAILING, str(tmp_path / "f.gz")], cwd=root, capture_output=True, text=True, timeout=200)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert gzip.decompress((tmp_path / "f.gz").read_bytes()).decode() == "".join(f"line {k}\n" for k in range(5000))


ROWS = [
    "c1\t10\t.\tA\tC\t50\tPASS\tZZ=1;AA=A;ZZ=2;MTS;MTS\tGT:GQ:DP:AD\t0/0:99:5:5,0\t./.:.:.:.,.\t.",
    "c1\t11\trs1\tAT\tA,*\t50.50\tq10;s5\t.\tGT:XX:PL\t0|1:a:0,30.5,60\t1|.:b\t2/2:c:1,2,3",
    "c2\t7\t.\tG\t.\t.\t.\tAF=1e-05;B=x=y\tGT\t0\t0/0\t.|.",
    "c2\t8\t.\tG\tT\t1e3\t.\tA=\tDP:GT\t7:0/1\t.:1/1\t3:./.",
]
VCF_HEAD = ["##fileformat=VCFv4.2", "##INFO=<ID=AA>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3"]


@pytest.mark.parametrize("name", ["v.vcf", "v.vcf.gz"])
def test_vcf_comes_back_byte_for_byte(spark, tmp_path, split_at, name):
    text = "".join(f"{x}\n" for x in VCF_HEAD + ROWS).encode()
    (tmp_path / name).write_bytes(text if name.endswith("vcf") else b"".join(bgzf.pack(text[a : a + 100]) for a in range(0, len(text), 100)) + bgzf.END)
    split_at(150)
    sites = V.read_vcf(spark, str(tmp_path / name)).repartition(3)
    assert V.header(spark, str(tmp_path / name)) == VCF_HEAD
    rows = {r.pos: r for r in sites.collect()}
    assert rows[10].info == {"ZZ": "1", "AA": "A", "MTS": None} and rows[7].info["B"] == "x=y" and rows[8].info == {"A": ""}
    assert rows[8].dp == [7, None, 3] and rows[11].pl[0] == [0.0, 30.5, 60.0] and rows[7].info["AF"] == "1e-05"
    V.write_vcf(sites, VCF_HEAD, str(tmp_path / "out.vcf"))
    assert (tmp_path / "out.vcf").read_bytes() == text
    # what has changed is written anew, all else as it was
    changed = sites.withColumns({"dp": F.transform("dp", lambda x: x + 1), "qual": F.col("qual") * 2, "info": F.map_concat(F.map_filter("info", lambda k, _: k != "MTS"), F.create_map(F.lit("NEW"), F.lit("n")))})
    V.write_vcf(U.select_samples(changed, [2, 0]), VCF_HEAD, str(tmp_path / "c.vcf"))
    got = (tmp_path / "c.vcf").read_text().splitlines()[3:]
    assert got[0] == "c1\t10\t.\tA\tC\t100\tPASS\tZZ=1;AA=A;ZZ=2;NEW=n\tGT:GQ:DP:AD\t.\t0/0:99:6:5,0"
    assert got[1].split("\t")[5] == "101" and got[1].endswith("GT:XX:PL\t2/2:c:1,2,3\t0|1:a:0,30.5,60")
    assert got[3] == "c2\t8\t.\tG\tT\t2000\t.\tA=;NEW=n\tDP:GT\t4:./.\t8:0/1"


def test_files_of_other_samples_are_an_error(spark, tmp_path):
    for name, last in (("a.vcf", "s3"), ("b.vcf", "s4")):
        (tmp_path / name).write_text("\n".join([*VCF_HEAD[:2], VCF_HEAD[2].replace("s3", last), ROWS[0]]) + "\n")
    with pytest.raises(ValueError, match="other samples"):
        V.read_vcf(spark, [str(tmp_path / "a.vcf"), str(tmp_path / "b.vcf")])
    assert V.read_vcf(spark, [str(tmp_path / "a.vcf")] * 2).count() == 2


def test_gff_attributes_may_repeat(spark, tmp_path):
    (tmp_path / "x.gff").write_text("##gff\nc\ts\tgene\t1\t9\t.\t+\t.\tID=a;Parent=b;Parent=c;Note\nc\ts\tgene\t1\t9\t.\t+\t.\t.\n")
    got = T.read_gff(spark, str(tmp_path / "x.gff")).collect()
    assert got[0].attributes == {"ID": "a", "Parent": "b", "Note": None} and got[1].attributes == {}
