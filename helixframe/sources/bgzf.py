"""BGZF files in parallel: any byte range of one file is a task's, and a region reads its own blocks only.

A BGZF file is a chain of small gzip blocks whose headers hold the same six bytes (length and name
of an extra field). Spark's text source, told that a ``.gz`` name is not compressed and that
these six bytes end a record, cuts a file anywhere and finds the next block by itself; a
block's own size tells whether the bytes were a header or only looked like one. What a split cannot
know are the line that begins before it and the line that ends after it: a first pass over the
splits keeps those ends (few bytes a split), puts them together, and sums the splits' bytes,
so that every line gets its virtual offset, ``block offset << 16 | place in the block``, as its order.

Edge cases: blocks of any size, empty blocks, lines over many blocks or splits, bytes inside a block that look
like a header, a last line without an end, ``\\r\\n``; a file that ends within a block is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.session import Kept

# Fixed values of the format: how a header starts, the bytes that all headers hold next, and the block that ends a file.
HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"
MARK = b"\x06\0BC\x02\0"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 65_280


def pack(data: bytes) -> bytes:
    """One block of at most ``BLOCK`` bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return HEAD + MARK + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def unpack(record: bytes) -> bytes | None:
    """The text of a record (a block from its size on), or None if it is no whole block."""
    need = _need(record)
    if need is None or len(record) not in (need, need + len(HEAD)):
        return None
    try:
        text = zlib.decompress(record[2 : need - 8], -15)
    except zlib.error:
        return None
    return text if struct.unpack_from("<II", record, need - 8) == (zlib.crc32(text), len(text)) else None


def _need(record: bytes) -> int | None:
    """Bytes of a block after its sixteen fixed ones, as the block says."""
    if len(record) < 2:
        return None
    need = struct.unpack_from("<H", record)[0] + 1 - len(HEAD) - len(MARK)
    return need if need >= 12 else None


def is_bgzf(spark: SparkSession, path: str) -> bool:
    """Whether a file starts with a BGZF header."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or fs.getFileStatus(p).isDirectory():
        return False
    stream = fs.open(p)
    try:
        got = [stream.read() for _ in range(16)]
    finally:
        stream.close()
    return min(got) >= 0 and bytes(got[:4]) == HEAD[:4] and bytes(got[10:]) == MARK


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, split, value): the bytes between two marks, in file order within a split."""
    key = spark._jvm.org.apache.hadoop.io.compress.PassthroughCodec.OPT_EXTENSION
    # a name that sorts after this suffix is found to have no codec, and so can be split
    read = spark.read.option("io.compression.codecs", "org.apache.hadoop.io.compress.PassthroughCodec").option(key, "!.gz")
    rows = read.option("lineSep", MARK.decode()).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """The records of each split in a partition."""
    rows = ((p, s, v) for b in batches for p, s, v in zip(*(c.to_pylist() for c in b.columns), strict=True))
    held = next(rows, None)
    while held is not None:
        key = held[:2]

        def own() -> Iterator[bytes]:
            nonlocal held
            while held is not None and held[:2] == key:  # noqa: B023
                value, held = held[2], next(rows, None)
                yield value

        records = own()
        yield key, records
        for _ in records:  # what the caller left
            pass


def _blocks(split: int, records: Iterator[bytes]) -> Iterator[tuple[str, int, bytes]]:
    """("block", place, record) of a split; bytes before the first whole block ("orphan") and after the last one ("stub")
    belong to blocks that a mark inside them cut; last ("bytes", n, b"") tells the split's size."""
    at, held, place, whole = 0, b"", 0, split == 0
    for k, value in enumerate(records):
        here, at = at, at + len(value) + len(MARK)
        if k == 0 and split == 0:
            if len(value) != len(HEAD):
                raise ValueError("no BGZF file")
            continue
        if not held:
            place = here
        held += value
        need = _need(held)
        if need is not None and len(held) in (need, need + len(HEAD)) and (whole or unpack(held) is not None):
            yield "block", place, held
            held, whole = b"", True
        elif whole and need is not None and len(held) < need:
            held += MARK  # a block that holds the mark
        elif whole:
            raise ValueError("a damaged BGZF block")
        else:
            yield "orphan", here, value + MARK
            held = b""
    if held:
        yield "stub", place, held
    yield "bytes", at, b""


def _text(record: bytes) -> bytes:
    text = unpack(record)
    if text is None:
        raise ValueError("a damaged BGZF block")
    return text


class _Lines:
    """Cuts text into lines, each with the place (block, offset in it) where it starts."""

    def __init__(self):
        self.open, self.start = b"", (0, 0)

    def feed(self, text: bytes, block: int, at: int = 0) -> list[tuple[int, int, bytes]]:
        out, parts = [], text.split(b"\n")
        for part in parts[:-1]:
            out.append((*self.start, self.open + part) if self.open else (block, at, part))
            self.open, at = b"", at + len(part) + 1
        if parts[-1]:
            if not self.open:
                self.start = (block, at)
            self.open += parts[-1]
        return out


EDGE = "path string, split long, k int, kind string, block long, at int, value binary"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What of each split belongs to lines that cross its ends: orphan, head, tail and stub, and its size.

    Only the blocks up to the first line end and after the last one are inflated, and one in 64 between.
    """
    for (path, split), records in _splits(batches):
        rows, head, seen, last = [], _Lines(), False, deque()
        for kind, place, value in _blocks(split, records):
            if kind != "block":
                rows.append((kind, place, 0, value))
                continue
            if not seen:
                text = _text(value)
                end = text.find(b"\n")
                rows.append(("head", place, 0, text[: end + 1] if end >= 0 else text))
                seen = end >= 0
                if seen:
                    last.append((place, text, end + 1))
                continue
            last.append((place, value, None))
            if len(last) >= 64 and b"\n" in (text := _text(value)):
                last.clear()
                last.append((place, text, 0))
        tail: list[tuple[str, int, int, bytes]] = []
        for place, value, start in reversed(last):
            text = value if start is not None else _text(value)
            end = text.rfind(b"\n")
            tail.append(("tail", place, end + 1, text[end + 1 :]))
            if end >= 0:
                break
        ends = [r for r in rows if r[0] in ("stub", "bytes")]
        rows = [r for r in rows if r[0] not in ("stub", "bytes")] + tail[::-1] + ends + [("seen", int(seen), 0, b"")]
        cols = [[path] * len(rows), [split] * len(rows), range(len(rows)), *zip(*rows, strict=True)]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", "split", "k", "kind", "block", "at", "value"])


LINE = "path string, split long, block long, at int, line binary"  # bytes, which need not be UTF-8


def _batch(path: str, split: int, lines: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    blocks, ats, texts = zip(*lines, strict=True)
    text = pa.array([t.removesuffix(b"\r") for t in texts], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array([split] * len(lines), pa.int64()), pa.array(blocks, pa.int64()), pa.array(ats, pa.int32()), text], ["path", "split", "block", "at", "line"])


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that start after a split's first line end and end within it."""
    for (path, split), records in _splits(batches):
        cut, seen, out = _Lines(), False, []
        for kind, place, value in _blocks(split, records):
            if kind != "block":
                continue
            text, at = _text(value), 0
            if not seen:
                end = text.find(b"\n")
                if end < 0:
                    continue
                seen, text, at = True, text[end + 1 :], end + 1
            out += cut.feed(text, place, at)
            if len(out) >= 4096:
                yield _batch(path, split, out)
                out = []
        if out:
            yield _batch(path, split, out)


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of the ends of neighbouring splits: a row has the pieces between two splits' line ends, in order."""
    for batch in batches:
        for row in batch.to_pylist():
            cut, raw, start, out = _Lines(), b"", 0, []
            for p in [*row["pieces"], None]:
                if p is not None and p["kind"] in ("orphan", "stub"):
                    start = p["block"] if not raw else start
                    raw += p["value"]
                    continue
                while raw:  # blocks that a mark inside them had cut
                    need = _need(raw)
                    if need is None or len(raw) < need:
                        raise ValueError(f"{row['path']} ends within a block, or a block is damaged")
                    out += cut.feed(_text(raw[:need]), start)
                    step = need + len(HEAD) + len(MARK)
                    raw, start = raw[step:], start + step
                if p is not None:
                    out += cut.feed(p["value"], p["block"], p["at"])
            if cut.open:  # the file's last line
                out.append((*cut.start, cut.open))
            if out:
                yield _batch(row["path"], 0, out)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, line) of the lines of a BGZF file, read in splits of ``spark.sql.files.maxPartitionBytes``.

    ``ord`` is a line's virtual offset. One small job runs at once: it keeps the splits' ends in the shared folder.
    """
    kept = Kept(spark, "bgzf")
    records = raw_records(spark, path)
    edges = kept.keep(records.mapInArrow(_edges, EDGE))
    # a row a split: a file of a petabyte has eight million
    sizes = edges.groupBy("path", "split").agg(F.max(F.when(F.col("kind") == "bytes", F.col("block"))).alias("n"), F.max(F.when(F.col("kind") == "seen", F.col("block"))).alias("seen"))
    before = "over (partition by path order by split rows between unbounded preceding and 1 preceding)"
    upto = "over (partition by path order by split)"
    base = kept.keep(sizes.selectExpr("path", "split", f"coalesce(sum(n) {before}, 0) as base", f"sum(seen) {upto} as through", "seen"))
    first = F.col("kind").isin("orphan", "head")
    group = F.when(first, F.col("through") - F.col("seen")).otherwise(F.col("through"))
    # places count from a split's start, and a block starts sixteen bytes before its record
    pieces = edges.where(~F.col("kind").isin("bytes", "seen")).join(base, ["path", "split"]).withColumn("group", group).withColumn("block", F.col("block") + F.col("base"))
    joined = pieces.groupBy("path", "group").agg(F.sort_array(F.collect_list(F.struct("split", "k", "kind", "block", "at", "value"))).alias("pieces"))
    order = lambda block: F.shiftleft(block - (len(HEAD) + len(MARK)), 16) + F.col("at")
    crossing = kept.keep(joined.select("path", "pieces").mapInArrow(_crossing, LINE)).select("path", order(F.col("block")).alias("ord"), F.col("line").cast("string").alias("line"))
    inner = records.mapInArrow(_inner, LINE).join(F.broadcast(base.select("path", "split", "base")), ["path", "split"], "left")
    moved = F.raise_error(F.lit("spark.sql.files.maxPartitionBytes has changed since the file was opened")).cast("long")
    place = F.when(F.col("base").isNull(), moved).otherwise(F.col("block") + F.col("base"))
    return inner.select("path", order(place).alias("ord"), F.col("line").cast("string").alias("line")).unionByName(crossing)


def write_index(spark: SparkSession, path: str, index: str) -> None:
    """A Parquet table of (path, block, chrom, first, last, pos_min, pos_max): what lines of tab-separated chrom and pos start in a block."""
    lines = read_lines(spark, path).where(~F.col("line").startswith("#") & (F.col("line") != ""))
    c = F.split("line", "\t", 3)
    rows = lines.select("path", F.shiftrightunsigned("ord", 16).alias("block"), "ord", F.get(c, F.lit(0)).alias("chrom"), F.get(c, F.lit(1)).cast("long").alias("pos"))
    rows = rows.groupBy("path", "block", "chrom").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.min("pos").alias("pos_min"), F.max("pos").alias("pos_max"))
    rows.repartitionByRange("path", "chrom", "pos_min").sortWithinPartitions("path", "chrom", "pos_min").write.mode("overwrite").parquet(index)


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that start between two virtual offsets of a block, which alone is read (and what follows, to the end of its last line)."""
    from pyarrow import fs

    for batch in batches:
        for row in batch.to_pylist():
            system, name = fs.FileSystem.from_uri(row["path"].replace("file:/", "file:///").replace("file://///", "file:///"))
            with system.open_input_file(name) as f:
                at, cut, out = row["block"], _Lines(), []
                while not out or out[-1][:2] < (row["last"] >> 16, row["last"] & 0xFFFF):
                    header = f.read_at(18, at)
                    if len(header) < 18:
                        if cut.open:
                            out.append((*cut.start, cut.open))
                        break
                    size = struct.unpack_from("<H", header, 16)[0] + 1
                    text, skip = _text(f.read_at(size - 16, at + 16)), row["first"] & 0xFFFF if at == row["block"] else 0
                    out += cut.feed(text[skip:], at, skip)
                    at += size
            out = [x for x in out if row["first"] <= x[0] << 16 | x[1] <= row["last"]]
            if out:
                yield _batch(row["path"], 0, out)


def region_lines(spark: SparkSession, index: str, chrom: str, start: int = 1, end: int = 2**62) -> DataFrame:
    """(path, ord, line) of chrom:start-end by an index, in tasks that read the region's blocks and no others.

    Tasks open the file by its address, as pyarrow's file systems do; its blocks, not its rows, are dealt to them.
    """
    blocks = spark.read.parquet(index).where((F.col("chrom") == chrom) & (F.col("pos_min") <= end) & (F.col("pos_max") >= start))
    lines = blocks.select("path", "block", "first", "last").repartition("path", "block").mapInArrow(_read_blocks, LINE).withColumn("line", F.col("line").cast("string"))
    pos = F.get(F.split("line", "\t", 3), F.lit(1)).cast("long")
    return lines.where(pos.between(start, end) & F.col("line").startswith(chrom + "\t")).select("path", (F.shiftleft("block", 16) + F.col("at")).alias("ord"), "line")
