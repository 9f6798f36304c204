"""Single files written in parallel: tasks write parts, which are put together in order as bytes.

Rows never pass through the driver. Parts are written by Spark's own committer, so a task that fails or runs
twice leaves one part; joining the parts copies bytes from file to file by the Hadoop file
system. The bytes of a file do not depend on the number of partitions: BGZF blocks are
cut by each line's offset in the whole file, which sums over parts give.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.session import Kept
from helixframe.sources import bgzf


def join_files(spark: SparkSession, sources: list[str | bytes], path: str) -> None:
    """One file of the bytes of others (folders: of their parts by name) and of given bytes; it appears when it is whole."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    goal, made = new(path), new(f"{path}.unfinished")
    fs = goal.getFileSystem(conf)
    out = fs.create(made, True)
    try:
        for s in sources:
            if isinstance(s, bytes):
                out.write(bytearray(s))
                continue
            own = new(s).getFileSystem(conf)
            names = sorted(x.getPath().toString() for x in own.listStatus(new(s)) if x.getPath().getName().startswith("part-"))
            for name in names:
                stream = own.open(new(name))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
                stream.close()
    finally:
        out.close()
    fs.delete(goal, False)
    if not fs.rename(made, goal):
        raise OSError(f"cannot rename to {path}")


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (block, start, value) in order to BGZF blocks, each from its size on, with the next one's head."""
    at, held = None, []

    def packed() -> pa.RecordBatch:
        whole = bgzf.pack(b"".join(held))
        return pa.RecordBatch.from_arrays([pa.array([whole[16:] + bgzf.HEAD], pa.binary())], ["value"])

    for batch in batches:
        for block, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if held and block != at:
                yield packed()
                held = []
            at = block
            held.append(value)
    if held:
        yield packed()


def _pieces(lines: DataFrame, size: int) -> DataFrame:
    """(block, start, value): lines (start, line), each with its end, cut where blocks of ``size`` bytes end."""
    raw = F.encode(F.concat("line", F.lit("\n")), "UTF-8")
    rows = lines.select("start", raw.alias("raw")).withColumn("block", F.explode(F.expr(f"sequence(start div {size}, (start + octet_length(raw) - 1) div {size})")))
    begin = F.expr(f"int(greatest(block * {size} - start, 0))")
    length = F.expr(f"int(least((block + 1) * {size} - start, octet_length(raw)))") - begin
    return rows.select("block", "start", F.col("raw").substr(begin + 1, length).alias("value"))


def write_lines(lines: DataFrame, order: list[str], path: str, head: list[str] | None = None, packed: bool | None = None) -> None:
    """``head``, then the column ``line`` of rows in the order of other columns, to one file: plain, or BGZF if ``packed``
    (by default if its name ends so: .gz, .bgz)."""
    spark, head = lines.sparkSession, head or []
    kept = Kept(spark, "lines")
    packed = path.endswith((".gz", ".bgz")) if packed is None else packed
    ordered = lines.orderBy(*order)
    if not packed:
        parts = f"{kept.root}/parts"
        ordered.select("line").write.text(parts)
        join_files(spark, ["".join(f"{x}\n" for x in head).encode(), parts], path)
        return kept.drop()
    # a row's number holds its partition's, so partitions are numbered once and for all
    rows = kept.keep(ordered.select(F.monotonically_increasing_id().alias("n"), "line")).withColumn("part", F.shiftright("n", 33))
    size = F.octet_length("line") + 1
    sums = rows.groupBy("part").agg(F.sum(size).alias("size"))  # a row a partition
    sums = sums.selectExpr("part", f"{sum(len(x.encode()) + 1 for x in head)} + coalesce(sum(size) over (order by part rows between unbounded preceding and 1 preceding), 0) as before")
    placed = rows.withColumn("size", size).join(F.broadcast(sums), "part")
    placed = placed.selectExpr("before + sum(size) over (partition by part order by n rows unbounded preceding) - size as start", "line")
    starts = [0]
    for x in head:
        starts.append(starts[-1] + len(x.encode()) + 1)
    if head:
        placed = placed.unionByName(spark.createDataFrame(list(zip(starts, head, strict=False)), "start long, line string"))
    pieces = _pieces(placed, bgzf.BLOCK).repartitionByRange("block").sortWithinPartitions("block", "start")
    parts = f"{kept.root}/parts"
    blocks = pieces.mapInArrow(_compress, "value binary").select(F.col("value").cast("string"))
    # the six bytes that every header holds stand between blocks as the line ends of a text file do
    blocks.write.option("lineSep", bgzf.MARK.decode()).text(parts)
    join_files(spark, [bgzf.HEAD + bgzf.MARK, parts, bgzf.END[16:]], path)
    kept.drop()
