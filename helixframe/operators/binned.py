"""Windows over a chromosome's sites without a task a chromosome.

Rows are cut by position into bins. What a row needs of earlier bins is either a number that bins can
carry (how many rows, the largest end, the last value), summed up over a table of a row a bin, or a
few rows of the bin before, which are copied into it (a halo). So a task holds a bin and its
halo. Rows of one position are in one bin, so ties never cross a border. Sites have a chromosome and a position; rows
without them take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Base pairs of a bin, and rows of a block of numbered rows.
WIDTH, ROWS = 1_000_000, 100_000


def with_bin(rows: DataFrame, width: int = WIDTH, pos: str = "pos") -> DataFrame:
    return rows.withColumn("__bin", F.expr(f"{pos} div {width}"))


def carried(rows: DataFrame, later: bool = False, **values: tuple[Column, str]) -> DataFrame:
    """(chrom, __bin, values): each value, an aggregate of a bin, summed up over the bins before (``later``: after) it.

    A value is (aggregate, how): how is sum, max, min or last, the value of the nearest bin that has one. A
    chromosome has as many bins as its length has widths, which is what the one window over them sorts.
    """
    per = rows.groupBy("chrom", "__bin").agg(*[agg.alias(name) for name, (agg, _) in values.items()])
    w = Window.partitionBy("chrom").orderBy(F.desc("__bin") if later else F.asc("__bin")).rowsBetween(Window.unboundedPreceding, -1)
    how = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    return per.select("chrom", "__bin", *[how[h](name).over(w).alias(name) for name, (_, h) in values.items()])


def in_bin(*order: str | Column) -> Window:
    return Window.partitionBy("chrom", "__bin").orderBy(*order)


def numbered(rows: DataFrame, order: list, width: int = WIDTH, name: str = "__n") -> DataFrame:
    """``rows`` with their bin and their number in the chromosome, from 1, in an order that begins with the position."""
    s = with_bin(rows, width)
    start = carried(s, __before=(F.count("*"), "sum"))
    at = F.coalesce("__before", F.lit(0)) + F.row_number().over(in_bin(*order))
    return s.join(start, ["chrom", "__bin"]).withColumn(name, at).drop("__before")


def over_rows(rows: DataFrame, n: int, columns: dict[str, Column], block: int = ROWS, number: str = "__n") -> DataFrame:
    """``rows`` with columns over each row and the ``n`` - 1 before it, by their number: blocks of rows and a halo of n - 1."""
    size = max(block, n)
    own, place = F.expr(f"({number} - 1) div {size}"), F.expr(f"({number} - 1) % {size}")
    s = rows.withColumn("__own", own).withColumn("__at", F.explode(F.when(place > size - n, F.array(own, own + 1)).otherwise(F.array(own))))
    f = Window.partitionBy("chrom", "__at").orderBy(number).rowsBetween(-(n - 1), 0)
    return s.withColumns({k: v.over(f) for k, v in columns.items()}).where("__at = __own").drop("__own", "__at")


def over_span(rows: DataFrame, span: int, columns: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """``rows`` with columns over all rows of their chromosome within ``span`` bp before them, and of their position: bins and a halo of a span."""
    size = max(width, span)
    own = F.expr(f"pos div {size}")
    s = rows.withColumn("__own", own).withColumn("__at", F.explode(F.when(F.col("pos") >= (own + 1) * size - span, F.array(own, own + 1)).otherwise(F.array(own))))
    f = Window.partitionBy("chrom", "__at").orderBy("pos").rangeBetween(-span, 0)
    return s.withColumns({k: v.over(f) for k, v in columns.items()}).where("__at = __own").drop("__own", "__at")


def before(rows: DataFrame, value: Column, order: list, name: str, last: Column, default: Column | None = None) -> DataFrame:
    """``rows`` (with their bin) with ``value`` of the row before in the chromosome; ``last`` is the aggregate that gives a bin's last value."""
    start = carried(rows, __carry=(F.struct(last.alias("v")), "last"))
    here = F.lag(F.struct(value.alias("v"))).over(in_bin(*order))
    out = rows.join(start, ["chrom", "__bin"]).withColumn(name, F.coalesce(here, F.col("__carry"))["v"])
    return (out if default is None else out.withColumn(name, F.coalesce(name, default))).drop("__carry")


def as_of(left: DataFrame, points: DataFrame, value: str, width: int = WIDTH) -> DataFrame:
    """``left`` (chrom, pos, ...) with ``value`` of the last of ``points`` (chrom, pos, value) at or before each row; of points at one position any."""
    both = points.select("chrom", "pos", value).withColumn("__k", F.lit(0)).unionByName(left.withColumn("__k", F.lit(1)), allowMissingColumns=True)
    both = with_bin(both, width)
    start = carried(both, __carry=(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("pos"))), "last"))
    w = in_bin("pos", "__k").rowsBetween(Window.unboundedPreceding, 0)
    s = both.withColumn("__own", F.last(value, ignorenulls=True).over(w)).where("__k = 1")
    return s.join(start, ["chrom", "__bin"]).withColumn(value, F.coalesce("__own", "__carry")).drop("__own", "__carry", "__k", "__bin")
