"""Comparison of two site tables, and joins of points and spans with intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import site as S
from helixframe.operators import binned as B


def number_duplicates(sites: DataFrame, order: list[str]) -> DataFrame:
    """``dup_ix``: the place of a row among those of its position, by ``order``."""
    return sites.withColumn("dup_ix", F.row_number().over(Window.partitionBy("chrom", "pos").orderBy(*order)))


def compare(left: DataFrame, right: DataFrame, mode: str, order: list[str]) -> DataFrame:
    """(chrom, pos, dup_ix, l, r): rows of both tables at a position pair one to one, in order; the rest is unmatched.

    ``mode``: intersect, left, right, all, or exclude (what either has alone).
    """
    key = ["chrom", "pos", "dup_ix"]
    pack = lambda df, name: number_duplicates(df, order).select(*key, F.struct(*df.columns).alias(name))
    how = {"intersect": "inner", "left": "left", "right": "right", "all": "full", "exclude": "full"}[mode]
    out = pack(left, "l").join(pack(right, "r"), key, how)
    return out.where("l is null or r is null") if mode == "exclude" else out


def prefer(pairs: DataFrame, side: str, exclusive: bool = False) -> DataFrame:
    """One row a pair, from ``side`` where it exists; ``exclusive`` drops rows that it lacks."""
    first, other = ("l", "r") if side == "left" else ("r", "l")
    out = pairs.where(f"{first} is not null") if exclusive else pairs
    return out.select("chrom", "pos", "dup_ix", F.coalesce(first, other).alias("site"))


def merge_intervals(intervals: DataFrame, bin_width: int = B.WIDTH) -> DataFrame:
    """Intervals (chrom, start, end), 1-based inclusive, that overlap or touch become one.

    Bins by start carry the largest end so far, and then the start of the merged interval that is still open.
    """
    s = B.with_bin(intervals, bin_width, "start")
    w = B.in_bin("start", "end")
    top = F.greatest(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__top"))
    s = s.join(B.carried(s, __top=(F.max("end"), "max")), ["chrom", "__bin"])
    s = s.withColumn("__first", F.when(F.coalesce(F.col("start") > top + 1, F.lit(True)), F.col("start")))
    open_ = B.carried(s, __open=(F.max("__first"), "max"))
    here = F.max("__first").over(w.rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("__here", here).join(open_, ["chrom", "__bin"]).withColumn("__g", F.coalesce("__here", "__open"))
    return s.groupBy("chrom", "__g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__g")


def _binned(intervals: DataFrame, width: int) -> DataFrame:
    return intervals.withColumn("__bin", F.explode(F.expr(f"sequence(start div {width}, end div {width})")))


def in_intervals(points: DataFrame, intervals: DataFrame, width: int = 10_000, anti: bool = False) -> DataFrame:
    """Points (chrom, pos) inside an interval, or outside all; an equi-join on position bins."""
    b = _binned(intervals.select("chrom", "start", "end"), width).alias("i")
    p = points.withColumn("__bin", F.expr(f"pos div {width}")).alias("p")
    on = F.expr("p.chrom = i.chrom and p.__bin = i.__bin and p.pos between i.start and i.end")
    return p.join(b, on, "left_anti" if anti else "left_semi").drop("__bin")


def span_cover(spans: DataFrame, intervals: DataFrame, width: int = 10_000) -> DataFrame:
    """``spans`` (chrom, start, end) with ``covered`` bp, ``overlaps`` and ``frac`` under merged intervals."""
    s = spans.withColumn("__bin", F.explode(F.expr(f"sequence(start div {width}, end div {width})"))).alias("s")
    m = _binned(merge_intervals(intervals), width).alias("m")
    lo, hi = F.expr("greatest(s.start, m.start)"), F.expr("least(s.end, m.end)")
    # an overlap counts in the bin where it begins
    hit = s.join(m, F.expr("s.chrom = m.chrom and s.__bin = m.__bin and s.start <= m.end and m.start <= s.end")).where(F.expr(f"greatest(s.start, m.start) div {width} = s.__bin"))
    cover = hit.groupBy("s.chrom", "s.start", "s.end").agg(F.sum(hi - lo + 1).alias("covered"))
    out = spans.join(cover, ["chrom", "start", "end"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))
    return out.withColumn("overlaps", F.col("covered") > 0).withColumn("frac", F.col("covered").cast("double") / (F.col("end") - F.col("start") + 1))


def interpolate_map(sites: DataFrame, points: DataFrame, bin_width: int = B.WIDTH) -> DataFrame:
    """``sites`` (chrom, pos) with ``gen``, linear between map points (chrom, phys, gen) from (0, 0), and
    ``rec``, the distance to the previous site; null and 0 beyond the last point.

    Each point carries the one after it, so a site needs only the last point before it, of its own bin or an earlier one.
    """
    zero = points.select("chrom").distinct().select("chrom", F.lit(0).cast("long").alias("phys"), F.lit(0.0).alias("gen"))
    p = B.with_bin(zero.unionByName(points.select("chrom", F.col("phys").cast("long").alias("phys"), "gen")), bin_width, "phys")
    after = B.carried(p, later=True, __after=(F.min_by(F.struct("phys", "gen"), "phys"), "last"))
    p = p.withColumn("__next", F.lead(F.struct("phys", "gen")).over(B.in_bin("phys"))).join(after, ["chrom", "__bin"])
    up = F.coalesce("__next", "__after")
    p = p.select("chrom", F.col("phys").alias("pos"), F.struct("phys", "gen", up["phys"].alias("phys2"), up["gen"].alias("gen2")).alias("__pt"))
    s = B.as_of(sites, p, "__pt", bin_width)
    lo = lambda f: F.col(f"__pt.{f}")
    between = lo("gen") + (lo("gen2") - lo("gen")) * (F.col("pos") - lo("phys")) / (lo("phys2") - lo("phys"))
    s = B.with_bin(s.withColumn("gen", F.when(lo("phys") == F.col("pos"), lo("gen")).otherwise(between)).drop("__pt"), bin_width)
    order = S.order(sites)
    s = B.before(s, F.col("gen"), order, "__was", F.max_by("gen", F.struct(*order)), F.lit(0.0))
    return s.withColumn("rec", F.coalesce(F.col("gen") - F.col("__was"), F.lit(0.0))).drop("__was", "__bin")


def sample_places(left: DataFrame, right: DataFrame, mode: str) -> DataFrame:
    """(name, l_ix, r_ix) of the samples (name, ix) that a comparison keeps: intersect, left, right, all or exclude."""
    if mode not in ("intersect", "left", "right", "all", "exclude"):
        raise ValueError(f"mode {mode}")
    how = {"intersect": "inner", "left": "left", "right": "right"}.get(mode, "full")
    out = left.select("name", F.col("ix").alias("l_ix")).join(right.select("name", F.col("ix").alias("r_ix")), "name", how)
    return out.where("l_ix is null or r_ix is null") if mode == "exclude" else out


def ordinal_join(left: DataFrame, right: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The k-th row of a group with the k-th row of the same group on the other side."""
    w = Window.partitionBy(*by).orderBy(*order)
    k = F.row_number().over(w).alias("ord")
    return left.select("*", k).join(right.select("*", k), [*by, "ord"])
