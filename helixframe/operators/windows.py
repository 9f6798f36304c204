"""Windowed statistics over sites, the cohort depth outliers, and counts."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import site as S
from helixframe.operators import binned as B
from helixframe.operators.joins import span_cover
from helixframe.sources.sinks import write_lines


def explode_samples(sites: DataFrame) -> DataFrame:
    s = sites.select("*", F.posexplode(F.arrays_zip("gt", "dp")).alias("sample_ix", "__z"))
    return s.withColumns({"a0": F.col("__z.gt.a0"), "a1": F.col("__z.gt.a1"), "d": F.col("__z.dp")}).drop("__z")


def window_depth(sites: DataFrame, width: int, most_missing: float = 0.5, files: tuple[str, ...] = ()) -> DataFrame:
    """(…files, chrom, win, sample_ix, depth_sum, sites) over tumbling windows; negative depths count as 0."""
    s = sites.where(S.missing_frac() <= most_missing).select(*files, "chrom", F.expr(f"(pos - 1) div {width}").alias("win"), F.posexplode("dp").alias("sample_ix", "d"))
    return s.groupBy(*files, "chrom", "win", "sample_ix").agg(F.sum(F.greatest("d", F.lit(0))).cast("long").alias("depth_sum"), F.count("*").alias("sites"))


def fill_gaps(windows: DataFrame) -> DataFrame:
    """Windows of no site between a chromosome's first and last get zeros."""
    ends = windows.groupBy("chrom").agg(F.min("win").alias("a"), F.max("win").alias("b"), F.collect_set("sample_ix").alias("ix"))
    grid = ends.select("chrom", F.explode(F.expr("sequence(a, b)")).alias("win"), "ix").select("chrom", "win", F.explode("ix").alias("sample_ix"))
    out = grid.join(windows, ["chrom", "win", "sample_ix"], "left")
    return out.fillna(0, ["depth_sum", "sites"])


TRANSFORM = {"none": lambda x: x, "sqrt": lambda x: F.sqrt(x), "log": lambda x: F.log(x)}
INVERSE = {"none": lambda x: x, "sqrt": lambda x: F.greatest(x, F.lit(0.0)) ** 2, "log": lambda x: F.exp(x)}


def depth_outliers(windows: DataFrame, alpha: float = 1e-6, min_sites: int = 20, min_depth: float = 5.0, threshold: float = 0.05, use_median: bool = True, transform: str = "none", min_spread: float = 0.01, width: int | None = None) -> DataFrame:
    """(chrom, win, sites, low_frac, high_frac, mu, sigma) of windows where too many samples stand out; with the windows'
    ``width`` also start, end, frac, the samples that stand out (low_ix, high_ix), and centre and cuts on the
    scale of z (lower_cut, upper_cut) and of depths (the same with _norm).

    Depth per site, over a sample's scale, over windows: robust z by median and MAD (or
    mean and standard deviation); a sample stands out where z passes the
    normal quantile of ``alpha``. All of it is aggregation; the cut is a scalar.
    """
    mid = (lambda c: F.median(c)) if use_median else (lambda c: F.avg(c))
    r = windows.withColumn("r", F.when(F.col("sites") > 0, F.col("depth_sum").cast("double") / F.col("sites")))
    own = r.where(F.col("sites") >= min_sites).groupBy("sample_ix").agg(mid("r").alias("own"))
    ref = own.agg(mid("own").alias("ref"))
    # one row a sample and one row: both bounded by the cohort's size
    scale = own.crossJoin(F.broadcast(ref)).select("sample_ix", F.when((F.col("own") > 0) & (F.col("ref") > 0), F.col("own") / F.col("ref")).alias("s"))
    y = r.join(scale, "sample_ix").withColumn("y", F.col("r") / F.col("s"))
    t = TRANSFORM[transform](F.col("y"))
    y = y.withColumn("t", F.when(F.col("y") > 0, t) if transform == "log" else t)
    c = y.groupBy("chrom", "win").agg(mid("y").alias("centre"), mid("t").alias("mu"), F.max("sites").alias("sites"), F.stddev("t").alias("sd"))
    c = c.where((F.col("sites") >= min_sites) & (F.col("centre") >= min_depth))
    y = y.join(c.select("chrom", "win", "mu", "sd", F.col("sites").alias("n_sites")), ["chrom", "win"])
    if use_median:
        spread = y.groupBy("chrom", "win").agg((1.4826 * F.median(F.abs(F.col("t") - F.col("mu")))).alias("raw"))
        y = y.join(spread, ["chrom", "win"])
    else:
        y = y.withColumn("raw", F.col("sd"))
    y = y.withColumn("sigma", F.when(F.col("raw") > min_spread, F.col("raw")).otherwise(min_spread)).withColumn("z", (F.col("t") - F.col("mu")) / F.col("sigma"))
    cut = NormalDist().inv_cdf(alpha)
    low, high = F.avg((F.coalesce(F.col("z") <= cut, F.lit(False))).cast("double")), F.avg((F.coalesce(F.col("z") >= -cut, F.lit(False))).cast("double"))
    side = lambda ok: F.array_sort(F.collect_list(F.when(ok, F.col("sample_ix"))))
    more = [side(F.col("z") <= cut).alias("low_ix"), side(F.col("z") >= -cut).alias("high_ix"), F.avg(F.coalesce(F.abs("z") >= -cut, F.lit(False)).cast("double")).alias("frac")] if width else []
    out = y.groupBy("chrom", "win").agg(F.max("n_sites").alias("sites"), low.alias("low_frac"), high.alias("high_frac"), F.max("mu").alias("mu"), F.max("sigma").alias("sigma"), *more)
    out = out.where((F.col("low_frac") >= threshold) | (F.col("high_frac") >= threshold))
    if not width:
        return out
    back = INVERSE[transform]
    out = out.withColumns({"start": F.col("win") * width + 1, "end": (F.col("win") + 1) * width, "lower_cut": F.col("mu") + cut * F.col("sigma"), "upper_cut": F.col("mu") - cut * F.col("sigma")})
    return out.withColumns({"mu_norm": back(F.col("mu")), "lower_cut_norm": back(F.col("lower_cut")), "upper_cut_norm": back(F.col("upper_cut"))})


def outlier_lines(report: DataFrame, names: DataFrame) -> DataFrame:
    """(kind, chrom, start, line): tab-separated lines of a report with ``width``, for all windows (final) and those of
    low and of high samples; ``names`` (sample_ix, name) is the cohort."""
    e = report.select("chrom", "win", F.explode(F.concat(F.transform("low_ix", lambda i: F.struct(F.lit("low").alias("side"), i.alias("sample_ix"))), F.transform("high_ix", lambda i: F.struct(F.lit("high").alias("side"), i.alias("sample_ix"))))).alias("x")).select("chrom", "win", "x.*")
    pick = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("sample_ix", "name")))), lambda x: x["name"]), ",").alias(f"{side}_names")
    named = e.join(names, "sample_ix").groupBy("chrom", "win").agg(pick("low"), pick("high"))
    r = report.join(named, ["chrom", "win"], "left").fillna("", ["low_names", "high_names"])
    place = F.format_string("%s:%d-%d", "chrom", "start", "end")
    two, four = (lambda c: F.format_string("%.2f", c)), (lambda c: F.format_string("%.4f", c))
    depth = [four("mu_norm"), four("lower_cut_norm"), four("upper_cut_norm")]
    line = lambda *cols: F.concat_ws("\t", place, F.col("start").cast("string"), two("frac"), *cols)
    rows = F.array(F.struct(F.lit("final").alias("kind"), line(two("low_frac"), two("high_frac"), *depth, "low_names", "high_names").alias("line")), F.struct(F.when(F.size("low_ix") > 0, "low").alias("kind"), line(two("low_frac"), *depth, "low_names").alias("line")), F.struct(F.when(F.size("high_ix") > 0, "high").alias("kind"), line(two("high_frac"), *depth, "high_names").alias("line")))
    return r.select("chrom", "start", F.explode(rows).alias("x")).select("x.kind", "chrom", "start", "x.line").where("kind is not null")


# Columns of the outlier files.
OUTLIER_COLUMNS = {
    "final": "chrom_position window_start frac low_frac high_frac norm_depth_{mid} norm_depth_lower_cut norm_depth_upper_cut low_depth_ids high_depth_ids",
    "low": "chrom_position window_start frac low_frac norm_depth_{mid} norm_depth_lower_cut norm_depth_upper_cut low_depth_ids",
    "high": "chrom_position window_start frac high_frac norm_depth_{mid} norm_depth_lower_cut norm_depth_upper_cut high_depth_ids",
}


def write_outliers(report: DataFrame, names: DataFrame, stem: str, use_median: bool = True) -> None:
    """``stem``.windows_final, _low and _high, in order of position; each file is written by many tasks (``sinks``)."""
    lines = outlier_lines(report, names)
    for kind, columns in OUTLIER_COLUMNS.items():
        head = "\t".join(columns.format(mid="median" if use_median else "mean").split())
        write_lines(lines.where(F.col("kind") == kind), ["chrom", "start"], f"{stem}.windows_{kind}", [head], packed=False)


def report_depths(sites: DataFrame, names: DataFrame, stem: str, width: int, most_missing: float = 0.5, **options) -> DataFrame:
    """Window depths with their gaps, the outliers among them, and the files of both; gives the outliers. ``options`` go to
    ``depth_outliers``. Windows are few beside sites and are kept for the two results."""
    windows = fill_gaps(window_depth(sites, width, most_missing)).persist()
    write_tsv(windows, f"{stem}.depths", ["chrom", "win", "sample_ix"])
    report = depth_outliers(windows, width=width, **options)
    write_outliers(report, names, stem, options.get("use_median", True))
    return report


def write_tsv(table: DataFrame, path: str, order: list[str], header: bool = True) -> None:
    """Window or sample statistics as one tab-separated file, in order, written by many tasks; nulls are empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns]
    line = F.concat_ws("\t", *cells).alias("line")
    write_lines(table.select(*order, line), order, path, ["\t".join(table.columns)] if header else [], packed=False)


def slide_bp(sites: DataFrame, width: int, least: int = 3, bin_width: int = B.WIDTH) -> DataFrame:
    """At each site, over sites of its chromosome within ``width`` bp before it: median position, mean depth, mean share of
    samples of depth ``least``, sites for each 100 bp."""
    s = sites.select("chrom", "pos", (S.depth().cast("double") / F.size("dp")).alias("d"), F.try_divide(F.size(F.filter("dp", lambda x: x >= least)).cast("double"), F.size("dp").cast("double")).alias("m"))
    over = {"mid": F.percentile("pos", F.lit(0.5)), "mean_depth": F.avg("d"), "nonmiss": F.avg("m"), "__k": F.count("*")}
    return B.over_span(s, width, over, bin_width).select("chrom", "pos", "mid", "mean_depth", "nonmiss", (F.col("__k").cast("double") / width * 100).alias("density"))


def slide_bp_thin(sites: DataFrame, width: int, every: int, bin_width: int = B.WIDTH) -> DataFrame:
    """At every ``every``-th site of a chromosome, over its sites within ``width`` bp before: mean depth and share of SNPs.
    Sites may come from several files; a position's place among all of them counts."""
    s = sites.select("chrom", *S.order(sites), (S.depth().cast("double") / F.size("dp")).alias("d"), (S.allelicity(S.counts()) > 1).cast("double").alias("snp"))
    s = B.numbered(s, S.order(sites), bin_width)
    s = B.over_span(s, width, {"mean_depth": F.avg("d"), "snp_frac": F.avg("snp")}, bin_width)
    return s.where(F.col("__n") % every == 0).select("chrom", "pos", F.col("__n").cast("int").alias("n"), "mean_depth", "snp_frac")


def slide_rows(sites: DataFrame, rows: int, step: int = 1, bin_width: int = B.WIDTH, block: int = B.ROWS) -> DataFrame:
    """Over the last ``rows`` sites, at every ``step``-th site from the ``rows``-th on: median position, mean depth, share of SNPs, mean share of called alleles."""
    s = sites.select("chrom", *S.order(sites), (1 - S.missing_frac()).alias("nm"), (S.depth().cast("double") / F.size("dp")).alias("d"), (S.allelicity(S.counts()) > 1).cast("double").alias("snp"))
    s = B.numbered(s, S.order(sites), bin_width)
    s = B.over_rows(s, rows, {"mid": F.percentile("pos", F.lit(0.5)), "mean_depth": F.avg("d"), "snp_frac": F.avg("snp"), "nonmiss": F.avg("nm")}, block)
    return s.where((F.col("__n") >= rows) & (F.col("__n") % step == 0)).select("chrom", "pos", F.col("__n").cast("int").alias("n"), "mid", "mean_depth", "snp_frac", "nonmiss")


def quicksum(sites: DataFrame, *by: str) -> DataFrame:
    """Counts over all sites, or a row for each value of ``by``."""
    s = sites.withColumn("counts", S.counts()).withColumn("k", S.allelicity())
    one, two, three = (S.has_count(n=i) for i in (1, 2, 3))
    many = F.col("k") > 1
    n = lambda c: F.count_if(c)
    out = s.groupBy(*by).agg(F.count("*").alias("sites"), n(F.col("k") == 1).alias("invariant"), n(many).alias("snps"), n(F.col("k") > 2).alias("multi"), n(F.col("k") == 2).alias("bi"), n(many & one).alias("singles"), n(many & ~one & two).alias("doubles"), n(many & ~one & ~two & three).alias("triples"), n(F.col("k") == 0).alias("other"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return out.withColumn("coverage", F.col("sites").cast("double") / (F.col("last") - F.col("first") + 1))


def sample_stats(sites: DataFrame, least: int = 3) -> DataFrame:
    """Per sample: depth sum, sites of depth ``least``, and both over all sites."""
    e = sites.select(F.posexplode("dp").alias("sample_ix", "d"))
    out = e.groupBy("sample_ix").agg(F.sum("d").cast("long").alias("depth_sum"), F.count_if(F.col("d") >= least).alias("n_deep"), F.count("*").alias("n"))
    return out.select("sample_ix", "depth_sum", "n_deep", (F.col("depth_sum").cast("double") / F.col("n")).alias("mean_depth"), (F.col("n_deep").cast("double") / F.col("n")).alias("frac_deep"))


def trio_counts(sites: DataFrame, focus: int, out1: int, out2: int, in1: int | None = None) -> DataFrame:
    """Sites where the outgroups are fixed for different alleles, by the focal sample's dosage: like the first, mid, like the second."""
    def dosage(i: int):
        g = F.get("gt", F.lit(i))
        return F.when((g["a0"] >= 0) & (g["a1"] >= 0), g["a0"] + g["a1"])

    s = sites.where(S.allelicity(S.counts()) == 2).select(dosage(focus).alias("f"), dosage(out1).alias("o1"), dosage(out2).alias("o2"), (dosage(in1) if in1 is not None else dosage(out1)).alias("i1"))
    s = s.where("f is not null and o1 in (0, 2) and o2 in (0, 2) and o1 <> o2 and i1 = o1")
    return s.agg(F.count_if(F.col("f") == F.col("o1")).alias("m1"), F.count_if(F.col("f") == F.col("o2")).alias("m2"), F.count_if(F.col("f") == 1).alias("mid"))


def pop_counts(sites: DataFrame, pops: dict[str, list[int]], least: int = 1) -> DataFrame:
    """Per site and population of ``least`` ids or more: how often 0 and 1 are called."""
    def n(ids: list[int], code: int):
        own = F.transform(F.array(*[F.lit(i) for i in ids]), lambda i: F.get("gt", i))
        return F.aggregate(own, F.lit(0), lambda s, g: s + (g["a0"] == code).cast("int") + (g["a1"] == code).cast("int"))

    rows = F.array(*[F.struct(F.lit(p).alias("pop"), n(ids, 0).alias("n0"), n(ids, 1).alias("n1")) for p, ids in sorted(pops.items()) if len(ids) >= least])
    return sites.select("chrom", "pos", F.explode(rows).alias("x")).select("chrom", "pos", "x.*")


def fixed_total(ref, alt, total: int):
    """Counts scaled to ``total`` by whole division, the remainder to the side that the division leaves more of."""
    n, t, z = ref + alt, F.lit(total).cast("long"), F.lit(0).cast("long")
    one, two = F.when(ref > 0, n / ref), F.when(alt > 0, n / alt)
    r, a = F.floor(total / one), F.floor(total / two)
    more = F.round(total - r * one, 9) >= F.round(total - a * two, 9)
    pair = lambda x, y: F.struct(x.cast("long").alias("r"), y.cast("long").alias("a"))
    return F.when((ref == 0) & (alt == 0), pair(z, z)).when(ref == 0, pair(z, t)).when(alt == 0, pair(t, z)).when(r + a == total, pair(r, a)).when(more, pair(r + 1, a)).otherwise(pair(r, a + 1))


def map_rates(points: DataFrame, bin_width: int = B.WIDTH) -> DataFrame:
    """(chrom, phys, gen) with rate, the slope from the point before (from (0, 0)) for each million."""
    s = B.with_bin(points, bin_width, "phys")
    s = B.before(s, F.struct("gen", "phys"), ["phys"], "__was", F.max_by(F.struct("gen", "phys"), "phys"))
    dg, dp = F.col("gen") - F.coalesce("__was.gen", F.lit(0.0)), F.col("phys") - F.coalesce("__was.phys", F.lit(0))
    return s.withColumn("rate", F.try_divide(dg, dp.cast("double")) * 1e6).drop("__was", "__bin")


def running_counts(sites: DataFrame, emit, bin_width: int = B.WIDTH) -> DataFrame:
    """Sites where ``emit`` holds with ``nsites``, the records read since the one before, itself included."""
    s = B.numbered(sites, S.order(sites), bin_width).where(emit)
    s = B.before(s, F.col("__n"), ["__n"], "__was", F.max("__n"), F.lit(0))
    return s.withColumn("nsites", (F.col("__n") - F.col("__was")).cast("int")).drop("__n", "__was", "__bin")


def global_index(windows: DataFrame) -> DataFrame:
    """``windows`` (chrom, win) with ``global_ix``: the window's number over all chromosomes in order, each from 0 to its last window."""
    n = windows.groupBy("chrom").agg((F.max("win") + 1).alias("__n"))
    # a row a chromosome
    w = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    start = n.select("chrom", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    return windows.join(start, "chrom").withColumn("global_ix", F.col("__start") + F.col("win")).drop("__start")


def nonrepeat(lengths: DataFrame, mask: DataFrame, width: int = 1_000, step: int = 1) -> DataFrame:
    """(chrom, pos, nonrepeat_frac): the share of ``width`` bp, of which pos is the middle, outside the mask, every ``step``
    bp of each chromosome (chrom, length) where the window fits."""
    at = lengths.where(F.col("length") >= width).select("chrom", F.explode(F.expr(f"sequence(1L, length - {width} + 1, {step}L)")).alias("start"))
    spans = at.select("chrom", "start", (F.col("start") + width - 1).alias("end"))
    return span_cover(spans, mask, max(width, 1_000)).select("chrom", F.expr(f"start + {width} div 2").alias("pos"), (1 - F.col("frac")).alias("nonrepeat_frac"))
