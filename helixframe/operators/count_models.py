"""Depth outliers under count models, projection to smaller sample numbers, and thinning.

Everything but the tails of the two discrete models, the seeded draws and the
walk of the exponential thinning is a plan of built-in functions.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function Q(a, x), a > 0, x >= 0."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    front = np.exp(a * np.log(np.where(x > 0, x, 1.0)) - x - _lgamma(a))
    low = (x > 0) & (x < a + 1)
    if low.any():
        n, y = a[low].copy(), x[low]
        term = 1.0 / n
        total = term.copy()
        for _ in range(200_000):
            n += 1
            term = term * y / n
            total += term
            if (term <= total * 1e-16).all():
                break
        out[low] = 1.0 - front[low] * total
    high = x >= a + 1
    if high.any():
        p, q = a[high], x[high]
        at, done = np.arange(len(p)), np.empty(p.shape)
        b = q + 1 - p
        c, d = np.full(b.shape, 1e300), 1.0 / b
        h = d.copy()
        for i in range(1, 200_000):
            if not len(at):
                break
            k = -i * (i - p)
            b = b + 2
            d = k * d + b
            d = 1.0 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + k / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
            on = ~(np.abs(d * c - 1) < 1e-15)
            if not on.all():
                done[at[~on]] = h[~on]
                at, p, b, c, d, h = (v[on] for v in (at, p, b, c, d, h))
        done[at] = h
        h = done
        out[high] = front[high] * h
    return np.clip(out, 0.0, 1.0)


def _beta_fraction(p: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function. A value leaves the loop as soon as it stands: rounding keeps
    some of many values moving in the last digit, so they never all stand in one step."""
    tiny = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    out, at = np.ones(p.shape), np.arange(len(p))
    c, d = np.ones(p.shape), 1.0 / tiny(1 - (p + q) * x / (p + 1))
    h = d.copy()
    for m in range(1, 100_000):
        if not len(at):
            break
        even = m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1.0 / tiny(1 + even * d), tiny(1 + even / c)
        h = h * d * c
        odd = -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1.0 / tiny(1 + odd * d), tiny(1 + odd / c)
        h = h * d * c
        on = ~(np.abs(d * c - 1) < 1e-15)
        if not on.all():
            out[at[~on]] = h[~on]
            at, p, q, x, c, d, h = (v[on] for v in (at, p, q, x, c, d, h))
    out[at] = h
    return out


def beta_ratio(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b)."""
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(x, a, b))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (y > 0) & (y < 1)
    safe = np.where(inside, y, 0.5)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(safe) + q * np.log1p(-safe)) / p
    h = np.ones(p.shape)
    at = np.flatnonzero(inside)
    h.ravel()[at] = _beta_fraction(p.ravel()[at], q.ravel()[at], safe.ravel()[at])
    part = np.where(inside, front * h, np.where(y <= 0, 0.0, 1.0))
    return np.clip(np.where(swap, 1 - part, part), 0.0, 1.0)


def poisson_tails(k: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(X <= k) and P(X >= k)."""
    return upper_gamma(k + 1, lam), np.where(k > 0, 1 - upper_gamma(np.maximum(k, 1), lam), 1.0)


def nb_tails(k: np.ndarray, lam: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for variance lam + phi lam^2."""
    r = 1 / (phi + EPS)
    p = r / (r + lam + EPS)
    return beta_ratio(p, r, k + 1), np.where(k > 0, beta_ratio(1 - p, np.maximum(k, 1), r), 1.0)


def _tail_columns(discrete: str):
    @F.pandas_udf("low double, high double")
    def tails(k: pd.Series, lam: pd.Series, phi: pd.Series) -> pd.DataFrame:
        ok = (k.notna() & lam.notna() & phi.notna() & (lam > 0)).to_numpy()
        low, high = np.full(len(k), np.nan), np.full(len(k), np.nan)
        if ok.any():
            n, m, f = (np.asarray(v, float)[ok] for v in (k, lam, phi))
            low[ok], high[ok] = poisson_tails(np.rint(n), m) if discrete == "poisson" else nb_tails(np.rint(n), m, f)
        return pd.DataFrame({"low": low, "high": high})

    return tails


def count_outliers(windows: DataFrame, model: str = "nbinom", alpha: float = 1e-6, min_sites: int = 20, min_depth: float = 5.0, threshold: float = 0.05, use_median: bool = True, overdispersion: float = 1.0) -> DataFrame:
    """(chrom, win, sites, low_frac, high_frac, mu, phi) of windows where too many samples' depth sums stand out.

    A sample is expected to have lam = mu * sites * scale; its sum is judged by
    ``nbinom``, ``poisson``, ``normal`` (variance lam + phi lam^2) or
    ``ragweed`` (two standard deviations of the window's scaled depths). The
    dispersion phi is one for all windows. Samples without a scale never stand
    out, but count in the fractions. Null sums count as missing; an empty table gives an empty one.
    """
    if model not in ("nbinom", "poisson", "normal", "ragweed"):
        raise ValueError(f"unknown model {model}")
    mid = F.median if use_median else F.avg
    k, e = F.col("depth_sum").cast("double"), F.col("sites").cast("double")
    own = windows.where(F.col("sites") >= min_sites).groupBy("sample_ix").agg(mid(F.try_divide(k, e)).alias("own"))
    # one row a sample, and one row: the cohort bounds both
    scale = own.crossJoin(F.broadcast(own.agg(mid("own").alias("ref")))).select("sample_ix", F.try_divide("own", "ref").alias("s"))
    y = windows.join(scale, "sample_ix", "left").withColumn("y", F.try_divide(k, e * F.when(F.col("s") > 0, F.col("s"))))
    per = y.groupBy("chrom", "win").agg(mid("y").alias("mu"), F.avg("y").alias("m"), F.var_samp("y").alias("v"), F.max("sites").alias("n_sites"))
    per = per.where((F.col("n_sites") >= min_sites) & (F.col("mu") > 0) & (F.col("mu") >= min_depth))
    spread = F.greatest(F.try_divide(F.col("v") - F.col("m"), F.col("m") * F.col("m") + EPS), F.lit(0.0))
    phi = per.agg(mid(F.when(F.col("v").isNotNull(), spread)).alias("phi")).select(F.when(F.col("phi") > 0, F.col("phi")).otherwise(1e-6).alias("phi"))
    y = y.join(per.select("chrom", "win", "mu", "v", "n_sites"), ["chrom", "win"]).crossJoin(F.broadcast(phi))
    y = y.withColumn("lam", F.col("mu") * e * F.col("s"))
    if model in ("nbinom", "poisson"):
        y = y.withColumn("t", _tail_columns(model)(k, F.col("lam"), F.col("phi") * overdispersion))
        low, high = F.col("t.low") <= alpha, F.col("t.high") <= alpha
    else:
        if model == "normal":
            z, cut = F.try_divide(k - F.col("lam"), F.sqrt(F.col("lam") + F.col("phi") * F.col("lam") * F.col("lam"))), NormalDist().inv_cdf(alpha)
        else:
            z, cut = F.try_divide(F.col("y") - F.col("mu"), F.sqrt("v")), NormalDist().inv_cdf(2 * NormalDist().cdf(-2.0))
        low, high = z <= cut, z >= -cut
    frac = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    out = y.groupBy("chrom", "win").agg(F.max("n_sites").alias("sites"), frac(low).alias("low_frac"), frac(high).alias("high_frac"), F.max("mu").alias("mu"), F.max("phi").alias("phi"))
    return out.where((F.col("low_frac") >= threshold) | (F.col("high_frac") >= threshold))


def an_bin(an: Column, width: int, least: int, most: int) -> Column:
    """The bin of a number of called alleles, capped at ``most``; null below ``least``."""
    return F.when(an >= least, F.floor(F.least(an, F.lit(most)) / width).cast("int"))


def an_histogram(sites: DataFrame, an: Column, width: int, least: int, most: int) -> DataFrame:
    """(bin, n) over sites of ``least`` called alleles or more."""
    return sites.select(an_bin(an, width, least, most).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def collapse_bins(counts: list[int], width: int, least: int, enough: int) -> list[int]:
    """For each bin the bin its sites are projected to, 0 for bins that lie below ``least``.

    From the right, bins join until they hold ``enough`` sites and take the
    lowest one's size; what is left at the floor joins the group above it.
    """
    to, group, held, above = [0] * len(counts), [], 0, []
    for r in range(len(counts) - 1, -1, -1):
        if r * width < least:
            break
        group.append(r)
        held += counts[r]
        if held >= enough:
            above = list(group)
            for b in group:
                to[b] = r
            group, held = [], 0
    for b in group + (above if group else []):
        to[b] = group[-1]
    return to


def project_counts(df: DataFrame, n: int | str, key: str, counts: str = "counts", seed: int = 0) -> DataFrame:
    """(key, drawn): ``n``, a number or the column that has it, of the alleles behind ``counts``, drawn without replacement; null where there are fewer or none are known.

    The draw depends on ``seed`` and the key alone, so partitions and retries do not change it.
    """
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, c, size in zip(b[key], b[counts], b[n] if isinstance(n, str) else [n] * len(b), strict=True):
                if c is None or sum(c) < size:
                    out.append(None)
                    continue
                rng = np.random.default_rng([seed, zlib.crc32(str(k).encode())])
                out.append(rng.multivariate_hypergeometric(np.asarray(c, np.int64), size, method="marginals").astype(np.int32))
            yield pd.DataFrame({key: b[key], "drawn": pd.Series(out, index=b.index, dtype=object)})

    return df.select(key, counts, *([n] if isinstance(n, str) else [])).mapInPandas(draw, f"{key} {df.schema[key].dataType.simpleString()}, drawn array<int>")


def map_lines(points: DataFrame, least: float = 0.001, most: float = 25.0, fixed: float | None = None) -> DataFrame:
    """(chrom, phys, line) of a recombination map: position, rate within bounds, genetic position.

    A line holds the rate up to the next point, from (0, 0) on; the last point repeats the last rate.
    ``fixed`` replaces the rates.
    """
    start = points.select("chrom").distinct().select("chrom", F.lit(0).cast("long").alias("phys"), F.lit(0.0).alias("gen"))
    p = points.select("chrom", F.col("phys").cast("long").alias("phys"), F.col("gen").cast("double").alias("gen")).union(start)
    w = Window.partitionBy("chrom").orderBy("phys", "gen")
    slope = F.try_divide(F.lead("gen").over(w) - F.col("gen"), (F.lead("phys").over(w) - F.col("phys")).cast("double")) * 1e6
    p = p.withColumn("rate", slope if fixed is None else F.lit(float(fixed)))
    p = p.withColumn("rate", F.coalesce("rate", F.lag("rate").over(w)))
    rate = F.greatest(F.lit(least), F.least(F.lit(most), F.col("rate")))
    return p.select("chrom", "phys", F.format_string("%d\t%.3f\t%.5f", "phys", rate, "gen").alias("line"))


def beagle_map_lines(points: DataFrame) -> DataFrame:
    """(chrom, phys, line): chromosome, marker, genetic position to 5 digits, position."""
    return points.select("chrom", "phys", F.format_string("%s\t%s\t%.5f\t%d", "chrom", "marker", F.col("gen").cast("double"), F.col("phys").cast("long")).alias("line"))
