"""Ancestral alleles by an EST-SFS run over bins of sample size: sites to input lines, and results back to sites.

The number of called alleles is cut into bins; small bins join the one below them until they
hold enough sites (``count_models.collapse_bins``, over a histogram with a row a bin). In a second
pass, which depends on these bins, each site's alleles are drawn down to the size of its bin and the site gets its
place among its bin's lines. Places are counted in parallel: sites of a bin in each stretch of a chromosome, summed over
stretches, then within one. The program's results come back by (bin, place).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import site as S
from helixframe.operators import binned as B
from helixframe.operators import count_models as C
from helixframe.operators import export as X
from helixframe.session import Kept


def eligible(sites: DataFrame, one: str = "out1", two: str = "out2", least: int = 20, mono: bool = True, multi: bool = False, nonsnp: bool = False) -> DataFrame:
    """Sites, with their counts, that a run can use: of a kind that is kept, no deletion seen, ``least`` alleles called, and an
    outgroup base, of two that are not both N, that the cohort has."""
    s = sites.withColumn("counts", S.counts())
    base = lambda c: F.coalesce(F.col(c), F.lit("N"))
    seen = lambda c: F.array_contains(S.geno_alleles(), base(c))
    known = (base(one) != "N") | (base(two) != "N")
    keep = S.passes_filter(mono=mono, multi=multi, nonsnp=nonsnp) & ~S.has_del() & (S.an() >= least) & known & (seen(one) | seen(two))
    return s.where(F.coalesce(keep, F.lit(False)))


def bin_sizes(sites: DataFrame, width: int, least: int, most: int, enough: int) -> dict[int, int]:
    """{bin of a site: size it is drawn down to}, from the sites' histogram (a row a bin of the cohort's alleles). Bins below ``least`` have none."""
    held = {r["bin"]: r["n"] for r in C.an_histogram(sites, S.an(), width, least, most).collect()}
    to = C.collapse_bins([held.get(b, 0) for b in range(most // width + 1)], width, least, enough)
    return {b: t * width for b, t in enumerate(to) if t}


def placed(sites: DataFrame, key: str, order: list[str], name: str = "ord", width: int = B.WIDTH) -> DataFrame:
    """``sites`` with their place, from 1, among the rows of a ``key`` over all chromosomes, in order of chromosome and ``order``."""
    s = B.with_bin(sites, width)
    # a row a key and stretch of a chromosome
    per = s.groupBy(key, "chrom", "__bin").agg(F.count("*").alias("__k"))
    w = Window.partitionBy(key).orderBy("chrom", "__bin").rowsBetween(Window.unboundedPreceding, -1)
    start = per.select(key, "chrom", "__bin", F.coalesce(F.sum("__k").over(w), F.lit(0)).alias("__start"))
    at = F.row_number().over(Window.partitionBy(key, "chrom", "__bin").orderBy(*order))
    return s.join(start, [key, "chrom", "__bin"]).withColumn(name, F.col("__start") + at).drop("__start", "__bin")


def preprocess(sites: DataFrame, key: str, width: int = 5, least: int = 20, enough: int = 10_000, most: int | None = None, one: str = "out1", two: str = "out2", seed: int = 0, bin_width: int = B.WIDTH, **kinds: bool) -> DataFrame:
    """Eligible sites with ``bin`` (the size they are drawn down to), ``ord`` (their place in it), and the three columns of
    their line: ``pop`` (drawn counts of A, C, G, T), ``anc1``, ``anc2``.

    ``key`` names a site; the draw depends on it and ``seed`` alone. ``most`` defaults to all alleles of the cohort.
    """
    spark = sites.sparkSession
    s = Kept(spark, "est").keep(eligible(sites, one, two, least, **kinds))
    if most is None:
        most = 2 * (s.agg(F.max(F.size("gt"))).first()[0] or 0)
    sizes = bin_sizes(s, width, least, most, enough)
    # bins of a cohort: a number for each ``width`` alleles
    size = F.element_at(F.create_map(*[F.lit(x) for b in sizes.items() for x in b]), C.an_bin(S.an(), width, least, most)) if sizes else F.lit(None).cast("int")
    s = placed(s.withColumn("bin", size).where("bin is not null"), "bin", S.order(sites), width=bin_width)
    drawn = C.project_counts(s.select(key, "counts", "bin"), "bin", key, seed=seed).withColumnRenamed("drawn", "__drawn")
    s = s.join(drawn, key)
    base = lambda c: F.coalesce(F.col(c), F.lit("N"))
    return s.withColumns({"pop": X.acgt("__drawn"), "anc1": X.one_hot(base(one)), "anc2": X.one_hot(base(two))}).drop("__drawn")


def lines(pre: DataFrame) -> DataFrame:
    """(bin, ord, line) of a run's input files, one a bin."""
    return pre.select("bin", "ord", F.concat_ws("\t", "pop", "anc1", "anc2").alias("line"))


def gather(pre: DataFrame, results: DataFrame) -> DataFrame:
    """``pre`` with ``p`` of the results (bin, ord, p); a site without a result, or a result without a site, is an error."""
    both = pre.withColumn("__site", F.lit(True)).join(results.withColumn("__result", F.lit(True)), ["bin", "ord"], "full")
    lacking = F.when(F.col("__site").isNull(), F.concat(F.lit("no site for result "), "bin", F.lit(":"), "ord")).when(F.col("__result").isNull(), F.concat(F.lit("no result for site "), "bin", F.lit(":"), "ord"))
    checked = F.when(lacking.isNotNull(), F.raise_error(lacking).cast("double")).otherwise(F.col("p"))
    return both.withColumn("p", checked).drop("__site", "__result")


def assign(sites: DataFrame, cut: float = 0.05, keep_ambiguous: bool = False) -> DataFrame:
    """``aa`` and ``aap`` from ``p``, the probability that the major allele is ancestral: the major where one allele is seen or p is
    above 1 - ``cut``, the second below ``cut``; others are N or go."""
    s = sites.withColumn("counts", S.counts())
    p, mono = F.col("p"), S.allelicity() == 1
    top, next_ = S.allele_of(S.major()), S.allele_of(S.second())
    aa = F.when(mono | (p > 1 - cut), top).when(p < cut, next_).otherwise("N")
    aap = F.when(~mono & (p < cut), 1 - p).otherwise(p)
    out = s.withColumns({"aa": aa, "aap": aap}).drop("counts")
    return out if keep_ambiguous else out.where("aa <> 'N'")


def infer(sites: DataFrame, key: str, run: Callable[[DataFrame], DataFrame], cut: float = 0.05, keep_ambiguous: bool = False, **options) -> DataFrame:
    """The whole way: ``run`` turns input lines (bin, ord, line) into results (bin, ord, p), an outside program's or any other's."""
    pre = Kept(sites.sparkSession, "est").keep(preprocess(sites, key, **options))
    return assign(gather(pre, run(lines(pre))), cut, keep_ambiguous)
