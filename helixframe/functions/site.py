"""Site expressions: columns computed from gt, dp, ad, ref and alt with array functions, no shuffle.

``gt`` is array<struct<a0, a1, phased>>, a missing allele is -1. Every
function takes columns (or their names) and gives a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def order(sites) -> list[str]:
    """Columns that order the sites of a chromosome: the position, then what tells sites of one position apart."""
    return ["pos", *(c for c in ("site_ord", "site_id", "ref") if c in sites.columns)]


def called(gt="gt") -> Column:
    """The called allele codes of both haplotypes of all samples."""
    return F.filter(F.flatten(F.transform(_c(gt), lambda g: F.array(g["a0"], g["a1"]))), lambda a: a >= 0)


def missing_frac(gt="gt") -> Column:
    """The share of missing alleles over two haplotypes a sample; null without samples."""
    n = 2 * F.size(_c(gt))
    return F.try_divide((n - F.size(called(gt))).cast("double"), n.cast("double"))


def counts(gt="gt", alt="alt") -> Column:
    """How often each allele code 0..size(alt) is called."""
    got = called(gt)
    return F.transform(F.sequence(F.lit(0), F.size(_c(alt))), lambda k: F.size(F.filter(got, lambda a: a == k)))


def observed(cnt="counts") -> Column:
    """Allele codes that are called at least once, ascending."""
    c = _c(cnt)
    return F.filter(F.transform(c, lambda x, k: F.when(x > 0, k).otherwise(-1)), lambda k: k >= 0)


def allelicity(cnt="counts") -> Column:
    return F.size(F.filter(_c(cnt), lambda x: x > 0))


def ref_is_sv(ref="ref") -> Column:
    return F.length(_c(ref)) > 1


def is_nonsnp(ref="ref", alt="alt") -> Column:
    """A reference longer than a base, or an alternative that is symbolic or no single base."""
    return ref_is_sv(ref) | F.exists(_c(alt), lambda a: (F.length(a) != 1) | a.startswith("<"))


def is_ordered(cnt="counts") -> Column:
    n = allelicity(cnt)
    return F.forall(observed(cnt), lambda k: k < n)


def _ranked(cnt) -> Column:
    """(count, code) of observed alleles, most frequent first, ties to the lower code."""
    pairs = F.filter(F.transform(_c(cnt), lambda x, k: F.struct((-x).alias("n"), k.alias("k"))), lambda p: p["n"] < 0)
    return F.array_sort(pairs)


def major(cnt="counts") -> Column:
    return F.get(_ranked(cnt), F.lit(0))["k"]


def second(cnt="counts") -> Column:
    """The second most frequent allele; among equals the higher code after the major one."""
    return F.get(_ranked(cnt), F.lit(1))["k"]


def second_count(cnt="counts") -> Column:
    return -F.get(_ranked(cnt), F.lit(1))["n"]


def second_frac(cnt="counts") -> Column:
    return F.try_divide(second_count(cnt).cast("double"), an(cnt).cast("double"))


def minor(cnt="counts") -> Column:
    """The rarer allele of a biallelic site (ties to the lower code), else null."""
    pairs = F.filter(F.transform(_c(cnt), lambda x, k: F.struct(x.alias("n"), k.alias("k"))), lambda p: p["n"] > 0)
    return F.when(allelicity(cnt) == 2, F.get(F.array_sort(pairs), F.lit(0))["k"])


def an(cnt="counts") -> Column:
    return F.aggregate(_c(cnt), F.lit(0), lambda s, x: s + x)


def depth(dp="dp") -> Column:
    """The sum of depths as they are (negative marks included)."""
    return F.aggregate(F.coalesce(_c(dp), F.array().cast("array<int>")), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))


def depths_from_alleles(ad="ad") -> Column:
    return F.transform(_c(ad), lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x))


def low_depth_frac(dp="dp", below: int = 3) -> Column:
    d = _c(dp)
    return F.try_divide(F.size(F.filter(d, lambda x: x < below)).cast("double"), F.size(d).cast("double"))


def has_data(dp="dp") -> Column:
    """Any depth above 3."""
    return F.exists(_c(dp), lambda x: x > 3)


def alleles(ref="ref", alt="alt") -> Column:
    return F.concat(F.array(_c(ref)), _c(alt))


def allele_of(code: Column, ref="ref", alt="alt") -> Column:
    return F.get(alleles(ref, alt), code)


def geno_alleles(cnt="counts", ref="ref", alt="alt") -> Column:
    every = alleles(ref, alt)
    return F.transform(observed(cnt), lambda k: F.get(every, k))


def has_ref(cnt="counts") -> Column:
    return F.get(_c(cnt), F.lit(0)) > 0


def has_del(cnt="counts", ref="ref", alt="alt") -> Column:
    return F.arrays_overlap(geno_alleles(cnt, ref, alt), F.array(F.lit("*"), F.lit("N")))


def has_count(cnt="counts", n: int = 1) -> Column:
    return F.exists(_c(cnt), lambda x: x == n)


def has_lowcount(cnt="counts", most: int = 1) -> Column:
    return F.exists(_c(cnt), lambda x: (x >= 1) & (x <= most))


def geno_ref(cnt="counts", ref="ref", alt="alt") -> Column:
    """The first observed allele."""
    return F.get(geno_alleles(cnt, ref, alt), F.lit(0))


def geno_alt(cnt="counts", ref="ref", alt="alt") -> Column:
    """The most frequent observed allele after the first one."""
    rest = F.slice(F.filter(F.transform(_c(cnt), lambda x, k: F.struct((-x).alias("n"), k.alias("k"))), lambda p: p["n"] < 0), 2, F.greatest(F.lit(1), F.size(_c(cnt))))
    return F.get(alleles(ref, alt), F.get(F.array_sort(rest), F.lit(0))["k"])


def passes_filter(cnt="counts", ref="ref", alt="alt", mono: bool = False, multi: bool = False, nonsnp: bool = False, bi: bool = True, badref: bool = False) -> Column:
    """The first rule that applies decides: no call; long reference; monoallelic; non-SNP; multiallelic; biallelic."""
    n, odd = allelicity(cnt), is_nonsnp(ref, alt)
    rules = F.when(n == 0, False)
    if not badref:
        rules = rules.when(ref_is_sv(ref), False)
    if mono:
        rules = rules.when(n == 1, True)
    if not nonsnp:
        rules = rules.when(odd, False)
    if multi:
        rules = rules.when(n > 2, True)
    if nonsnp:
        rules = rules.when(odd, True)
    if bi:
        rules = rules.when(n == 2, True)
    return rules.otherwise(False)


def trimmed(chrom="chrom", pos="pos", id_="id", ref="ref", alt="alt") -> Column:
    return F.concat_ws("\t", _c(chrom), _c(pos).cast("string"), F.coalesce(_c(id_), F.lit(".")), _c(ref), F.concat_ws(",", _c(alt)))


def likelihoods(pl: Column) -> Column:
    """Phred values to likelihoods that add up to 1; equal ones where any value is missing."""
    p = F.transform(pl, lambda q: F.pow(F.lit(10.0), -q / 10.0))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    bad = F.exists(pl, lambda q: q.isNull() | F.isnan(q)) | (F.size(pl) == 0) | (total == 0)
    even = F.transform(pl, lambda _: F.try_divide(F.lit(1.0), F.size(pl).cast("double")))
    return F.when(pl.isNull() | bad, even).otherwise(F.transform(p, lambda x: F.try_divide(x, total)))


def age_columns(cnt="counts") -> tuple[Column, Column]:
    """(age, af) with x = 1 - max / sum: floor(-2x / (1-x) ln x, 4 digits), floor(x, 3 digits); null if monoallelic."""
    x = 1.0 - F.array_max(_c(cnt)).cast("double") / F.greatest(an(cnt), F.lit(1)).cast("double")
    age = F.floor(-2.0 * x / (1.0 - x) * F.ln(x) * 1e4) / 1e4
    many = allelicity(cnt) > 1
    return F.when(many, age), F.when(many, F.floor(x * 1e3) / 1e3)
