"""Updates, filters and polarisation of site tables (row to row; no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import site as S


def with_counts(sites: DataFrame) -> DataFrame:
    return sites.withColumn("counts", S.counts())


def _genotypes(f, gt: str = "gt") -> Column:
    """``gt`` with ``f`` applied to each allele code."""
    return F.transform(F.col(gt), lambda g: F.struct(f(g["a0"]).alias("a0"), f(g["a1"]).alias("a1"), g["phased"].alias("phased")))


def lowcount_to_miss(sites: DataFrame, most: int = 1) -> DataFrame:
    """Alleles called 1..most times become missing, their depths in ``ad`` 0; ``changed`` tells whether there were any."""
    s = with_counts(sites)
    rare = F.filter(F.transform("counts", lambda x, k: F.when((x >= 1) & (x <= most), k).otherwise(-1)), lambda k: k >= 0)
    s = s.withColumn("__rare", rare).withColumn("changed", F.size("__rare") > 0)
    s = s.withColumn("gt", _genotypes(lambda a: F.when(F.array_contains("__rare", a), -1).otherwise(a)))
    if "ad" in s.columns:
        s = s.withColumn("ad", F.transform("ad", lambda d: F.transform(d, lambda x, k: F.when(F.array_contains("__rare", k), 0).otherwise(x))))
    return s.drop("__rare", "counts")


def depth_to_miss(sites: DataFrame, least: int) -> DataFrame:
    """Calls of samples of less than ``least`` depth become missing, and where there is ``pl`` those of samples whose likelihoods tell nothing (the largest is 0)."""
    flat = (lambda i: F.coalesce(F.array_max(F.get("pl", i)) == 0, F.lit(False))) if "pl" in sites.columns else (lambda i: F.lit(False))
    gone = lambda g: F.struct(F.lit(-1).alias("a0"), F.lit(-1).alias("a1"), g["phased"].alias("phased"))
    return sites.withColumn("gt", F.transform("gt", lambda g, i: F.when((F.coalesce(F.get("dp", i), F.lit(0)) < least) | flat(i), gone(g)).otherwise(g)))


def _other(code: Column) -> Column:
    """0 for 1, 1 for 0, others as they are."""
    return F.when(code == 0, 1).when(code == 1, 0).otherwise(code)


def _swapped(s: DataFrame, when: Column | None = None) -> dict[str, Column]:
    """REF and first ALT exchanged, with the depths and likelihoods of both, where ``when`` holds."""
    out = {"ref": F.get("alt", F.lit(0)), "alt": F.concat(F.array("ref"), F.slice("alt", 2, F.greatest(F.size("alt"), F.lit(1))))}
    if "ad" in s.columns:
        out["ad"] = F.transform("ad", lambda d: F.transform(d, lambda x, k: F.get(d, _other(k))))
    if "pl" in s.columns:
        # the likelihood of alleles j <= k stands at k (k + 1) / 2 + j
        at = lambda j, k: (F.greatest(j, k) * (F.greatest(j, k) + 1) / 2).cast("int") + F.least(j, k)
        order = F.flatten(F.transform(F.sequence(F.lit(0), F.size("alt")), lambda k: F.transform(F.sequence(F.lit(0), k), lambda j: at(_other(j), _other(k)))))
        out["pl"] = F.transform("pl", lambda p: F.transform(F.slice(order, 1, F.greatest(F.size(p), F.lit(0))), lambda i: F.get(p, i)))
    return out if when is None else {c: F.when(when, x).otherwise(F.col(c)) for c, x in out.items()}


def flip(sites: DataFrame, when: Column | None = None) -> DataFrame:
    """REF and ALT swapped, 0 and 1 swapped, haplotypes in reverse order; for sites of one alternative (where ``when`` holds)."""
    gt = F.transform("gt", lambda g: F.struct(_other(g["a1"]).alias("a0"), _other(g["a0"]).alias("a1"), g["phased"].alias("phased")))
    return sites.withColumns({"gt": gt if when is None else F.when(when, gt).otherwise(F.col("gt")), **_swapped(sites, when)})


def polarise(sites: DataFrame, aa: str = "aa") -> DataFrame:
    """REF becomes the ancestral allele: sites whose AA is neither REF nor the first ALT go, sites without ALT stay."""
    alt = F.get("alt", F.lit(0))
    keep = (F.size("alt") == 0) | (F.col(aa) == F.col("ref")) | (F.col(aa) == alt)
    swap = F.col("__swap")
    s = sites.where(F.coalesce(keep, F.lit(False))).withColumn("__swap", F.coalesce(F.col(aa) == alt, F.lit(False)))
    return s.withColumns({"gt": _genotypes(lambda a: F.when(swap, _other(a)).otherwise(a)), **_swapped(s, swap)}).drop("__swap")


def select_samples(sites: DataFrame, index: list[int]) -> DataFrame:
    """The samples at these places, in this order."""
    pick = lambda c: F.transform(F.array(*[F.lit(i) for i in index]), lambda i: F.get(c, i))
    out = sites.withColumns({c: pick(F.col(c)) for c in ("gt", "dp", "ad", "pl") if c in sites.columns})
    return out.withColumn("raw", F.col("raw").withField("calls", pick(F.col("raw.calls")))) if "raw" in sites.columns else out


def filter_range(sites: DataFrame, lo: int, hi: int, maf: float | None = None, biallelic: bool = False) -> DataFrame:
    s = with_counts(sites.where(F.col("pos").between(lo, hi)))
    if maf is not None:
        s = s.where((S.allelicity() > 1) & (S.second_frac() > maf))
    if biallelic:
        s = s.where(S.allelicity() == 2)
    return s.drop("counts")


def filter_mac(sites: DataFrame, least: int) -> DataFrame:
    """The rarest observed allele of a site with two or more is called ``least`` times or more."""
    s = with_counts(sites)
    return s.where((S.allelicity() > 1) & (F.array_min(F.filter("counts", lambda x: x > 0)) >= least)).drop("counts")


def sample_missing_frac(gt: str = "gt") -> Column:
    return F.try_divide(F.size(F.filter(gt, lambda g: (g["a0"] < 0) | (g["a1"] < 0))).cast("double"), F.size(gt).cast("double"))


def filter_missing(sites: DataFrame, below: float) -> DataFrame:
    return sites.where(sample_missing_frac() < below)


def filter_depth(sites: DataFrame, least: int, frac: float) -> DataFrame:
    share = F.try_divide(F.size(F.filter("dp", lambda d: d >= least)).cast("double"), F.size("dp").cast("double"))
    return sites.where(share > frac)


def filter_missing_pops(sites: DataFrame, pops: dict[str, list[int]], least: int = 1) -> DataFrame:
    """Sites go where all samples of any population with ``least`` listed ids or more are missing."""
    void = F.lit(False)
    for ids in pops.values():
        if len(ids) >= least:
            void = void | F.forall(F.array(*[F.lit(i) for i in ids]), lambda i: F.get("gt", i)["a0"] < 0)
    return sites.where(~void)


def filter_outgroup(sites: DataFrame, index: list[int]) -> DataFrame:
    """Some outgroup sample has an allele 0 or 1."""
    own = F.array(*[F.lit(i) for i in index])
    return sites.where(F.exists(own, lambda i: F.get("gt", i)["a0"].isin(0, 1) | F.get("gt", i)["a1"].isin(0, 1)))


def quick_filter(sites: DataFrame, most_missing: float = 0.5, aa: str = "aa", rescue: int = 1, depth: int | None = None) -> DataFrame:
    """``sites`` with ``reason``, null for those that pass; the first test that fails names it.

    missing (or, with ``depth``, too many samples below it); nonallelic (no call, or over two alleles even when those called up to
    ``rescue`` times are ignored); missing once more for sites that were rescued by that, whose rare alleles
    are missing from then on (``rescued``); nonancestral (AA given, but not observed); noref; dels; ins (no SNP).
    """
    s = with_counts(sites)
    n = S.allelicity()
    saved = (n > 2) & F.size(F.filter("counts", lambda x: x > rescue)).isin(1, 2)
    lacking = lambda: S.missing_frac() if depth is None else S.low_depth_frac("dp", depth)
    first = F.when(lacking() > most_missing, "missing").when((n == 0) | ((n > 2) & ~saved), "nonallelic")
    s = s.withColumn("rescued", saved).withColumn("reason", first)
    rare = F.transform("counts", lambda x: (x >= 1) & (x <= rescue))
    s = s.withColumn("__rare", rare).withColumn("gt", _genotypes(lambda a: F.when(F.col("rescued") & F.coalesce(F.get("__rare", a), F.lit(False)), -1).otherwise(a)))
    if "ad" in s.columns:
        s = s.withColumn("ad", F.transform("ad", lambda d: F.transform(d, lambda x, k: F.when(F.col("rescued") & F.get("__rare", k), 0).otherwise(x))))
    s = with_counts(s)
    seen = F.array_contains(S.geno_alleles(), F.col(aa))
    later = F.when(F.col("rescued") & (lacking() > most_missing), "missing").when(F.col(aa).isNotNull() & ~seen, "nonancestral")
    later = later.when(~S.has_ref(), "noref").when(S.has_del(), "dels").when(S.is_nonsnp(), "ins")
    return s.withColumn("reason", F.coalesce("reason", later)).drop("__rare", "counts")


def thin_window(sites: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """One site a bucket of ``size`` bp, counted from a chromosome's first site; which one, the seed decides."""
    first = sites.groupBy("chrom").agg(F.min("pos").alias("__p0"))
    s = sites.join(first, "chrom").withColumn("__b", F.expr(f"(pos - __p0) div {size}"))
    w = Window.partitionBy("chrom", "__b").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "chrom", F.col("pos").cast("string"))), *S.order(sites))
    return s.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__p0", "__b", "__r")


def ancestral_majority(sites: DataFrame, monoallelic: bool = False, keep_singles: bool = False, multi: bool = False) -> DataFrame:
    """``aa`` by majority, with ``reason`` where none is given; the first rule that applies decides."""
    s = with_counts(sites)
    n, total = S.allelicity(), S.an()
    top = S.allele_of(S.major())
    few = F.lit(False) if keep_singles or monoallelic else (total - F.array_max("counts")) < 3
    reason = F.when(S.is_nonsnp(), "nonsnp").when(~S.has_data(), "nodata").when(n == 0, "nonallelic")
    reason = reason.when(n == 1, F.lit(None) if monoallelic else F.lit("mono"))
    if not multi:
        reason = reason.when(n > 2, "multi")
    reason = reason.when(~S.has_ref(), "noref").when(few, "single").when(top.isin("*", "N"), "del")
    return s.withColumn("reason", reason).withColumn("aa", F.when(F.col("reason").isNull(), top)).drop("counts")


def ancestral_outgroups(sites: DataFrame, one: str = "out1", two: str = "out2") -> DataFrame:
    """``aa`` from two outgroup bases and the major allele's share; ``reason`` names the rule that decided."""
    s = with_counts(sites)
    alt = S.geno_alt()
    share = F.try_divide(F.greatest(F.get("counts", F.lit(0)), F.array_max(F.slice("counts", 2, F.size("counts")))).cast("double"), (F.get("counts", F.lit(0)) + F.array_max(F.slice("counts", 2, F.size("counts")))).cast("double"))
    s = s.withColumn("__mf", share)
    seen = S.geno_alleles()
    in1, in2 = F.array_contains(seen, F.col(one)), F.array_contains(seen, F.col(two))
    mf, top = F.col("__mf"), S.allele_of(S.major())
    none = (F.col(one) == "N") & (F.col(two) == "N")
    rule = F.when(S.allelicity() != 2, "nonbiallelic").when(~S.has_ref(), "noref").when(none & (mf <= 0.95), "nooutgroup").when(mf > 0.98, "singleton").when(~in1 & ~in2 & (mf <= 0.95), "orthogonal").when(in1 & (F.col(one) == F.col(two)), "agree").when(mf > 0.95, "majority").when(in1 & ~in2, "first").when(in2 & ~in1, "second").otherwise("conflict")
    s = s.withColumn("rule", rule)
    aa = F.when(F.col("rule").isin("singleton", "majority"), top).when(F.col("rule").isin("agree", "first"), F.col(one)).when(F.col("rule") == "second", F.col(two))
    return s.withColumn("aa", aa).withColumn("geno_alt", alt).drop("counts", "__mf")


def post_est(sites: DataFrame, p: str = "p", threshold: float = 0.8) -> DataFrame:
    """AA and AAP from P(major is ancestral): above 1 - (1 - t) the major, below 1 - t the second; else none."""
    s, t = with_counts(sites), 1 - threshold
    aa = F.when(S.allelicity() == 1, S.allele_of(S.major())).when(F.col(p) > 1 - t, S.allele_of(S.major())).when(F.col(p) < t, S.allele_of(S.second()))
    aap = F.when(S.allelicity() == 1, F.lit(1.0)).when(F.col(p) > 1 - t, F.col(p)).when(F.col(p) < t, 1 - F.col(p))
    return s.withColumn("aa", aa).withColumn("aap", aap).drop("counts")
