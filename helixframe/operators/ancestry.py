"""Ancestral alleles by genotype classes and outgroup sequences, and checks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import site as S
from helixframe.operators.export import BASES, one_hot
from helixframe.operators.joins import number_duplicates


def genotype_counts(gt: str = "gt") -> tuple[Column, Column, Column]:
    """Calls of both alleles that are: reference twice, two different alleles, one alternative twice."""
    full = F.filter(gt, lambda g: (g["a0"] >= 0) & (g["a1"] >= 0))
    n = lambda f: F.size(F.filter(full, f))
    return n(lambda g: (g["a0"] == 0) & (g["a1"] == 0)), n(lambda g: g["a0"] != g["a1"]), n(lambda g: (g["a0"] == g["a1"]) & (g["a0"] > 0))


def ancestral_by_probability(sites: DataFrame, p: str = "p", threshold: float = 0.05, least: int = 3) -> DataFrame:
    """``aa`` from P(major is ancestral), with ``reason`` and ``against`` (the major allele is not taken).

    mono: no ALT, or fewer than ``least`` alternative alleles by genotype classes; multi: several ALT; ambiguous: P between
    the thresholds, or null; else flipped (ALT is ancestral) or unflipped. REF is major if it is more frequent.
    """
    ref, het, alt = genotype_counts()
    n_ref, n_alt = 2 * ref + het, 2 * alt + het
    up, down = F.col(p) > 1 - threshold, F.col(p) < threshold
    to_ref = (up & (n_ref > n_alt)) | (down & (n_ref <= n_alt))
    reason = F.when((F.size("alt") == 0) | (n_alt < least), "mono").when(F.size("alt") > 1, "multi").when(~F.coalesce(up | down, F.lit(False)), "ambiguous")
    s = sites.withColumn("reason", reason.when(to_ref, "unflipped").otherwise("flipped"))
    kept = F.col("reason").isin("flipped", "unflipped")
    first = F.when(F.col("reason") == "unflipped", F.col("ref")).when(F.col("reason") == "flipped", F.get("alt", F.lit(0)))
    return s.withColumn("aa", first).withColumn("against", kept & down)


def outgroup_lines(sites: DataFrame, one: str = "out1", two: str = "out2") -> DataFrame:
    """``line`` of counts and both outgroup bases for the inference of ancestral alleles, with ``reason`` where a site has none.

    The first that applies: missing (both bases N or null), nonsnp, multi (several ALT), orthogonal (neither base is an
    allele). ``mono`` tells sites without alternative calls, which stay; ``minor1``, ``minor2``: the base is not REF.
    """
    ref, het, alt = genotype_counts()
    a, b = (F.upper(F.coalesce(F.col(c), F.lit("N"))) for c in (one, two))
    every = S.alleles()
    reason = F.when((a == "N") & (b == "N"), "missing").when(S.is_nonsnp(), "nonsnp").when(F.size("alt") > 1, "multi")
    reason = reason.when(~F.array_contains(every, a) & ~F.array_contains(every, b), "orthogonal")
    other = F.get("alt", F.lit(0))
    counts = F.concat_ws(",", *[F.when(F.col("ref") == x, 2 * ref + het).when(other == x, 2 * alt + het).otherwise(0).cast("string") for x in BASES])
    s = sites.withColumn("reason", reason).withColumn("mono", ~F.exists(S.called(), lambda k: k > 0))
    coded = F.col("reason").isNull()
    return s.withColumns({"line": F.when(coded, F.concat_ws("\t", counts, one_hot(a), one_hot(b))), "minor1": F.when(coded, a != F.col("ref")), "minor2": F.when(coded, b != F.col("ref"))})


def outgroup_report(lines: DataFrame) -> DataFrame:
    """One row of counts over ``outgroup_lines``."""
    why = lambda r: F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(r)
    side = lambda c, k: [F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(f"minority{k}"), F.count_if(F.coalesce(~F.col(c), F.lit(False))).alias(f"majority{k}")]
    seen = F.coalesce(F.col("reason").isNull() | (F.col("reason") == "orthogonal"), F.lit(True))
    return lines.agg(why("missing"), why("multi"), why("orthogonal"), F.count_if(seen & F.col("mono")).alias("mono"), *side("minor1", 1), *side("minor2", 2))


def ancestral_is_ref(base: Column, ref: str = "ref", alt: str = "alt", unresolved: bool = False) -> Column:
    """1 where an inferred base is REF, 0 where it is the first ALT; anything else is an error.

    With ``unresolved`` a code that is no base gives 2 instead.
    """
    b, r, a = F.upper(base), F.upper(F.col(ref)), F.upper(F.get(alt, F.lit(0)))
    fits = F.coalesce(b.isin(*BASES), F.lit(False))
    odd = F.lit(2) if unresolved else F.raise_error(F.concat(F.lit("no base: "), F.coalesce(b, F.lit("null")))).cast("int")
    return F.when(~fits, odd).when(b == r, 1).when(b == a, 0).otherwise(F.raise_error(F.concat(F.lit("no allele of the site: "), b)).cast("int"))


def agreement(sites: DataFrame, aa: str = "aa", one: str = "out1", two: str = "out2") -> DataFrame:
    """One row: how AA agrees with REF, the major allele and the outgroups at sites of over two alleles, those whose AA
    is N (ambiguous) left out, and at how many sites of one allele AA is not REF (mono_other)."""
    s = sites.withColumn("counts", S.counts())
    a, many = F.coalesce(F.col(aa), F.lit("N")), S.allelicity() > 2
    s = s.select(a.alias("aa"), "ref", S.allele_of(S.major()).alias("top"), (S.allelicity() == 1).alias("mono"), many.alias("many"), F.coalesce((a == F.col(one)) | (a == F.col(two)), F.lit(False)).alias("out"))
    use = F.col("many") & (F.col("aa") != "N")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    is_ref, is_top = F.col("aa") == F.col("ref"), F.col("aa") == F.col("top")
    return s.agg(n(use & is_ref).alias("ref"), n(use & ~is_ref).alias("alt"), n(use & is_top).alias("major"), n(use & ~is_top).alias("minor"), n(use & F.col("out")).alias("outgroup"), n(use & ~F.col("out")).alias("no_outgroup"), n(F.col("mono") & ~is_ref).alias("mono_other"), n(F.col("many") & (F.col("aa") == "N")).alias("ambiguous"))


def copy_ancestral(sites: DataFrame, template: DataFrame, aa: str = "aa") -> DataFrame:
    """``sites`` with the AA of the row of the same place in ``template``; rows that stand at one position pair in
    order, and a row that only one table has is an error."""
    left = number_duplicates(sites.drop(aa), S.order(sites))
    right = number_duplicates(template, S.order(template)).select("chrom", "pos", "dup_ix", F.col(aa).alias("__aa"), F.lit(True).alias("__in"))
    s = left.withColumn("__own", F.lit(True)).join(right, ["chrom", "pos", "dup_ix"], "full")
    where = F.concat(F.lit("only one table has "), F.col("chrom"), F.lit(":"), F.col("pos").cast("string"))
    got = F.when(F.col("__own").isNull() | F.col("__in").isNull(), F.raise_error(where).cast("string")).otherwise(F.col("__aa"))
    return s.withColumn(aa, got).drop("dup_ix", "__own", "__in", "__aa")
