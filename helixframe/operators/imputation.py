"""Genotypes taken over from another table, and ancestral alleles set from outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import names as N
from helixframe.functions import site as S
from helixframe.operators.joins import compare
from helixframe.operators.sites import flip

#: The code of a base that the site's own alleles lack.
UNKNOWN = -9


def replace_genotypes(pairs: DataFrame) -> DataFrame:
    """Pairs (l, r) of sites: ``l`` with the genotypes of ``r``, whose codes are put into l's alleles.

    A pair goes if r calls an allele that l does not call itself (allele lists that differ), compared by base; with
    equal allele lists the genotypes are taken as they are.
    """
    mine, other = (F.concat(F.array(f"{x}.ref"), F.col(f"{x}.alt")) for x in ("l", "r"))
    at = lambda b: F.array_position(mine, b).cast("int")
    p = pairs.withColumn("__same", mine == other).withColumn("__code", F.transform(other, lambda b: F.when(at(b) > 0, at(b) - 1).otherwise(UNKNOWN)))
    put = lambda a: F.when(a < 0, a).otherwise(F.coalesce(F.get("__code", a), F.lit(UNKNOWN)))
    gt = F.transform("r.gt", lambda g: F.struct(put(g["a0"]).alias("a0"), put(g["a1"]).alias("a1"), g["phased"].alias("phased")))
    p = p.withColumn("__gt", F.when(F.col("__same"), F.col("r.gt")).otherwise(gt))
    used = F.array_distinct(F.filter(F.flatten(F.transform("__gt", lambda g: F.array(g["a0"], g["a1"]))), lambda a: a != -1))
    known = S.observed(S.counts("l.gt", "l.alt"))
    p = p.where(F.col("__same") | (F.size(F.array_except(used, known)) == 0))
    return p.select(F.col("l").withField("gt", F.col("__gt")).alias("site")).select("site.*")


def substitute(source: DataFrame, template: DataFrame, order: list[str]) -> DataFrame:
    """The sites of ``source`` that ``template`` has too, with the template's genotypes."""
    return replace_genotypes(compare(source, template, "intersect", order))


def restore_missing(template: DataFrame, imputed: DataFrame, order: list[str]) -> DataFrame:
    """The template's rows with imputed genotypes, but where the template has none: there a phased null. A site that only one of both has is an error."""
    pairs = compare(template, imputed, "all", order)
    null = F.struct(F.lit(-1).alias("a0"), F.lit(-1).alias("a1"), F.lit(True).alias("phased"))
    place = F.concat(F.lit("only one table has "), "chrom", F.lit(":"), F.col("pos").cast("string"))
    alone = F.raise_error(place).cast(template.schema["gt"].dataType)
    merged = F.zip_with("l.gt", "r.gt", lambda a, b: F.when(N.is_null_call(a), null).otherwise(b))
    gt = F.when(F.col("l").isNull() | F.col("r").isNull(), alone).otherwise(merged)
    return pairs.select(*[(gt if c == "gt" else F.col(f"l.{c}")).alias(c) for c in template.columns])


def dummy_chromosome(sites: DataFrame, lo: int, hi: int, name: str) -> DataFrame:
    """The sites of a stretch as a chromosome of its own, counted from 1."""
    return sites.where(F.col("pos").between(lo, hi)).withColumns({"chrom": F.lit(name), "pos": F.col("pos") - lo + 1})


def homozygotes(gt: str = "gt") -> tuple[Column, Column]:
    """How many samples have the reference twice, and how many some other allele twice."""
    twice = lambda ok: F.size(F.filter(gt, lambda g: (g["a0"] == g["a1"]) & ok(g["a0"])))
    return twice(lambda a: a == 0), twice(lambda a: a > 0)


def ancestral_by_homozygotes(sites: DataFrame) -> DataFrame:
    """``aa``: the first ALT where more samples have an alternative twice than the reference, else null."""
    ref, alt = homozygotes()
    return sites.withColumn("aa", F.when(alt > ref, F.get("alt", F.lit(0))))


def flip_by_states(sites: DataFrame, states: DataFrame, on: list[str], drop_unresolved: bool = False) -> DataFrame:
    """Sites flipped where a node's ``state`` is not REF; with ``drop_unresolved``, flipped only where it is the first ALT, and
    gone where it is neither."""
    s = sites.join(states.select(*on, F.col("state").alias("__state")), on)
    if drop_unresolved:
        s = s.where((F.col("__state") == F.col("ref")) | (F.col("__state") == F.get("alt", F.lit(0))))
    s = s.withColumn("flipped", F.col("__state") != F.col("ref")).drop("__state")
    return flip(s, F.col("flipped"))


def flip_by_probability(sites: DataFrame, p: str = "p", below: float = 0.5) -> DataFrame:
    """Sites flipped where P(the major allele is ancestral) is under ``below``; null leaves a site as it is."""
    s = sites.withColumn("flipped", F.coalesce(F.col(p) < below, F.lit(False)))
    return flip(s, F.col("flipped"))


def flip_share(rows: DataFrame, p: str = "p", below: float = 0.5) -> DataFrame:
    """One row: sites with P under ``below``, all of them, and the share."""
    out = rows.agg(F.count_if(F.col(p) < below).alias("flipped"), F.count("*").alias("sites"))
    return out.withColumn("frac", F.try_divide(F.col("flipped").cast("double"), F.col("sites").cast("double")))
