"""Converters from site tables to the lines of other formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import site as S
from helixframe.operators import binned as B
from helixframe.operators.windows import running_counts

BASES = "ACGT"


def acgt(cnt: str = "counts", ref: str = "ref", alt: str = "alt") -> Column:
    """Counts of A, C, G and T, joined by commas."""
    every = S.alleles(ref, alt)
    one = lambda b: F.coalesce(F.get(cnt, F.array_position(every, b).cast("int") - 1), F.lit(0)).cast("string")
    return F.concat_ws(",", *[F.when(F.array_contains(every, b), one(b)).otherwise("0") for b in BASES])


def one_hot(base: Column) -> Column:
    """1 for the base among A, C, G, T; zeros for anything else."""
    return F.concat_ws(",", *[F.when(base == b, "1").otherwise("0") for b in BASES])


def beagle(sites: DataFrame) -> DataFrame:
    """marker, alleleA, alleleB and three likelihoods a sample to 4 digits, of biallelic sites of one ALT."""
    s = sites.where((F.size("alt") == 1) & (S.allelicity(S.counts()) == 2))
    lik = F.flatten(F.transform("pl", lambda p: F.transform(S.likelihoods(p), lambda x: F.bround(x, 4))))
    return s.select(F.concat_ws("_", "chrom", F.col("pos").cast("string")).alias("marker"), F.col("ref").alias("alleleA"), F.get("alt", F.lit(0)).alias("alleleB"), lik.alias("likelihoods"))


def sweep_frequencies(sites: DataFrame) -> DataFrame:
    """chrom, pos, x, n, folded of mono- and biallelic sites: x calls of the second observed allele (0 or all if monoallelic)."""
    s = sites.withColumn("counts", S.counts()).where(S.allelicity().isin(1, 2))
    later = F.get("counts", F.get(S.observed(), F.lit(1)))
    x = F.when(S.allelicity() == 2, later).when(S.has_ref(), 0).otherwise(S.an())
    return s.select("chrom", "pos", x.cast("long").alias("x"), S.an().cast("long").alias("n"), F.lit(1).alias("folded"))


def haplotypes(sites: DataFrame, aa: str = "aa", bin_width: int = B.WIDTH) -> DataFrame:
    """chrom, pos, haps (0 ancestral, 1 derived, -1 missing), dist: biallelic sites whose AA is observed; dist counts the records
    up to the next one, 1 at the end."""
    s = B.numbered(sites.withColumn("counts", S.counts()), S.order(sites), bin_width)
    s = s.withColumn("__anc", F.array_position(S.alleles(), F.col(aa)).cast("int") - 1)
    s = s.where((S.allelicity() == 2) & F.array_contains(S.geno_alleles(), F.col(aa)))
    s = s.join(B.carried(s, later=True, __after=(F.min("__n"), "last")), ["chrom", "__bin"])
    up = F.coalesce(F.lead("__n").over(B.in_bin("__n")), "__after") - F.col("__n")
    hap = F.flatten(F.transform("gt", lambda g: F.transform(F.array(g["a0"], g["a1"]), lambda a: F.when(a < 0, -1).when(a == F.col("__anc"), 0).otherwise(1))))
    return s.select("chrom", "pos", hap.alias("haps"), F.coalesce(up, F.lit(1)).cast("int").alias("dist"))


def msmc(sites: DataFrame) -> DataFrame:
    """chrom, pos, nsites, haps: biallelic sites, alleles as bases, ? where missing."""
    every = S.alleles()
    base = lambda a: F.when(a < 0, F.lit("?")).otherwise(F.get(every, a))
    text = F.array_join(F.flatten(F.transform("gt", lambda g: F.array(base(g["a0"]), base(g["a1"])))), "")
    return running_counts(sites, S.allelicity(S.counts()) == 2).select("chrom", "pos", "nsites", text.alias("haps"))


def geno(gt: str = "gt") -> Column:
    """A digit a sample: the sum of both alleles, 9 where either is missing."""
    return F.array_join(F.transform(gt, lambda g: F.when((g["a0"] < 0) | (g["a1"] < 0), F.lit("9")).otherwise((g["a0"] + g["a1"]).cast("string"))), "")


def treemix(pop_counts: DataFrame) -> DataFrame:
    """chrom, pos, line: ``n0,n1`` a population, in the order of their names."""
    cell = F.struct("pop", F.concat_ws(",", F.col("n0").cast("string"), F.col("n1").cast("string")).alias("c"))
    return pop_counts.groupBy("chrom", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["c"]), " ").alias("line"))


def consensus(masks: DataFrame, threshold: float, n: int, mask: str | None = None) -> DataFrame:
    """(contig, pos, code) from (contig, pos, code) rows of n masks: C if enough are C, else A if enough are A or C, else N.

    With ``mask``, the column that tells the masks apart, masks that differ in a contig or its length are an error.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    need = -int(-threshold * n // 1)
    c, a = F.count_if(F.col("code") == "C"), F.count_if(F.col("code").isin("A", "C"))
    out = masks.groupBy("contig", "pos").agg(F.when(c >= need, "C").when(a >= need, "A").otherwise("N").alias("code"))
    if mask is None:
        return out
    # a row a contig and mask, then a row a contig
    per = masks.groupBy("contig", mask).agg(F.max("pos").alias("length"))
    same = per.groupBy("contig").agg(F.count("*").alias("k"), F.min("length").alias("lo"), F.max("length").alias("hi"))
    bad = F.raise_error(F.concat(F.lit("masks differ in contig "), "contig")).cast("string")
    same = same.select("contig", F.when((F.col("k") == n) & (F.col("lo") == F.col("hi")), F.lit("")).otherwise(bad).alias("__same"))
    return out.join(same, "contig").withColumn("code", F.concat("__same", "code")).drop("__same")


def _offsets(chunks: DataFrame) -> DataFrame:
    """``chunks`` (contig, chunk, seq) with ``__from``, the bases of the contig before; only lengths are summed up, a row a chunk."""
    w = Window.partitionBy("contig").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    at = chunks.select("contig", "chunk", F.length("seq").alias("__n")).select("contig", "chunk", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__from"))
    return chunks.join(at, ["contig", "chunk"])


def compress_chunks(chunks: DataFrame, period: int) -> DataFrame:
    """(contig, chunk, seq): every ``period``-th base of a contig, its first one first, whatever its chunks are."""
    skip = F.pmod(-F.col("__from"), F.lit(period)).cast("int")
    return _offsets(chunks).select("contig", "chunk", compress(F.col("seq").substr(skip + 1, F.length("seq")), period).alias("seq"))


def decompress_chunks(chunks: DataFrame, lengths: DataFrame, period: int) -> DataFrame:
    """The reverse of ``compress_chunks`` to the ``lengths`` (contig, length): a base stands for the ``period`` around its place, the
    first one for what is left of it, and the end of a contig that is longer is N."""
    s = _offsets(chunks).join(lengths, "contig")
    last = F.max("chunk").over(Window.partitionBy("contig"))
    ends = chunks.select("contig", "chunk", last.alias("__last"))  # a row a chunk
    s = s.join(ends, ["contig", "chunk"])
    half = period // 2 + 1
    start = F.when(F.col("__from") == 0, F.lit(0)).otherwise(half + (F.col("__from") - 1) * period)
    times = lambda k: F.when(F.col("__from") + k == 0, F.lit(half)).otherwise(F.lit(period))
    bases = F.filter(F.split("seq", ""), lambda c: c != "")
    wide = F.array_join(F.transform(bases, lambda c, k: F.repeat(c, times(k))), "")
    room = F.greatest(F.col("length") - start, F.lit(0)).cast("int")
    text = F.when(F.col("chunk") == F.col("__last"), F.rpad(wide, room, F.lit("N"))).otherwise(wide.substr(F.lit(1), room))
    return s.select("contig", "chunk", text.alias("seq"))


def compress(seq: Column, period: int) -> Column:
    """Every ``period``-th character, the first one first."""
    return F.array_join(F.filter(F.split(seq, ""), lambda _, k: k % period == 0), "")


def decompress(seq: Column, period: int, length: Column) -> Column:
    """The first character period // 2 + 1 times, others period times, cut or filled with N to ``length``."""
    wide = F.array_join(F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c, k: F.when(k == 0, F.repeat(c, F.lit(period // 2 + 1))).otherwise(F.repeat(c, F.lit(period)))), "")
    return F.rpad(wide, length, F.lit("N"))
