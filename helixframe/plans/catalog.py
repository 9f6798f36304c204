"""The registered queries over the cohort lens, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import names as N
from helixframe.functions import site as S
from helixframe.operators import ancestry as A
from helixframe.operators import cohorts as H
from helixframe.operators import count_models as C
from helixframe.operators import est as E
from helixframe.operators import export as X
from helixframe.operators import genealogy as G
from helixframe.operators import imputation as I
from helixframe.operators import joins as J
from helixframe.operators import newick as K2
from helixframe.operators import sites as U
from helixframe.operators import summaries as Y
from helixframe.operators import sweeps as R
from helixframe.operators import thinning as Z
from helixframe.operators import trees as T
from helixframe.operators import windows as W
from helixframe.plans import lens
from helixframe.sources import chunks as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, use_lens: bool = True):
    """Register a function over (sites, spark, sf_dir), or over (spark, sf_dir) without the lens."""
    def add(f):
        QUERIES[name] = (lambda spark, d: f(lens.sites(spark, d), spark, d)) if use_lens else f
        if sql:
            ORACLES[name] = f"with {lens.SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}" if use_lens else sql
        return f

    return add


def counted(s: DataFrame) -> DataFrame:
    return s.withColumn("counts", S.counts())


@query("site_alleles", "select site_id, n0, n1, n2, alc as allelicity, an, n0 = 1 or n1 = 1 or n2 = 1 as singleton, n0 = 2 or n1 = 2 or n2 = 2 as doubleton, n0 between 1 and 2 or n1 between 1 and 2 or n2 between 1 and 2 as lowcount from sa")
def _(s, *_):
    c = counted(s)
    return c.select("site_id", *[F.get("counts", F.lit(k)).cast("long").alias(f"n{k}") for k in range(3)], S.allelicity().alias("allelicity"), S.an().cast("long").alias("an"), S.has_count(n=1).alias("singleton"), S.has_count(n=2).alias("doubleton"), S.has_lowcount(most=2).alias("lowcount"))


SECOND = "case when alc < 2 then null when maj = 0 then case when n1 >= n2 then 1 else 2 end when maj = 1 then case when n0 >= n2 then 0 else 2 end else case when n0 >= n1 then 0 else 1 end end"


@query("site_major_minor", f", x as (select *, {SECOND} as sec from sa) select site_id, cast(maj as int) as major, cast(sec as int) as second, case when sec is null then null else [n0, n1, n2][sec + 1] end as second_count, cast(case when alc <> 2 then null when [n0, n1, n2][maj + 1] = [n0, n1, n2][sec + 1] then maj else sec end as int) as minor, cast(case when sec is null then null else [n0, n1, n2][sec + 1] end as double) / an as second_frac from x")
def _(s, *_):
    c = counted(s)
    return c.select("site_id", S.major().alias("major"), S.second().alias("second"), S.second_count().cast("long").alias("second_count"), S.minor().alias("minor"), S.second_frac().alias("second_frac"))


@query("site_missing_depth", "select site_id, cast(2 * ns - an as double) / (2 * ns) as missing_frac, dp as depth, cast(low3 as double) / ns as low_depth_frac, over3 > 0 as has_data from sa")
def _(s, *_):
    return s.select("site_id", S.missing_frac().alias("missing_frac"), S.depth().alias("depth"), S.low_depth_frac().alias("low_depth_frac"), S.has_data().alias("has_data"))


@query("site_genotype_alleles", "select site_id, case when n0 > 0 then 'A' when n1 > 0 then 'C' when n2 > 0 then 'G' end as geno_ref, case when alc < 2 then null when n0 > 0 then case when n1 >= n2 then 'C' else 'G' end else 'G' end as geno_alt, n0 > 0 as has_ref, (n0 > 0 or n1 = 0) and (n1 > 0 or n2 = 0) as is_ordered from sa")
def _(s, *_):
    c = counted(s)
    return c.select("site_id", S.geno_ref().alias("geno_ref"), S.geno_alt().alias("geno_alt"), S.has_ref().alias("has_ref"), S.is_ordered().alias("is_ordered"))


for _name, _args, _rule in (("bi", {}, "alc = 2"), ("mono_bi", {"mono": True}, "alc in (1, 2)"), ("multi", {"multi": True, "bi": False}, "alc > 2"), ("all", {"mono": True, "multi": True, "nonsnp": True}, "alc > 0")):
    query(f"site_passes_filter_{_name}", f"select site_id, {_rule} as passes from sa")(lambda s, *_, a=_args: counted(s).select("site_id", S.passes_filter(**a).alias("passes")))


@query("lowcount_to_miss", "select site_id, n0 between 1 and 2 or n1 between 1 and 2 or n2 between 1 and 2 as changed, an - case when n0 <= 2 then n0 else 0 end - case when n1 <= 2 then n1 else 0 end - case when n2 <= 2 then n2 else 0 end as an from sa")
def _(s, *_):
    return counted(U.lowcount_to_miss(s, 2)).select("site_id", "changed", S.an().cast("long").alias("an"))


@query("depth_to_miss", "select site_id, count(*) filter (dp >= 20 and a1 >= 0) + count(*) filter (dp >= 20 and a2 >= 0) as an from lens_geno group by site_id")
def _(s, *_):
    return counted(U.depth_to_miss(s, 20)).select("site_id", S.an().cast("long").alias("an"))


AGE = "1.0::double - cast(greatest(n0, n1, n2) as double) / greatest(an, 1)"


@query("flat_to_miss", "select site_id, count(*) filter (dp >= 5 and dp % 4 <> 0 and a1 >= 0) + count(*) filter (dp >= 5 and dp % 4 <> 0 and a2 >= 0) as an from lens_geno group by site_id")
def _(s, *_):
    """Likelihoods 0, x, 2 x of a sample, x from its depth; where x is 0 they tell nothing."""
    pl = F.transform("dp", lambda d: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: (k * (d % 4)).cast("double")))
    return counted(U.depth_to_miss(s.withColumn("pl", pl), 5)).select("site_id", S.an().cast("long").alias("an"))


@query("allele_age", f", x as (select *, {AGE} as x from sa) select site_id, case when alc > 1 then floor(-2.0::double * x / (1.0::double - x) * ln(x) * 1e4) / 1e4 end as age, case when alc > 1 then floor(x * 1e3) / 1e3 end as af from x")
def _(s, *_):
    age, af = S.age_columns()
    return counted(s).select("site_id", age.alias("age"), af.alias("af"))


@query("filter_range", f", x as (select *, {SECOND} as sec from sa) select site_id, pos from x where pos between 100 and 2000 and alc = 2 and cast([n0, n1, n2][sec + 1] as double) / an > 0.1")
def _(s, *_):
    return U.filter_range(s, 100, 2000, 0.1, True).select("site_id", "pos")


@query("filter_mac", "select site_id from sa where alc > 1 and least(case when n0 > 0 then n0 end, case when n1 > 0 then n1 end, case when n2 > 0 then n2 end) >= 3")
def _(s, *_):
    return U.filter_mac(s, 3).select("site_id")


@query("filter_missing", "select site_id from sa where cast(smiss as double) / ns < 0.4")
def _(s, *_):
    return U.filter_missing(s, 0.4).select("site_id")


@query("filter_depth", "select site_id from lens_geno group by site_id having cast(count(*) filter (dp >= 20) as double) / count(*) > 0.3")
def _(s, *_):
    return U.filter_depth(s, 20, 0.3).select("site_id")


def pops(spark: SparkSession, sf_dir: str) -> dict[str, list[int]]:
    """Samples of each population; a dimension of 25 rows."""
    out: dict[str, list[int]] = {}
    for r in lens.read(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        out.setdefault(f"p{r['n_regionkey']}", []).append(r["n_nationkey"])
    return out


@query("filter_missing_pops", "select distinct site_id from sa where site_id not in (select site_id from lens_geno group by site_id, pop having count(*) filter (a1 >= 0) = 0)")
def _(s, spark, d):
    return U.filter_missing_pops(s, pops(spark, d)).select("site_id")


@query("filter_outgroup", "select site_id from lens_geno where sample_ix in (3, 7) group by site_id having bool_or(a1 in (0, 1) or a2 in (0, 1))")
def _(s, *_):
    return U.filter_outgroup(s, [3, 7]).select("site_id")


AA = "case site_id % 4 when 0 then 'A' when 1 then 'C' when 2 then 'G' else 'T' end"


def with_aa(s: DataFrame) -> DataFrame:
    return s.withColumn("aa", F.element_at(F.array(*map(F.lit, "ACGT")), (F.col("site_id") % 4 + 1).cast("int")))


AAQ = f"case when site_id % 5 = 0 then null else {AA} end"


@query("quick_filter_reasons", f""", k as (select *, (n0 > 1)::int + (n1 > 1)::int + (n2 > 1)::int as lft, {AAQ} as aa from sa),
k2 as (select *, alc > 2 and lft in (1, 2) as saved from k),
k3 as (select *, case when saved and n0 <= 1 then 0 else n0 end as k0, case when saved and n1 <= 1 then 0 else n1 end as k1, case when saved and n2 <= 1 then 0 else n2 end as k2 from k2)
select reason, saved as rescued, count(*) as n, cast(sum(k0 + k1 + k2) as bigint) as calls from (select *, case when cast(2 * ns - an as double) / (2 * ns) > 0.5 then 'missing' when alc = 0 or (alc > 2 and not saved) then 'nonallelic'
when saved and cast(2 * ns - k0 - k1 - k2 as double) / (2 * ns) > 0.5 then 'missing'
when aa is not null and not ((aa = 'A' and k0 > 0) or (aa = 'C' and k1 > 0) or (aa = 'G' and k2 > 0)) then 'nonancestral' when k0 = 0 then 'noref' end as reason from k3) group by 1, 2""")
def _(s, *_):
    q = counted(U.quick_filter(with_aa(s).withColumn("aa", F.when(F.col("site_id") % 5 != 0, F.col("aa")))))
    return q.groupBy("reason", "rescued").agg(F.count("*").alias("n"), F.sum(S.an()).cast("long").alias("calls"))


@query("polarise_counts", f", k as (select *, {AA} as aa from sa) select site_id, aa as ref, case when aa = 'A' then n0 else n1 end as n_anc, case when aa = 'A' then n1 else n0 end as n_der from k where aa in ('A', 'C')")
def _(s, *_):
    p = counted(U.polarise(with_aa(s)))
    return p.select("site_id", "ref", F.get("counts", F.lit(0)).cast("long").alias("n_anc"), F.get("counts", F.lit(1)).cast("long").alias("n_der"))


@query("flip_counts", "select site_id, n1 as n0, n0 as n1 from sa")
def _(s, *_):
    p = counted(U.flip(s))
    return p.select("site_id", F.get("counts", F.lit(0)).cast("long").alias("n0"), F.get("counts", F.lit(1)).cast("long").alias("n1"))


@query("ancestral_majority", "select site_id, case when over3 = 0 then 'nodata' when alc = 0 then 'nonallelic' when alc = 1 then 'mono' when alc > 2 then 'multi' when n0 = 0 then 'noref' when an - greatest(n0, n1, n2) < 3 then 'single' end as reason, case when over3 > 0 and alc = 2 and n0 > 0 and an - greatest(n0, n1, n2) >= 3 then ['A', 'C', 'G'][maj + 1] end as aa from sa")
def _(s, *_):
    return U.ancestral_majority(s, keep_singles=False).select("site_id", "reason", "aa")


OUT = "case site_id % 4 when 0 then 'A' when 1 then 'C' when 2 then 'N' else 'T' end as out1, case site_id % 7 when 0 then 'A' when 1 then 'C' when 2 then 'N' when 3 then 'A' when 4 then 'G' when 5 then 'C' else 'N' end as out2"


@query("ancestral_two_outgroups", f""", k as (select *, {OUT}, cast(greatest(n0, n1, n2) as double) / (n0 + greatest(n1, n2)) as mf from sa where n0 + greatest(n1, n2) > 0),
k2 as (select *, (out1 = 'A' and n0 > 0) or (out1 = 'C' and n1 > 0) or (out1 = 'G' and n2 > 0) as in1, (out2 = 'A' and n0 > 0) or (out2 = 'C' and n1 > 0) or (out2 = 'G' and n2 > 0) as in2 from k),
k3 as (select *, case when alc <> 2 then 'nonbiallelic' when n0 = 0 then 'noref' when out1 = 'N' and out2 = 'N' and mf <= 0.95 then 'nooutgroup' when mf > 0.98 then 'singleton'
  when not in1 and not in2 and mf <= 0.95 then 'orthogonal' when in1 and out1 = out2 then 'agree' when mf > 0.95 then 'majority' when in1 and not in2 then 'first' when in2 and not in1 then 'second' else 'conflict' end as rule from k2)
select site_id, rule, case when rule in ('singleton', 'majority') then ['A', 'C', 'G'][maj + 1] when rule in ('agree', 'first') then out1 when rule = 'second' then out2 end as aa from k3""")
def _(s, *_):
    pick = lambda letters, n: F.element_at(F.array(*map(F.lit, letters)), (F.col("site_id") % n + 1).cast("int"))
    s = s.where(F.exists("gt", lambda g: g["a0"] >= 0)).withColumns({"out1": pick("ACNT", 4), "out2": pick("ACNAGCN", 7)})
    return U.ancestral_outgroups(s).select("site_id", "rule", "aa")


@query("est_postprocess", f""", x as (select *, {SECOND} as sec, cast(site_id % 101 as double) / 100 as p from sa where alc > 0)
select site_id, case when alc = 1 or p > 0.8 then ['A', 'C', 'G'][maj + 1] when p < 0.2 then ['A', 'C', 'G'][sec + 1] end as aa, case when alc = 1 then 1.0::double when p > 0.8 then p when p < 0.2 then 1 - p end as aap from x""")
def _(s, *_):
    s = s.where(S.allelicity(S.counts()) > 0).withColumn("p", (F.col("site_id") % 101).cast("double") / 100)
    return U.post_est(s, threshold=0.8).withColumn("aa", F.col("aa")).select("site_id", "aa", "aap")


# --- joins -----------------------------------------------------------------

FILES = ", fa as (select chrom, pos, site_id from lens_sites union all select chrom, pos, site_id + 1000000 from lens_sites where site_id % 10 = 0), fb as (select chrom, pos, site_id from lens_sites where site_id % 5 <> 0 union all select chrom, pos + 1, site_id from lens_sites where site_id % 7 = 0), a as (select *, row_number() over (partition by chrom, pos order by site_id) as dup_ix from fa), b as (select *, row_number() over (partition by chrom, pos order by site_id) as dup_ix from fb)"


def two_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = lens.read(spark, d, "part")
    key = F.col("p_partkey")
    s = part.select(F.concat(F.lit("c"), (key % 3 + 1).cast("string")).alias("chrom"), (F.expr("p_partkey div 3") * 5 + F.col("p_size") % 5 + 1).alias("pos"), key.alias("site_id"))
    a = s.unionByName(s.where("site_id % 10 = 0").withColumn("site_id", F.col("site_id") + 1000000))
    b = s.where("site_id % 5 <> 0").unionByName(s.where("site_id % 7 = 0").withColumn("pos", F.col("pos") + 1))
    return a, b


for _mode, _how in (("intersect", "join"), ("left", "left join"), ("right", "right join"), ("all", "full join"), ("exclude", "full join")):
    query(f"compare_{_mode}", f"{FILES} select chrom, pos, a.site_id as l_id, b.site_id as r_id from a {_how} b using (chrom, pos, dup_ix)" + " where a.site_id is null or b.site_id is null" * (_mode == "exclude"))(
        lambda s, spark, d, m=_mode: J.compare(*two_files(spark, d), m, ["site_id"]).select("chrom", "pos", F.col("l.site_id").alias("l_id"), F.col("r.site_id").alias("r_id")))

for _side, _sql in (("left", "coalesce(a.site_id, b.site_id)"), ("right", "coalesce(b.site_id, a.site_id)")):
    for _ex in (False, True):
        query(f"compare_replace_{_side}" + "_exclusive" * _ex, f"{FILES} select chrom, pos, {_sql} as site_id from a full join b using (chrom, pos, dup_ix)" + f" where {'a' if _side == 'left' else 'b'}.site_id is not null" * _ex)(
            lambda s, spark, d, side=_side, ex=_ex: J.prefer(J.compare(*two_files(spark, d), "all", ["site_id"]), side, ex).select("chrom", "pos", F.col("site.site_id").alias("site_id")))

RAW = ", raw as (select concat('c', cast(o_orderkey % 3 + 1 as varchar(8))) as chrom, o_orderkey * 37 % 20000 + 1 as s, o_orderkey * 37 % 20000 + 1 + o_custkey % 40 as e from orders)"
ISLANDS = RAW + ", w as (select *, max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) as pm from raw), g as (select *, sum(case when pm is null or s > pm + 1 then 1 else 0 end) over (partition by chrom order by s, e rows unbounded preceding) as grp from w), m as (select chrom, min(s) as s, max(e) as e from g group by chrom, grp)"


def raw_mask(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    lo = k * 37 % 20000 + 1
    return lens.read(spark, d, "orders").select(F.concat(F.lit("c"), (k % 3 + 1).cast("string")).alias("chrom"), lo.alias("start"), (lo + F.col("o_custkey") % 40).alias("end"))


@query("mask_merge", ISLANDS + " select chrom, s as start, e as \"end\" from m")
def _(s, spark, d):
    return J.merge_intervals(raw_mask(spark, d))


SMALL = ", m as (select chrom, i * 400 + 1 as s, i * 400 + 60 as e from (select distinct chrom from lens_sites) c, (select unnest(range(0, 2000)) as i) r)"


def mask(spark: SparkSession, s: DataFrame) -> DataFrame:
    return s.select("chrom").distinct().crossJoin(F.broadcast(spark.range(2000))).select("chrom", (F.col("id") * 400 + 1).alias("start"), (F.col("id") * 400 + 60).alias("end"))


@query("mask_points", SMALL + " select site_id from lens_sites x where exists (select 1 from m where m.chrom = x.chrom and x.pos between m.s and m.e)")
def _(s, spark, d):
    return J.in_intervals(s.select("site_id", "chrom", "pos"), mask(spark, s)).select("site_id")


@query("mask_outside", SMALL + " select site_id from lens_sites x where not exists (select 1 from m where m.chrom = x.chrom and x.pos between m.s and m.e)")
def _(s, spark, d):
    return J.in_intervals(s.select("site_id", "chrom", "pos"), mask(spark, s), anti=True).select("site_id")


@query("mask_spans", SMALL + ", sp as (select distinct chrom, pos as s, pos + 250 as e from lens_sites) select sp.chrom, sp.s as start, sp.e as \"end\", cast(coalesce(sum(ov), 0) as bigint) as covered, coalesce(sum(ov), 0) > 0 as overlaps, cast(coalesce(sum(ov), 0) as double) / 251 as frac from (select sp.*, case when m.s is not null then least(sp.e, m.e) - greatest(sp.s, m.s) + 1 end as ov from sp left join m on m.chrom = sp.chrom and m.s <= sp.e and sp.s <= m.e) sp group by all")
def _(s, spark, d):
    return J.span_cover(s.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 250).alias("end")).distinct(), mask(spark, s), 1000)


MAP = ", mp as (select chrom, i * 100 as phys, cast(i * (i + 1) as double) / 40 as gen from (select distinct chrom from lens_sites) c, (select unnest(range(1, 30)) as i) r)"


def genetic_map(spark: SparkSession, s: DataFrame) -> DataFrame:
    i = F.col("id")
    return s.select("chrom").distinct().crossJoin(F.broadcast(spark.range(1, 30))).select("chrom", (i * 100).alias("phys"), ((i * (i + 1)).cast("double") / 40).alias("gen"))


@query("asof_map_rate", MAP + """, z as (select * from mp union all select distinct chrom, 0, 0.0::double from mp),
lo as (select l.site_id, l.chrom, l.pos, max(z.phys) as lp from lens_sites l join z on z.chrom = l.chrom and z.phys <= l.pos group by all),
hi as (select l.site_id, min(z.phys) as hp from lens_sites l join z on z.chrom = l.chrom and z.phys >= l.pos group by all),
g as (select lo.site_id, lo.chrom, lo.pos, case when lp = lo.pos then a.gen else a.gen + (b.gen - a.gen) * (lo.pos - lp) / (hp - lp) end as gen
  from lo left join hi using (site_id) join z a on a.chrom = lo.chrom and a.phys = lp left join z b on b.chrom = lo.chrom and b.phys = hp)
select site_id, round(gen, 6) as gen, round(coalesce(gen - coalesce(lag(gen) over (partition by chrom order by pos), 0.0), 0.0), 6) as rec from g""")
def _(s, spark, d):
    out = J.interpolate_map(s.select("site_id", "chrom", "pos"), genetic_map(spark, s))
    return out.select("site_id", F.round("gen", 6).alias("gen"), F.round("rec", 6).alias("rec"))


@query("map_rates", MAP + " select chrom, phys, round((gen - lag(gen, 1, 0.0) over w) / (phys - lag(phys, 1, 0) over w) * 1e6, 6) as rate from mp window w as (partition by chrom order by phys)")
def _(s, spark, d):
    return W.map_rates(genetic_map(spark, s)).select("chrom", "phys", F.round("rate", 6).alias("rate"))


@query("map_mean_weighted", MAP + ", r as (select *, (gen - lag(gen, 1, 0.0) over w) / (phys - lag(phys, 1, 0) over w) as rate from mp window w as (partition by chrom order by phys)) select chrom, round(avg(rate) * 1e6, 6) as mean_rate, round(arg_max(gen, phys) / max(phys) * 1e6, 6) as weighted from r group by chrom")
def _(s, spark, d):
    r = W.map_rates(genetic_map(spark, s))
    return r.groupBy("chrom").agg(F.round(F.avg("rate"), 6).alias("mean_rate"), F.round(F.max_by("gen", "phys") / F.max("phys") * 1e6, 6).alias("weighted"))


# --- windows ---------------------------------------------------------------

WIN = ", wd as (select g.chrom, (g.pos - 1) // 250 as win, sample_ix, cast(sum(g.dp) as bigint) as depth_sum, count(*) as sites from lens_geno g join sa using (site_id) where cast(2 * ns - sa.an as double) / (2 * ns) <= 0.5 group by all)"


@query("window_depth", WIN + " select chrom, win, cast(sample_ix as int) as sample_ix, depth_sum, sites from wd")
def _(s, *_):
    return W.window_depth(s, 250)


@query("window_depth_gapfill", WIN + ", e as (select chrom, min(win) as a, max(win) as b from wd group by chrom) select e.chrom, w.win, cast(n.n_nationkey as int) as sample_ix, coalesce(depth_sum, 0) as depth_sum, coalesce(sites, 0) as sites from e, unnest(range(a, b + 1)) as w(win), nation n left join wd on wd.chrom = e.chrom and wd.win = w.win and wd.sample_ix = n.n_nationkey")
def _(s, *_):
    return W.fill_gaps(W.window_depth(s, 250))


def outlier_sql(mid: str, transform: str, spread: str) -> str:
    cut = NormalDist().inv_cdf(0.05)
    return WIN + f""", r as (select *, cast(depth_sum as double) / sites as r from wd), own as (select sample_ix, {mid}(r) as own from r where sites >= 20 group by 1),
sc as (select sample_ix, own / (select {mid}(own) from own) as s from own where own > 0),
y as (select r.*, r.r / sc.s as y, {transform.format(y='(r.r / sc.s)')} as t from r join sc using (sample_ix)),
c as (select chrom, win, {mid}(y) as centre, {mid}(t) as mu, max(sites) as ns, stddev_samp(t) as sd from y group by 1, 2 having max(sites) >= 20 and {mid}(y) >= 5),
z as (select y.*, c.mu, c.sd, c.ns from y join c using (chrom, win)),
sp as (select chrom, win, {spread} as raw from z group by 1, 2),
f as (select z.*, case when raw > 0.01 then raw else 0.01 end as sigma from z join sp using (chrom, win)),
o as (select chrom, win, max(ns) as sites, avg(case when (t - mu) / sigma <= {cut} then 1.0 else 0.0 end) as low_frac, avg(case when (t - mu) / sigma >= {-cut} then 1.0 else 0.0 end) as high_frac, round(max(mu), 6) as mu, round(max(sigma), 6) as sigma from f group by 1, 2)
select * from o where low_frac >= 0.05 or high_frac >= 0.05"""


MAD, SD = "1.4826::double * median(abs(t - mu))", "max(sd)"
for _name, _mid, _t, _spread, _kw in (("median", "median", "{y}", MAD, {}), ("mean", "avg", "{y}", SD, {"use_median": False}), ("sqrt", "median", "sqrt({y})", MAD, {"transform": "sqrt"}), ("log", "median", "case when {y} > 0 then ln({y}) end", MAD, {"transform": "log"})):
    @query(f"depth_outliers_{_name}", outlier_sql(_mid, _t, _spread))
    def _(s, *_, kw=_kw):
        out = W.depth_outliers(W.window_depth(s, 250), alpha=0.05, **kw)
        return out.withColumns({"mu": F.round("mu", 6), "sigma": F.round("sigma", 6)})


CUT = NormalDist().inv_cdf(0.05)
REPORT = outlier_sql("median", "sqrt({y})", MAD).partition(",\nsp as (")[0] + f""", sp as (select chrom, win, {MAD} as raw from z group by 1, 2), f as (select z.*, case when raw > 0.01 then raw else 0.01 end as sigma from z join sp using (chrom, win)),
o as (select chrom, win, avg(case when (t - mu) / sigma <= {CUT} then 1.0 else 0.0 end) as low_frac, avg(case when (t - mu) / sigma >= {-CUT} then 1.0 else 0.0 end) as high_frac, avg(case when abs((t - mu) / sigma) >= {-CUT} then 1.0 else 0.0 end) as frac,
  coalesce(string_agg(cast(sample_ix as varchar), ',' order by sample_ix) filter ((t - mu) / sigma <= {CUT}), '') as low, coalesce(string_agg(cast(sample_ix as varchar), ',' order by sample_ix) filter ((t - mu) / sigma >= {-CUT}), '') as high, max(mu) as mu, max(sigma) as sigma from f group by 1, 2)
select chrom, win * 250 + 1 as start, (win + 1) * 250 as "end", round(frac, 6) as frac, low, high, round(greatest(mu, 0) ** 2, 6) as mu_norm, round(greatest(mu + {CUT} * sigma, 0) ** 2, 6) as lower_cut_norm, round(mu - {CUT} * sigma, 6) as upper_cut from o where low_frac >= 0.05 or high_frac >= 0.05"""


@query("depth_outliers_report", REPORT)
def _(s, *_):
    out = W.depth_outliers(W.window_depth(s, 250), alpha=0.05, transform="sqrt", width=250)
    ids = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return out.select("chrom", "start", "end", F.round("frac", 6).alias("frac"), ids("low_ix").alias("low"), ids("high_ix").alias("high"), F.round("mu_norm", 6).alias("mu_norm"), F.round("lower_cut_norm", 6).alias("lower_cut_norm"), F.round("upper_cut", 6).alias("upper_cut"))


@query("slide_bp", ", x as (select chrom, pos, cast(dp as double) / ns as d, cast(ns - low3 as double) / ns as m from sa) select chrom, pos, median(pos) over w as mid, round(avg(d) over w, 6) as mean_depth, round(avg(m) over w, 6) as nonmiss, cast(count(*) over w as double) / 200 * 100 as density from x window w as (partition by chrom order by pos range between 200 preceding and current row)")
def _(s, *_):
    return W.slide_bp(s, 200).withColumns({c: F.round(c, 6) for c in ("mean_depth", "nonmiss")})


@query("slide_bp_thin", ", x as (select chrom, pos, cast(dp as double) / ns as d, case when alc > 1 then 1.0::double else 0.0::double end as snp from sa) select chrom, pos, n, round(md, 6) as mean_depth, round(sf, 6) as snp_frac from (select chrom, pos, cast(row_number() over (partition by chrom order by pos) as int) as n, avg(d) over w as md, avg(snp) over w as sf from x window w as (partition by chrom order by pos range between 200 preceding and current row)) where n % 7 = 0")
def _(s, *_):
    return W.slide_bp_thin(s, 200, 7).withColumns({c: F.round(c, 6) for c in ("mean_depth", "snp_frac")})


@query("slide_rows", ", x as (select chrom, pos, cast(dp as double) / ns as d, case when alc > 1 then 1.0::double else 0.0::double end as snp, cast(an as double) / (2 * ns) as nm from sa), y as (select chrom, pos, cast(row_number() over (partition by chrom order by pos) as int) as n, median(pos) over w as mid, round(avg(d) over w, 6) as mean_depth, round(avg(snp) over w, 6) as snp_frac, round(avg(nm) over w, 6) as nonmiss from x window w as (partition by chrom order by pos rows between 9 preceding and current row)) select * from y where n >= 10 and n % 5 = 0")
def _(s, *_):
    return W.slide_rows(s, 10, 5).withColumns({c: F.round(c, 6) for c in ("mean_depth", "snp_frac", "nonmiss")})


HAS = lambda n: f"(n0 = {n} or n1 = {n} or n2 = {n})"


@query("quicksum", f" select chrom, count(*) as sites, count(*) filter (alc = 1) as invariant, count(*) filter (alc > 1) as snps, count(*) filter (alc > 2) as multi, count(*) filter (alc = 2) as bi, count(*) filter (alc > 1 and {HAS(1)}) as singles, count(*) filter (alc > 1 and not {HAS(1)} and {HAS(2)}) as doubles, count(*) filter (alc > 1 and not {HAS(1)} and not {HAS(2)} and {HAS(3)}) as triples, count(*) filter (alc = 0) as other, min(pos) as first, max(pos) as last, cast(count(*) as double) / (max(pos) - min(pos) + 1) as coverage from sa group by chrom")
def _(s, *_):
    return W.quicksum(s, "chrom")


@query("sample_missing", " select cast(sample_ix as int) as sample_ix, cast(sum(dp) as bigint) as depth_sum, count(*) filter (dp >= 3) as n_deep, cast(sum(dp) as double) / count(*) as mean_depth, cast(count(*) filter (dp >= 3) as double) / count(*) as frac_deep from lens_geno group by 1")
def _(s, *_):
    return W.sample_stats(s)


TRIO = ", t as (select site_id, max(case when sample_ix = 1 and a1 >= 0 and a2 >= 0 then a1 + a2 end) as f, max(case when sample_ix = 2 and a1 >= 0 and a2 >= 0 then a1 + a2 end) as o1, max(case when sample_ix = 5 and a1 >= 0 and a2 >= 0 then a1 + a2 end) as o2, max(case when sample_ix = {i} and a1 >= 0 and a2 >= 0 then a1 + a2 end) as i1 from lens_geno group by 1) select count(*) filter (f = o1) as m1, count(*) filter (f = o2) as m2, count(*) filter (f = 1) as mid from t join sa using (site_id) where alc = 2 and f is not null and o1 in (0, 2) and o2 in (0, 2) and o1 <> o2 and i1 = o1"
query("trio_counts", TRIO.format(i=2))(lambda s, *_: W.trio_counts(s, 1, 2, 5))
query("trio_counts_in", TRIO.format(i=9))(lambda s, *_: W.trio_counts(s, 1, 2, 5, 9))


@query("pop_freqs", " select chrom, pos, concat('p', cast(pop as varchar)) as pop, cast(count(*) filter (a1 = 0) + count(*) filter (a2 = 0) as int) as n0, cast(count(*) filter (a1 = 1) + count(*) filter (a2 = 1) as int) as n1 from lens_geno group by all")
def _(s, spark, d):
    return W.pop_counts(s, pops(spark, d))


@query("est_lines", " select site_id, concat(n0, ',', n1, ',', n2, ',0') as pop, case when site_id % 4 = 0 then '1,0,0,0' when site_id % 4 = 1 then '0,1,0,0' when site_id % 4 = 2 then '0,0,1,0' else '0,0,0,1' end as anc from sa")
def _(s, *_):
    return counted(with_aa(s)).select("site_id", X.acgt().alias("pop"), X.one_hot(F.col("aa")).alias("anc"))


@query("est_fixed", """, q as (select site_id, n0, n1, cast(n0 + n1 as double) / nullif(n0, 0) as rr, cast(n0 + n1 as double) / nullif(n1, 0) as aa from sa), q2 as (select *, cast(floor(20 / rr) as bigint) as r, cast(floor(20 / aa) as bigint) as a from q)
select site_id, cast(case when n0 = 0 then 0 when n1 = 0 then 20 when r + a = 20 then r when round(20 - r * rr, 9) >= round(20 - a * aa, 9) then r + 1 else r end as bigint) as r, cast(case when n1 = 0 then 0 when n0 = 0 then 20 when r + a = 20 then a when round(20 - r * rr, 9) >= round(20 - a * aa, 9) then a else a + 1 end as bigint) as a from q2""")
def _(s, *_):
    c = counted(s).select("site_id", F.get("counts", F.lit(0)).cast("double").alias("n0"), F.get("counts", F.lit(1)).cast("double").alias("n1"))
    n0, n1 = F.when(F.col("n0") > 0, F.col("n0")), F.when(F.col("n1") > 0, F.col("n1"))
    x = W.fixed_total(F.coalesce(n0, F.lit(0.0)), F.coalesce(n1, F.lit(0.0)), 20)
    return c.select("site_id", x.alias("x")).select("site_id", F.col("x.r").cast("long").alias("r"), F.col("x.a").cast("long").alias("a"))


@query("est_bins", " select an // 5 as bin, count(*) as n from sa group by 1")
def _(s, *_):
    return counted(s).groupBy(F.expr("cast(aggregate(counts, 0, (s, x) -> s + x) as bigint) div 5").alias("bin")).agg(F.count("*").alias("n"))


@query("sweep_freq", " select chrom, pos, cast(case when alc = 2 then case when n0 = 0 then n2 when n1 = 0 then n2 else n1 end when n0 > 0 then 0 else an end as bigint) as x, an as n, 1 as folded from sa where alc in (1, 2)")
def _(s, *_):
    return X.sweep_frequencies(s)


@query("msmc_sites", ", o as (select *, row_number() over (partition by chrom order by pos) as n from sa) select chrom, pos, n - lag(n, 1, 0) over (partition by chrom order by pos) as nsites from o where alc = 2")
def _(s, *_):
    return X.msmc(s).select("chrom", "pos", F.col("nsites").cast("long").alias("nsites"))


@query("geno_dosage", " select site_id, string_agg(case when a1 < 0 or a2 < 0 then '9' else cast(a1 + a2 as varchar) end, '' order by sample_ix) as geno from lens_geno group by 1")
def _(s, *_):
    return s.select("site_id", X.geno().alias("geno"))


@query("haps_dist", f", k as (select *, {AA} as aa, row_number() over (partition by chrom order by pos) as n from sa), e as (select * from k where alc = 2 and ((aa = 'A' and n0 > 0) or (aa = 'C' and n1 > 0) or (aa = 'G' and n2 > 0))) select chrom, pos, coalesce(lead(n) over w - n, 1) as dist, an - case aa when 'A' then n0 when 'C' then n1 else n2 end as n_der from e window w as (partition by chrom order by pos)")
def _(s, *_):
    return X.haplotypes(with_aa(s)).select("chrom", "pos", F.col("dist").cast("long").alias("dist"), F.aggregate(F.transform("haps", lambda h: (h == 1).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b).alias("n_der"))


@query("phred_likelihood", "select l_orderkey, l_linenumber, count(*) as copies, round(any_value(pow(10, -q0 / 10) / (pow(10, -q0 / 10) + pow(10, -q1 / 10) + pow(10, -q2 / 10))), 4) as p0 from (select *, cast(l_orderkey % 30 as double) as q0, cast(l_linenumber as double) as q1, cast(l_orderkey % 7 as double) as q2 from lineitem) group by 1, 2", use_lens=False)
def _(spark, d):
    q = [(F.col("l_orderkey") % 30).cast("double"), F.col("l_linenumber").cast("double"), (F.col("l_orderkey") % 7).cast("double")]
    p = S.likelihoods(F.array(*q))
    return lens.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.get(p, F.lit(0)).alias("p")).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"), F.round(F.first("p"), 4).alias("p0"))


@query("thin_window", ", f as (select *, (pos - min(pos) over (partition by chrom)) // 100 as b from lens_sites), r as (select *, row_number() over (partition by chrom, b order by md5(concat('1:', chrom, ':', pos)), pos, site_id) as r from f) select site_id, chrom, pos from r where r = 1")
def _(s, *_):
    return U.thin_window(s, 100).select("site_id", "chrom", "pos")


# --- metadata, matrices, trees ------------------------------------------------


@query("group_nodes", "select concat('p', cast(n_regionkey as varchar)) as pop, cast(2 * n_nationkey + h as bigint) as node from nation, (select unnest([0, 1]) as h) u", use_lens=False)
def _(spark, d):
    return T.group_nodes(lens.read(spark, d, "nation").select(F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("pop"), F.col("n_nationkey").cast("long").alias("ix")), "pop", "ix")


QROWS = "q as (select c_custkey as ix, u.k, cast((c_custkey * (u.k + 3)) % 10 + 1 as double) / (((c_custkey * 3) % 10) + ((c_custkey * 4) % 10) + ((c_custkey * 5) % 10) + 3) as q from customer, (select unnest([0, 1, 2]) as k) u)"


def q_rows(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    total = sum(((c * k) % 10 for k in (3, 4, 5)), F.lit(3))
    return lens.read(spark, d, "customer").select(c.alias("ix"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (((c * (k + 3)) % 10 + 1).cast("double") / total).alias("q")) for k in range(3)])).alias("x")).select("ix", "x.k", "x.q")


@query("qopt_select", f"with {QROWS} select cast(k as int) as k, cast(count(*) as bigint) as n, cast(min(ix) as bigint) as first from q where q >= 0.5 group by 1", use_lens=False)
def _(spark, d):
    return T.q_members(q_rows(spark, d), 0.5).select("k", F.size("members").cast("long").alias("n"), F.get("members", F.lit(0)).alias("first"))


@query("gnn_alignment", f"with {QROWS}, g as (select ix * 2 + h as node, k, cast((ix + k + h) % 4 + 1 as double) / 10 as gnn from q, (select unnest([0, 1]) as h) u), s as (select q.ix, g.node, sum(least(q.q, g.gnn)) as m from q join g on g.node // 2 = q.ix and g.k = q.k group by 1, 2), t as (select ix, avg(m) as m from s group by 1) select round(avg(m), 6) as alignment from t", use_lens=False)
def _(spark, d):
    q = q_rows(spark, d)
    g = q.select("ix", "k", F.explode(F.array(F.lit(0), F.lit(1))).alias("h")).select((F.col("ix") * 2 + F.col("h")).alias("node"), "k", (((F.col("ix") + F.col("k") + F.col("h")) % 4 + 1).cast("double") / 10).alias("gnn"))
    return T.gnn_alignment(q, g).select(F.round("alignment", 6).alias("alignment"))


EDGES = "edges as (select o_orderkey as edge_id, cast(o_orderkey % 50 * 10 as double) as l, cast((o_orderkey % 50 + 1 + o_custkey % 3) * 10 as double) as r, 100 + o_custkey % 40 as parent, o_orderkey % 97 as child from orders), muts as (select l_orderkey * 8 + l_linenumber as mut_id, l_partkey % 300 as site_id, l_orderkey % 97 as node, cast(l_partkey % 300 * 2 as double) as position from lineitem)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return lens.read(spark, d, "orders").select(k.alias("edge_id"), (k % 50 * 10).cast("double").alias("left"), ((k % 50 + 1 + c % 3) * 10).cast("double").alias("right"), (100 + c % 40).alias("parent"), (k % 97).alias("child"))


def mutations(spark: SparkSession, d: str) -> DataFrame:
    return lens.read(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("mut_id"), (F.col("l_partkey") % 300).alias("site_id"), (F.col("l_orderkey") % 97).alias("node"), (F.col("l_partkey") % 300 * 2).cast("double").alias("position"))


@query("tree_ratios", f"with {EDGES} select count(*) as edges, (select count(distinct site_id) from muts) as sites, (select count(*) from muts) as muts, round(avg(r - l), 6) as mean_span, round((select cast(count(*) as double) / count(distinct site_id) from muts), 6) as muts_per_site from edges", use_lens=False)
def _(spark, d):
    return T.ratios(edges(spark, d), mutations(spark, d)).select("edges", "sites", "muts", F.round("mean_span", 6).alias("mean_span"), F.round("muts_per_site", 6).alias("muts_per_site"))


TREES = ", bp as (select distinct l as b from edges union select distinct r from edges), tr as (select b as lo, lead(b) over (order by b) as hi from bp), te as (select lo, hi, e.parent, e.child from tr join edges e on e.l <= lo and e.r >= hi where hi is not null)"


@query("tree_spans", f"with {EDGES}{TREES} select cast(floor(hi - lo) as bigint) as span, count(*) as n from tr where hi is not null group by 1", use_lens=False)
def _(spark, d):
    return T.span_histogram(edges(spark, d))


@query("tree_local_stats", f"with {EDGES}{TREES}, x as (select lo, hi, count(*) as n_edges, count(distinct parent) as internal from te group by 1, 2), y as (select lo, count(*) as muts, count(distinct site_id) as sites from tr join muts on position >= lo and position < hi group by 1) select lo as \"left\", hi as \"right\", hi - lo as span, n_edges, internal, coalesce(muts, 0) as muts, coalesce(sites, 0) as sites, cast(muts as double) / nullif(sites, 0) as muts_per_site from x left join y using (lo)", use_lens=False)
def _(spark, d):
    return T.local_stats(edges(spark, d), mutations(spark, d)).select("left", "right", "span", "n_edges", "internal", "muts", "sites", "muts_per_site")


BITS = f"with {EDGES}{TREES}, bt as (select lo, hi, count(*) - 97 as bits from te group by 1, 2), mk as (select *, (bits >= (select quantile_cont(bits, 0.5) from bt))::int as mask from bt)"


def tree_masks(spark: SparkSession, d: str) -> DataFrame:
    return T.tree_mask(T.tree_bits(edges(spark, d), 97), 0.5)


@query("tree_mask", f"{BITS} select lo as \"left\", hi as \"right\", bits, mask from mk", use_lens=False)
def _(spark, d):
    return tree_masks(spark, d).select("left", "right", "bits", "mask")


@query("mask_intervals", f"{BITS} select lo as \"left\", hi as \"right\" from mk where mask = 0", use_lens=False)
def _(spark, d):
    return T.mask_intervals(tree_masks(spark, d))


@query("used_nodes", f"{BITS} select parent as node from te join mk using (lo, hi) where mask = 1 union select child from te join mk using (lo, hi) where mask = 1", use_lens=False)
def _(spark, d):
    return T.used_nodes(edges(spark, d), tree_masks(spark, d))


@query("tree_bits", f"with {EDGES}, bp as (select distinct l as b from edges union select distinct r from edges), tr as (select b as lo, lead(b) over (order by b) as hi from bp), t as (select lo, hi, count(*) as n_edges, count(distinct parent) as parents from tr join edges e on e.l <= lo and e.r >= hi where hi is not null group by 1, 2) select lo as \"left\", hi as \"right\", n_edges, n_edges - 97 as bits, parents as internal from t", use_lens=False)
def _(spark, d):
    return T.tree_bits(edges(spark, d), 97).select("left", "right", "n_edges", "bits", "internal")


@query("mutation_edges", f"with {EDGES} select mut_id, edge_id from muts m join edges e on e.child = m.node and m.position between e.l and e.r", use_lens=False)
def _(spark, d):
    return T.mutation_edges(mutations(spark, d), edges(spark, d)).select("mut_id", "edge_id")


@query("root_counts", f"with {EDGES}, bp as (select distinct l as b from edges union select distinct r from edges), tr as (select b as lo, lead(b) over (order by b) as hi from bp), te as (select lo, e.parent, e.child from tr join edges e on e.l <= lo and e.r >= hi where hi is not null), ro as (select lo, count(distinct parent) as roots from te a where not exists (select 1 from te b where b.lo = a.lo and b.child = a.parent) group by 1) select roots, count(*) as trees from ro group by 1", use_lens=False)
def _(spark, d):
    return T.root_counts(edges(spark, d))


MS = "ms as (select s_suppkey % 5 as pop, s_suppkey // 5 as t_ix, cast(s_suppkey // 5 * 10 as double) as tl, cast(s_suppkey // 5 * 10 + 10 as double) as tr, 1 + cast(s_suppkey % 7 as double) / 7 as lam from supplier)"


@query("msmc_sizes", f"with {MS} select pop, t_ix, tl * 2.0 / 4.85 as years, 1 / lam / (2 * 4.85) as size from ms", use_lens=False)
def _(spark, d):
    s = F.col("s_suppkey")
    ms = lens.read(spark, d, "supplier").select((s % 5).alias("pop"), F.expr("s_suppkey div 5").alias("t_ix"), (F.expr("s_suppkey div 5") * 10).cast("double").alias("t_left"), (1 + (s % 7).cast("double") / 7).alias("lam"))
    return T.population_sizes(ms, mu=4.85, gen=2.0).select("pop", "t_ix", "years", "size")


OPEN = f"{MS}, top as (select pop, max(t_ix) as t_ix from ms group by 1), mo as (select ms.*, top.t_ix is not null as last, case when top.t_ix is not null then 'inf'::double else tr end as tro from ms left join top using (pop, t_ix))"


def open_msmc(spark: SparkSession, d: str) -> DataFrame:
    """Coalescence rates of five populations; each one's last interval is open to the right."""
    s = F.col("s_suppkey")
    ms = lens.read(spark, d, "supplier").select((s % 5).alias("pop"), F.expr("s_suppkey div 5").alias("t_ix"), (F.expr("s_suppkey div 5") * 10).cast("double").alias("t_left"), (F.expr("s_suppkey div 5") * 10 + 10).cast("double").alias("t_right"), (1 + (s % 7).cast("double") / 7).alias("lam"))
    top = ms.groupBy("pop").agg(F.max("t_ix").alias("top"))
    return ms.join(top, "pop").withColumn("t_right", F.when(F.col("t_ix") == F.col("top"), float("inf")).otherwise(F.col("t_right"))).drop("top")


@query("crosscoal", f"""with {OPEN}, g as (select a.t_ix, a.last, a.tl + u.j / 10.0::double * (a.tr - a.tl) as t, a.lam as lam01 from mo a, (select unnest(range(0, 10)) as j) u where a.pop = 2),
w as (select g.t_ix, g.t, any_value(lam01) as l01, max(case when x.pop = 0 then x.lam end) as a, max(case when x.pop = 1 then x.lam end) as b from g join mo x on x.pop in (0, 1) and case when g.last then x.last else x.tl <= g.t and g.t < x.tro end group by 1, 2),
v as (select t_ix, any_value(l01) as l01, avg(a) as l00, avg(b) as l11 from w group by 1) select t_ix, round(2 * l01 / (l00 + l11), 6) as rccr from v""", use_lens=False)
def _(spark, d):
    ms = open_msmc(spark, d)
    return T.cross_coalescence(ms.where("pop = 2"), ms.where("pop = 0"), ms.where("pop = 1")).select("t_ix", F.round("rccr", 6).alias("rccr"))


@query("msmc_pairs", "with p as (select distinct concat('p', cast(n_regionkey as varchar)) as pop from nation), j as (select distinct concat('p', cast(greatest(n_regionkey, n_nationkey % 5) as varchar)) as a, concat('p', cast(least(n_regionkey, n_nationkey % 5) as varchar)) as b, n_regionkey * 5 + n_nationkey % 5 as file from nation where n_regionkey < n_nationkey % 5) select x.pop as one, y.pop as two, j.file from p x join p y on x.pop <> y.pop left join j on least(x.pop, y.pop) = j.b and greatest(x.pop, y.pop) = j.a", use_lens=False)
def _(spark, d):
    n, r, m = lens.read(spark, d, "nation"), F.col("n_regionkey"), F.col("n_nationkey") % 5
    name = lambda x: F.concat(F.lit("p"), x.cast("string"))
    joint = n.where(r < m).select(name(F.greatest(r, m)).alias("pop0"), name(F.least(r, m)).alias("pop1"), (r * 5 + m).alias("file")).distinct()
    return T.population_pairs(n.select(name(r).alias("pop")).distinct(), joint).select("one", "two", "file")


VALID = f"""{EDGES}, u as (select *, row_number() over (partition by child, l order by edge_id) as k, lead(l) over (partition by child order by l, edge_id) as nl from edges),
ve as (select l, least(r, coalesce((select min(x.l) from u x where x.child = u.child and x.k = 1 and x.l > u.l), r)) as r, parent, child from u where k = 1),
up as (select 0.0::double as l, 530.0::double as r, 200 + cast(x % 5 as bigint) as parent, 100 + x as child from range(0, 40) t(x)
  union all select 0, 530, 300, 200 + x from range(0, 5) t(x)),
se as (select * from ve union all select * from up),
vb as (select distinct l as b from se union select distinct r from se), vt as (select b as lo, lead(b) over (order by b) as hi from vb),
tt as (select lo, hi, parent, child from vt join se on se.l <= lo and se.r >= hi where hi is not null)"""


def forest(spark: SparkSession, d: str) -> DataFrame:
    """Valid trees over the edges of orders: a child has its first edge from each start on, until its next one; two more levels join all to one root."""
    e = edges(spark, d).groupBy("child", "left").agg(F.min_by(F.struct("right", "parent"), "edge_id").alias("e"))
    w = Window.partitionBy("child").orderBy("left")  # a child has fifty starts
    e = e.select(F.col("left"), F.least("e.right", F.coalesce(F.lead("left").over(w), F.col("e.right"))).alias("right"), "e.parent", "child")
    level = lambda n, parent, child: spark.range(n).select(F.lit(0.0).alias("left"), F.lit(530.0).alias("right"), parent(F.col("id")).alias("parent"), child(F.col("id")).alias("child"))
    return e.union(level(40, lambda x: 200 + x % 5, lambda x: 100 + x)).union(level(5, lambda x: F.lit(300).cast("long"), lambda x: 200 + x))


@query("neighbours", f"""with {VALID}, p1 as (select t.lo, t.hi, t.child as s, t.parent as a, u.parent as b, v.parent as c from tt t join tt u on u.lo = t.lo and u.child = t.parent join tt v on v.lo = t.lo and v.child = u.parent where t.child < 97),
own as (select lo, hi, s, unnest([1, 2, 3]) as lvl, unnest([a, b, c]) as anc from p1),
cnt as (select lo, lvl, anc, count(*) as n, count(*) filter (s % 3 = 0) as n0, count(*) filter (s % 3 = 1) as n1, count(*) filter (s % 3 = 2) as n2 from own group by 1, 2, 3),
nn as (select o.lo, o.hi, o.s, arg_min(c.n, c.lvl) as n, arg_min(c.n0, c.lvl) as n0, arg_min(c.n1, c.lvl) as n1, arg_min(c.n2, c.lvl) as n2 from own o join cnt c using (lo, lvl, anc) where c.n > 1 group by 1, 2, 3),
ww as (select s, hi - lo as span, unnest([0, 1, 2]) as k, unnest([n0 - (s % 3 = 0)::int, n1 - (s % 3 = 1)::int, n2 - (s % 3 = 2)::int]) / cast(n - 1 as double) as f from nn)
select cast(s as bigint) as node, k as "set", round(sum(span * f) / sum(span), 9) as gnn from ww group by 1, 2""", use_lens=False)
def _(spark, d):
    sets = spark.range(97).select((F.col("id") % 3).cast("int").alias("set"), F.col("id").alias("node"))
    return R.nearest_neighbours(forest(spark, d), sets, width=100.0).select("node", "set", F.round("gnn", 9).alias("gnn"))


@query("simplify", f"""with recursive {VALID}, st as (select lo, hi, child as nd, child as s from tt where child % 4 = 0 and child < 97 union select lo, hi, child, child from tt where false),
climb(lo, hi, s, prev, nd) as (select lo, hi, s, s, s from st union all select c.lo, c.hi, c.s, c.nd, t.parent from climb c join tt t on t.lo = c.lo and t.child = c.nd),
ln as (select lo, nd, count(distinct prev) as k from climb where nd <> s group by 1, 2),
node as (select distinct lo, hi, s as n from st union select distinct c.lo, c.hi, c.nd from climb c join ln on ln.lo = c.lo and ln.nd = c.nd and k > 1 where c.nd <> c.s),
way(lo, hi, n, nd, done) as (select lo, hi, n, n, false from node union all select w.lo, w.hi, w.n, t.parent, exists (select 1 from node m where m.lo = w.lo and m.n = t.parent) from way w join tt t on t.lo = w.lo and t.child = w.nd where not w.done)
select lo as "left", hi as "right", cast(nd as bigint) as parent, cast(n as bigint) as child from way where done""", use_lens=False)
def _(spark, d):
    """Restricted trees, their edges cut at the breakpoints of the whole ones, as the SQL has them."""
    whole = forest(spark, d)
    s = R.simplify(whole, [x for x in range(97) if x % 4 == 0], width=100.0)
    t = R.tree_counts(whole).select(F.col("left").alias("b"), F.col("right").alias("e"))
    bins = lambda df, lo, hi: df.withColumn("k", F.explode(F.sequence(F.floor(F.col(lo) / 100), F.floor(F.col(hi) / 100))))
    hit = bins(s, "left", "right").join(bins(t, "b", "b"), "k").where("left <= b and e <= right")
    return hit.select(F.col("b").alias("left"), F.col("e").alias("right"), "parent", "child")


@query("crosscoal_pairs", f"""with {OPEN}, jj as (select a.pop as pop0, b.pop as pop1, c.t_ix, c.tl, c.tr, c.last, c.lam * (1 + 0.1::double * a.pop) as lam from (select distinct pop from ms) a join (select distinct pop from ms) b on a.pop < b.pop join mo c on c.pop = (a.pop + b.pop) % 5),
g as (select jj.*, tl + u.j / 10.0::double * (tr - tl) as t from jj, (select unnest(range(0, 10)) as j) u),
w as (select g.pop0, g.pop1, g.t_ix, g.t, any_value(g.lam) as l01, max(case when x.pop = g.pop0 then x.lam end) as a, max(case when x.pop = g.pop1 then x.lam end) as b from g join mo x on x.pop in (g.pop0, g.pop1) and case when g.last then x.last else x.tl <= g.t and g.t < x.tro end group by 1, 2, 3, 4),
v as (select pop0, pop1, t_ix, any_value(l01) as l01, avg(a) as l00, avg(b) as l11 from w group by 1, 2, 3) select pop0, pop1, t_ix, round(2 * l01 / (l00 + l11), 6) as rccr from v""", use_lens=False)
def _(spark, d):
    ms = open_msmc(spark, d)
    pops = ms.select("pop").distinct()
    pairs = pops.select(F.col("pop").alias("pop0")).join(pops.select(F.col("pop").alias("pop1")), F.expr("pop0 < pop1"))
    joint = pairs.join(ms, F.col("pop") == (F.col("pop0") + F.col("pop1")) % 5).drop("pop").withColumn("lam", F.col("lam") * (1 + F.lit(0.1) * F.col("pop0")))
    return T.cross_coalescence_pairs(joint, ms).select("pop0", "pop1", "t_ix", F.round("rccr", 6).alias("rccr"))


@query("newick_support", """with t as (select o_orderkey as k, substr('abcd', cast(o_orderkey % 4 + 1 as int), 1) as x, substr('abcd', cast((o_orderkey + 1 + o_custkey % 3) % 4 + 1 as int), 1) as y from orders),
n as (select least(x, y) || greatest(x, y) as pair, count(*) as n from t group by 1) select pair, n, round(cast(n as double) / (select count(*) from t), 9) as share from n""", use_lens=False)
def _(spark, d):
    """Trees of four leaves, two of them a clade; their order, names and lengths differ."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    letter = lambda n: F.substring(F.lit("abcd"), n.cast("int"), F.lit(1))
    t = lens.read(spark, d, "orders").select(k.alias("k"), letter(k % 4 + 1).alias("x"), letter((k + 1 + c % 3) % 4 + 1).alias("y"))
    rest = F.array_except(F.array(*map(F.lit, "abcd")), F.array("x", "y"))
    text = F.concat(F.lit("("), F.get(rest, F.lit(0)), F.lit(":1,('"), "x", F.lit("':0.5,"), "y", F.lit(" [y])n"), F.col("k").cast("string"), F.lit(":2.0,"), F.get(rest, F.lit(1)), F.lit(");"))
    pairs = t.select(F.array_sort(F.array("x", "y")).alias("p")).distinct().select(F.concat_ws("", "p").alias("pair"), K2.clade_of(F.col("p")).alias("clade"))
    return K2.clade_support(t.withColumn("text", text), "text", "k").join(pairs, "clade").select("pair", "n", F.round("share", 9).alias("share"))


@query("mask_compress", """with b as (select 's' || (p_partkey % 3) as contig, row_number() over (partition by p_partkey % 3 order by p_partkey) - 1 as k, substr('ACGT', cast(p_size % 4 + 1 as int), 1) as c from part),
z as (select contig, string_agg(c, '' order by k) filter (k % 5 = 0) as kept, count(*) as n from b group by 1) select contig, kept, cast(n as bigint) as length, (select md5(string_agg(y.c, '' order by x.k)) from b x join b y on y.contig = x.contig and y.k = (x.k + 2) // 5 * 5 where x.contig = z.contig) as back,
  (select count(*) from b x where x.contig = z.contig and (x.k + 2) // 5 * 5 >= n) as blank from z where n % 5 in (1, 2, 3)""", use_lens=False)
def _(spark, d):
    """Every fifth base of sequences in chunks, and back; contigs whose last base is in reach of the last one kept."""
    k = F.col("p_partkey")
    p = lens.read(spark, d, "part").select(F.concat(F.lit("s"), (k % 3).cast("string")).alias("contig"), k.alias("k"), F.expr("p_partkey div 37").alias("chunk"), F.substring(F.lit("ACGT"), (F.col("p_size") % 4 + 1).cast("int"), F.lit(1)).alias("c"))
    chunks = p.groupBy("contig", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]), "").alias("seq"))
    lengths = p.groupBy("contig").agg(F.count("*").alias("length"))
    small = X.compress_chunks(chunks, 5)
    whole = lambda df, name: df.groupBy("contig").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]), "").alias(name))
    out = whole(small, "kept").join(lengths, "contig").join(whole(X.decompress_chunks(small, lengths, 5), "all"), "contig").where("length % 5 in (1, 2, 3)")
    return out.select("contig", "kept", "length", F.md5("all").alias("back"), F.expr("length(all) - length(replace(all, 'N', ''))").cast("long").alias("blank"))


@query("treemix_edges", "with e as (select c_nationkey as parent, c_custkey % 40 as child, cast(c_custkey as bigint) as edge from customer) select edge, p.n_name as parent_name, c.n_name as child_name from e left join nation p on p.n_nationkey = e.parent left join nation c on c.n_nationkey = e.child", use_lens=False)
def _(spark, d):
    e = lens.read(spark, d, "customer").select(F.col("c_nationkey").alias("parent"), (F.col("c_custkey") % 40).alias("child"), F.col("c_custkey").cast("long").alias("edge"))
    v = lens.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return T.vertices_of(e, v).select("edge", F.col("p.name").alias("parent_name"), F.col("c.name").alias("child_name"))


def members(spark: SparkSession, d: str) -> DataFrame:
    return lens.read(spark, d, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("ix"))


@query("downsample_groups", "select grp, ix from (select c_nationkey as grp, c_custkey as ix, row_number() over (partition by c_nationkey order by md5(concat('1:', c_custkey)), c_custkey) as r from customer) where r <= 5", use_lens=False)
def _(spark, d):
    return T.downsample_groups(members(spark, d), "grp", 5)


@query("permute_groups", "with a as (select c_nationkey as grp, row_number() over (order by c_nationkey, c_custkey) as k from customer), b as (select c_custkey as ix, row_number() over (order by md5(concat('1:', c_custkey)), c_custkey) as k from customer) select grp, ix from a join b using (k)", use_lens=False)
def _(spark, d):
    return T.permute_groups(members(spark, d), "grp").select("grp", "ix")


@query("index_sound", "select count(*) as n, count(*) = count(distinct n_nationkey) and min(n_nationkey) = 0 and max(n_nationkey) = count(*) - 1 as sound from nation", use_lens=False)
def _(spark, d):
    return T.index_sound(lens.read(spark, d, "nation"), "n_nationkey")


@query("sample_places", "with l as (select n_name as name, n_nationkey as ix from nation where n_nationkey < 18), r as (select n_name as name, 24 - n_nationkey as ix from nation where n_nationkey > 6) select m as mode, name, l_ix, r_ix from (select name, l.ix as l_ix, r.ix as r_ix from l full join r using (name)) x, (select unnest(['intersect', 'left', 'right', 'all', 'exclude']) as m) u where case m when 'intersect' then l_ix is not null and r_ix is not null when 'left' then l_ix is not null when 'right' then r_ix is not null when 'exclude' then l_ix is null or r_ix is null else true end", use_lens=False)
def _(spark, d):
    n = lens.read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ix"))
    left, right = n.where("ix < 18"), n.where("ix > 6").withColumn("ix", 24 - F.col("ix"))
    parts = [J.sample_places(left, right, m).select(F.lit(m).alias("mode"), "name", "l_ix", "r_ix") for m in ("intersect", "left", "right", "all", "exclude")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("interval_names", "select p_partkey, concat('c', cast(p_partkey % 3 as varchar)) as chrom, cast(p_partkey as bigint) as start, cast(p_partkey + p_size as bigint) as \"end\", 'run' || cast(p_partkey as varchar) as stem, replace(replace('(A,B:1)', 'A', 'X1'), 'X1,B', 'XB') as tree, 2.5::double * (1 - cast(p_size % 10 as double) / 10) as rate from part", use_lens=False)
def _(spark, d):
    k = F.col("p_partkey")
    x = lens.read(spark, d, "part").withColumn("t", F.concat(F.lit("c"), (k % 3).cast("string"), F.lit(":"), k.cast("string"), F.lit("-"), (k + F.col("p_size")).cast("string")))
    tree = N.rename_clades(F.lit("(A,B:1)"), {"A": "X1", "X1,B": "XB"})
    return x.select("p_partkey", N.interval("t").alias("i"), N.strip_suffixes(F.concat(F.lit("run"), k.cast("string"), F.lit(".trees.vcf.gz"))).alias("stem"), tree.alias("tree"), N.adjusted_rate(F.lit(2.5), (F.col("p_size") % 10).cast("double") / 10).alias("rate")).select("p_partkey", "i.*", "stem", "tree", "rate")


@query("index_grid", "select a.n_nationkey as i0, b.n_nationkey as i1, c.n_regionkey as i2 from nation a, nation b, (select distinct n_regionkey from nation) c where a.n_nationkey < 5 and b.n_nationkey < 5 and c.n_regionkey < 5", use_lens=False)
def _(spark, d):
    return N.grid(lens.read(spark, d, "region").select(F.col("r_regionkey").alias("ix")), 3)


@query("haplotype_pairs", "select concat(2 * a.n_nationkey, '-', 2 * b.n_nationkey + 1) as pair from nation a, nation b where a.n_regionkey = 0 and b.n_regionkey = 1", use_lens=False)
def _(spark, d):
    n = lens.read(spark, d, "nation")
    return N.haplotype_pairs(n.where("n_regionkey = 0").select((2 * F.col("n_nationkey")).alias("h")), n.where("n_regionkey = 1").select((2 * F.col("n_nationkey") + 1).alias("h")))


# --- substitution, imputation, flips ------------------------------------------


@query("substitute", ", k as (select site_id, count(*) filter (dp >= 20 and a1 = 0) + count(*) filter (dp >= 20 and a2 = 0) as n0, count(*) filter (dp >= 20 and a1 = 1) + count(*) filter (dp >= 20 and a2 = 1) as n1, count(*) filter (dp >= 20 and a1 = 2) + count(*) filter (dp >= 20 and a2 = 2) as n2 from lens_geno group by 1) select * from k where site_id % 5 <> 0 and not (site_id % 7 = 0 and n2 > 0)")
def _(s, *_):
    swap = lambda a: F.when(a == 1, 2).when(a == 2, 1).otherwise(a)
    t = U.depth_to_miss(s.where("site_id % 5 <> 0"), 20)
    t = t.withColumn("gt", F.transform("gt", lambda g: F.struct(swap(g["a0"]).alias("a0"), swap(g["a1"]).alias("a1"), g["phased"].alias("phased"))))
    t = t.withColumn("alt", F.when(F.col("site_id") % 7 == 0, F.array(F.lit("T"), F.lit("C"))).otherwise(F.array(F.lit("G"), F.lit("C"))))
    out = counted(I.substitute(s, t, ["site_id"]))
    return out.select("site_id", *[F.get("counts", F.lit(i)).cast("long").alias(f"n{i}") for i in range(3)])


@query("restore_missing", ", k as (select site_id, count(*) filter (a1 >= 0) as n from lens_geno group by 1) select site_id, case when site_id % 2 = 0 then n else 0 end as n0, case when site_id % 2 = 0 then n else 2 * n end as n1 from k")
def _(s, *_):
    call = F.struct((F.col("site_id") % 2).cast("int").alias("a0"), F.lit(1).alias("a1"), F.lit(True).alias("phased"))
    out = counted(I.restore_missing(s, s.withColumn("gt", F.transform("gt", lambda _: call)), ["site_id"]))
    return out.select("site_id", *[F.get("counts", F.lit(i)).cast("long").alias(f"n{i}") for i in range(2)])


@query("dummy_chromosome", " select site_id, 'd1' as chrom, pos - 99 as pos from lens_sites where pos between 100 and 900")
def _(s, *_):
    return I.dummy_chromosome(s, 100, 900, "d1").select("site_id", "chrom", "pos")


@query("ancestral_homozygotes", " select site_id, case when count(*) filter (a1 = a2 and a1 > 0) > count(*) filter (a1 = 0 and a2 = 0) then 'C' end as aa from lens_geno group by 1")
def _(s, *_):
    return I.ancestral_by_homozygotes(s).select("site_id", "aa")


@query("flip_by_states", f", k as (select *, {AA} as st from sa) select site_id, st <> 'A' as flipped, case when st = 'A' then 'A' else 'C' end as ref, case when st = 'A' then n0 else n1 end as n0, case when st = 'A' then n1 else n0 end as n1 from k where st in ('A', 'C')")
def _(s, *_):
    states = with_aa(s).select("chrom", "pos", F.col("aa").alias("state"))
    out = counted(I.flip_by_states(s, states, ["chrom", "pos"], drop_unresolved=True))
    return out.select("site_id", "flipped", "ref", *[F.get("counts", F.lit(i)).cast("long").alias(f"n{i}") for i in range(2)])


@query("flip_by_probability", ", k as (select *, cast(site_id % 101 as double) / 100 as p from sa) select site_id, p < 0.5 as flipped, case when p < 0.5 then n1 else n0 end as n0 from k")
def _(s, *_):
    out = counted(I.flip_by_probability(s.withColumn("p", (F.col("site_id") % 101).cast("double") / 100)))
    return out.select("site_id", "flipped", F.get("counts", F.lit(0)).cast("long").alias("n0"))


@query("flip_share", " select count(*) filter (site_id % 101 < 50) as flipped, count(*) as sites, cast(count(*) filter (site_id % 101 < 50) as double) / count(*) as frac from lens_sites")
def _(s, *_):
    return I.flip_share(s.select(((F.col("site_id") % 101).cast("double") / 100).alias("p")))


@query("haplotypes_in_turn", " select site_id, string_agg(cast(a1 as varchar), '' order by sample_ix) || string_agg(cast(a2 as varchar), '' order by sample_ix) as haps from lens_geno group by 1")
def _(s, *_):
    return s.select("site_id", F.array_join(F.transform(N.haplotypes_in_turn(), lambda a: a.cast("string")), "").alias("haps"))


# --- counts of sites and samples ------------------------------------------------


@query("outgroup_missing", ", k as (select site_id, count(*) filter (sample_ix in (3, 7) and (a1 in (0, 1) or a2 in (0, 1))) as n from lens_geno group by 1) select count(*) filter (n = 0) as missing, count(*) as sites, cast(count(*) filter (n = 0) as double) / count(*) as frac from k")
def _(s, *_):
    return Y.outgroup_missing(s, [3, 7])


@query("mean_called", ", k as (select site_id, count(*) filter (a1 in (0, 1)) + count(*) filter (a2 in (0, 1)) as n from lens_geno where sample_ix not in (3, 7) group by 1) select round(avg(n), 9) as mean_called, count(*) as sites from k where n > 0")
def _(s, *_):
    return Y.mean_called(s, [i for i in range(25) if i not in (3, 7)]).select(F.round("mean_called", 9).alias("mean_called"), "sites")


@query("site_density", ' select chrom, count(*) as sites, min(pos) as first, max(pos) as last, cast(count(*) as double) / (max(pos) - min(pos)) as density from lens_sites group by 1')
def _(s, *_):
    return Y.site_density(s)


@query("genotype_classes", ", p as (select min(pos) as pos from lens_sites where chrom = 'c1') select cast(sample_ix as int) as sample_ix, cast(case when dp < 3 then -2 else a1 + a2 end as int) as factor, case when dp < 3 then 'low' when a1 + a2 = 0 then 'wt' when a1 + a2 = 1 then 'het' when a1 + a2 = 2 then 'hom' else 'bad' end as kind from lens_geno where chrom = 'c1' and pos = (select pos from p)")
def _(s, *_):
    first = s.where("chrom = 'c1'").agg(F.min("pos")).first()[0]  # one number
    return Y.genotype_classes(s, "c1", first or 0)


@query("listed_sites", ", f as (select chrom, pos, site_id, 2 as file_ix from lens_sites union all select chrom, pos, site_id + 1000000, 1 from lens_sites where site_id % 10 = 0) select chrom, pos, arg_min(site_id, file_ix) as site_id from f where pos % 3 = 0 group by 1, 2")
def _(s, *_):
    s = s.select("chrom", "pos", "site_id")
    files = s.withColumn("file_ix", F.lit(2)).unionByName(s.where("site_id % 10 = 0").withColumn("site_id", F.col("site_id") + 1000000).withColumn("file_ix", F.lit(1)))
    return Y.listed_sites(files, s.where("pos % 3 = 0")).select("chrom", "pos", "site_id")


@query("template_outgroup", " select site_id from lens_sites where (chrom, pos) in (select (chrom, pos) from lens_geno where sample_ix in (3, 7) and (a1 in (0, 1) or a2 in (0, 1)))")
def _(s, *_):
    return Y.with_template_outgroup(s, s, [3, 7]).select("site_id")


# --- ancestral classes, cohorts, chunk files ---------------------------------

CLASSES = ", k as (select site_id, count(*) filter (a1 = 0 and a2 = 0) as hr, count(*) filter (a1 >= 0 and a2 >= 0 and a1 <> a2) as he, count(*) filter (a1 = a2 and a1 > 0) as ha, bool_or(a1 = 2 or a2 = 2) as two, bool_or(a1 > 0 or a2 > 0) as varies, cast(site_id % 101 as double) / 100 as p from lens_geno group by site_id)"


def short_alt(s: DataFrame) -> DataFrame:
    """Sites without the second ALT where nobody has it."""
    return s.withColumn("alt", F.when(F.exists(S.called(), lambda a: a == 2), F.col("alt")).otherwise(F.slice("alt", 1, 1)))


def with_outgroups(s: DataFrame) -> DataFrame:
    pick = lambda letters, n: F.element_at(F.array(*map(F.lit, letters)), (F.col("site_id") % n + 1).cast("int"))
    return s.withColumns({"out1": pick("ACNT", 4), "out2": pick("ACNAGCN", 7)})


@query("ancestral_by_probability", CLASSES + """, x as (select *, 2 * hr + he as r, 2 * ha + he as a from k),
y as (select *, case when a < 3 then 'mono' when two then 'multi' when not (p > 0.95 or p < 0.05) then 'ambiguous' when (p > 0.95) = (r > a) then 'unflipped' else 'flipped' end as reason from x)
select site_id, reason, case reason when 'unflipped' then 'A' when 'flipped' then 'C' end as aa, reason in ('flipped', 'unflipped') and p < 0.05 as against from y""")
def _(s, *_):
    p = (F.col("site_id") % 101).cast("double") / 100
    return A.ancestral_by_probability(short_alt(s).withColumn("p", p)).select("site_id", "reason", "aa", "against")


OUTGROUPS = CLASSES + f""", o as (select *, {OUT} from k), e as (select *, case when out1 = 'N' and out2 = 'N' then 'missing' when two then 'multi' when out1 not in ('A', 'C') and out2 not in ('A', 'C') then 'orthogonal' end as reason from o),
l as (select *, case when reason is null then concat(2 * hr + he, ',', 2 * ha + he, ',0,0', chr(9), (out1 = 'A')::int, ',', (out1 = 'C')::int, ',', (out1 = 'G')::int, ',', (out1 = 'T')::int, chr(9), (out2 = 'A')::int, ',', (out2 = 'C')::int, ',', (out2 = 'G')::int, ',', (out2 = 'T')::int) end as line from e)"""


@query("outgroup_lines", OUTGROUPS + " select site_id, reason, not varies as mono, line, case when reason is null then out1 <> 'A' end as minor1, case when reason is null then out2 <> 'A' end as minor2 from l")
def _(s, *_):
    return A.outgroup_lines(with_outgroups(short_alt(s))).select("site_id", "reason", "mono", "line", "minor1", "minor2")


@query("outgroup_report", OUTGROUPS + " select count(*) filter (reason = 'missing') as missing, count(*) filter (reason = 'multi') as multi, count(*) filter (reason = 'orthogonal') as orthogonal, count(*) filter (coalesce(reason, 'orthogonal') = 'orthogonal' and not varies) as mono, count(*) filter (reason is null and out1 <> 'A') as minority1, count(*) filter (reason is null and out1 = 'A') as majority1, count(*) filter (reason is null and out2 <> 'A') as minority2, count(*) filter (reason is null and out2 = 'A') as majority2 from l")
def _(s, *_):
    return A.outgroup_report(A.outgroup_lines(with_outgroups(short_alt(s))))


AAN = "case site_id % 6 when 0 then 'A' when 1 then 'C' when 2 then 'G' when 3 then 'N' when 4 then 'A' end"


@query("ancestral_agreement", f", k as (select *, {OUT}, coalesce({AAN}, 'N') as aa from sa), u as (select *, alc > 2 and aa <> 'N' as u, aa = ['A', 'C', 'G'][maj + 1] as top from k) select count(*) filter (u and aa = 'A') as ref, count(*) filter (u and aa <> 'A') as alt, count(*) filter (u and top) as major, count(*) filter (u and not top) as minor, count(*) filter (u and (aa = out1 or aa = out2)) as outgroup, count(*) filter (u and aa <> out1 and aa <> out2) as no_outgroup, count(*) filter (alc = 1 and aa <> 'A') as mono_other, count(*) filter (alc > 2 and aa = 'N') as ambiguous from u")
def _(s, *_):
    aa = F.get(F.array(*[F.lit(x) for x in ("A", "C", "G", "N", "A", None)]), (F.col("site_id") % 6).cast("int"))
    return A.agreement(with_outgroups(s).withColumn("aa", aa))


@query("ancestral_copied", f" select site_id, {AAQ} as aa from lens_sites")
def _(s, *_):
    aa = F.when(F.col("site_id") % 5 != 0, F.element_at(F.array(*map(F.lit, "ACGT")), (F.col("site_id") % 4 + 1).cast("int")))
    return A.copy_ancestral(s, s.select("site_id", "chrom", "pos", "ref", aa.alias("aa"))).select("site_id", "aa")


@query("ancestral_match", "select p_partkey, cast(p_partkey % 2 as int) as plain, cast(case when p_partkey % 5 = 0 then 2 else p_partkey % 2 end as int) as code from part", use_lens=False)
def _(spark, d):
    odd = F.col("p_partkey") % 2 == 1
    s = lens.read(spark, d, "part").select("p_partkey", F.lit("A").alias("ref"), F.array(F.lit("C")).alias("alt"), F.when(odd, "a").otherwise("C").alias("b"))
    code = F.when(F.col("p_partkey") % 5 == 0, "R").otherwise(F.col("b"))
    return s.select("p_partkey", A.ancestral_is_ref(F.col("b")).alias("plain"), A.ancestral_is_ref(code, unresolved=True).alias("code"))


def cohort(spark: SparkSession, d: str) -> DataFrame:
    """The metadata of 25 nations, as samples."""
    return lens.read(spark, d, "nation").select(F.col("n_nationkey").alias("ix"), F.col("n_name").alias("id"), F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("pop_short"))


@query("cohort_groups", "select concat('p', n_regionkey) as value, string_agg(n_nationkey, ',' order by n_nationkey) as members, cast(row_number() over (order by min(n_nationkey)) - 1 as int) as place from nation group by n_regionkey", use_lens=False)
def _(spark, d):
    return H.groups(cohort(spark, d), "pop_short").withColumn("members", F.array_join(F.transform("members", lambda i: i.cast("string")), ","))


@query("cohort_nodes", "select concat('p', n_regionkey) as value, cast(2 * n_nationkey + i as int) as node from nation, (select unnest([0, 1]) as i) where n_regionkey in (1, 3)", use_lens=False)
def _(spark, d):
    return H.nodes(cohort(spark, d), "pop_short", ["p3", "p1"])


@query("cohort_one_node", "select n_nationkey as ix, cast(2 * n_nationkey + (strpos('0123456789abcdef', substr(md5(concat('1:', n_nationkey)), 1, 1)) - 1) % 2 as bigint) as node from nation", use_lens=False)
def _(spark, d):
    return H.one_node(cohort(spark, d))


@query("cohort_subsample", "select c_custkey from customer order by md5(concat('1:', c_custkey)), c_custkey limit 20", use_lens=False)
def _(spark, d):
    return H.subsample(lens.read(spark, d, "customer").select("c_custkey"), 20, "c_custkey")


@query("cohort_poplabels", "select cast(24 - n_nationkey as int) as ord, concat(n_name, ' p', n_regionkey, ' p', n_regionkey, ' NA') as line from nation", use_lens=False)
def _(spark, d):
    m = cohort(spark, d)
    return H.poplabels(m.select((24 - F.col("ix")).alias("ord"), "id"), m)


@query("cohort_chosen_nodes", "with r as (select n_regionkey, n_nationkey, row_number() over (partition by n_regionkey order by md5(concat('1:', n_nationkey)), n_nationkey) as r from nation) select concat('p', n_regionkey) as value, string_agg(concat(2 * n_nationkey, ',', 2 * n_nationkey + 1), ',' order by n_nationkey) as nodes from r where r <= 2 group by n_regionkey", use_lens=False)
def _(spark, d):
    return H.chosen_nodes(cohort(spark, d), "pop_short", 2)


@query("zip_fields", "select p_partkey as ord, concat(p_size, ' ', s_nationkey) as line from part join supplier on p_partkey = s_suppkey", use_lens=False)
def _(spark, d):
    one = lens.read(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("\tx y")).alias("line"))
    two = lens.read(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("z  "), F.col("s_nationkey").cast("string")).alias("line"))
    return H.zip_fields(one, two)


@query("chunk_names", "with p as (select s_suppkey, concat('c', s_nationkey % 3) as chrom, cast(s_suppkey * 37 % 900 + 1 as bigint) as a, least(s_suppkey * 37 % 900 + 1 + s_nationkey * 30, 950) as b from supplier), q as (select *, unnest(range(cast((a - 1) // 100 as bigint), cast((b - 1) // 100 + 1 as bigint))) as chunk from p) select s_suppkey, chunk, concat('f_', chrom, ':', chunk * 100 + 1, '-', least((chunk + 1) * 100, 950), '_x') as name from q", use_lens=False)
def _(spark, d):
    start = F.col("s_suppkey") * 37 % 900 + 1
    spans = lens.read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("c"), (F.col("s_nationkey") % 3).cast("string")).alias("chrom"), start.alias("start"), F.least(start + F.col("s_nationkey") * 30, F.lit(950)).alias("end"), F.lit(950).alias("length"))
    return K.chunk_names(spans, 100, "f_", "_x").select("s_suppkey", F.col("chunk").cast("long").alias("chunk"), "name")


HEAD = "select n_nationkey as ord, case n_regionkey when 0 then concat('##contig=<ID=NC_', n_nationkey, '>') when 1 then concat('##INFO=<ID=AA', n_nationkey % 2, '>') when 2 then '##INFO=<ID=DP>' when 3 then concat('##contig=<ID=X', n_nationkey, '>') else concat('c1', chr(9), n_nationkey) end as line from nation"


def header_table(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("n_regionkey"), F.col("n_nationkey").cast("string")
    parts = [F.concat(F.lit("##contig=<ID=NC_"), k, F.lit(">")), F.concat(F.lit("##INFO=<ID=AA"), (F.col("n_nationkey") % 2).cast("string"), F.lit(">")), F.lit("##INFO=<ID=DP>"), F.concat(F.lit("##contig=<ID=X"), k, F.lit(">")), F.concat(F.lit("c1\t"), k)]
    return lens.read(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.get(F.array(*parts), n).alias("line"))


@query("header_stripped", f"with h as ({HEAD}) select ord, line from h where (not starts_with(line, '##contig') or starts_with(line, '##contig=<ID=NC_1')) and (not starts_with(line, '##INFO') or starts_with(line, '##INFO=<ID=AA'))", use_lens=False)
def _(spark, d):
    return K.strip_header(header_table(spark, d), "NC_1", "AA")


@query("header_replaced", f"with h as ({HEAD}) select 0 as part, ord, line from h where line like '##%' and (line not like '##contig%' or line like '##contig=<ID=NC%') union all select 1, 24 - ord, line from h where line not like '##%'", use_lens=False)
def _(spark, d):
    h = header_table(spark, d)
    return K.reheader(h.withColumn("ord", 24 - F.col("ord")), h)


@query("global_windows", ", x as (select distinct chrom, (pos - 1) // 250 as win from lens_sites), n as (select chrom, max(win) + 1 as n from x group by 1), o as (select chrom, coalesce(sum(n) over (order by chrom rows between unbounded preceding and 1 preceding), 0) as start from n) select chrom, cast(win as bigint) as win, cast(start + win as bigint) as global_ix from x join o using (chrom)")
def _(s, *_):
    return W.global_index(s.select("chrom", F.expr("(pos - 1) div 250").alias("win")).distinct())


@query("nonrepeat", ISLANDS + ", p as (select chrom, unnest(range(1, 19002, 250)) as a from (select distinct chrom from raw)) select p.chrom, a + 500 as pos, round(1 - cast(coalesce(sum(least(a + 999, m.e) - greatest(a, m.s) + 1), 0) as double) / 1000, 9) as nonrepeat_frac from p left join m on m.chrom = p.chrom and m.s <= a + 999 and a <= m.e group by p.chrom, a")
def _(s, spark, d):
    m = raw_mask(spark, d)
    lengths = m.select("chrom").distinct().withColumn("length", F.lit(20000).cast("long"))
    return W.nonrepeat(lengths, m, 1000, 250).withColumn("nonrepeat_frac", F.round("nonrepeat_frac", 9))


# --- count models, projections, genealogies ---------------------------------

def model_sql(z: str, cut: float) -> str:
    one = lambda c: f"avg(case when {c} then 1.0::double else 0.0::double end)"
    return WIN + f""", own as (select sample_ix, median(cast(depth_sum as double) / sites) as own from wd where sites >= 10 group by 1),
sc as (select sample_ix, own / (select median(own) from own) as s from own),
y as (select wd.*, case when s > 0 then s end as s, case when s > 0 then cast(depth_sum as double) / (sites * s) end as y from wd left join sc using (sample_ix)),
per as (select chrom, win, median(y) as mu, avg(y) as m, var_samp(y) as v, max(sites) as ns from y group by 1, 2 having max(sites) >= 10 and median(y) > 0),
ph as (select case when p > 0 then p else 1e-6 end as phi from (select median(greatest((v - m) / (m * m + 1e-12), 0)) as p from per where v is not null)),
l as (select y.*, mu, v, ns, phi, mu * sites * s as lam from y join per using (chrom, win), ph), z as (select *, {z} as z from l),
f as (select chrom, win, max(ns) as sites, {one(f'z <= {cut!r}')} as low_frac, {one(f'z >= {-cut!r}')} as high_frac, round(max(mu), 6) as mu, round(max(phi), 6) as phi from z group by 1, 2)
select * from f where low_frac >= 0.05 or high_frac >= 0.05"""


def model_outliers(s: DataFrame, model: str) -> DataFrame:
    out = C.count_outliers(W.window_depth(s, 250), model, alpha=0.05, min_sites=10, min_depth=0.0)
    return out.select("chrom", "win", "sites", "low_frac", "high_frac", F.round("mu", 6).alias("mu"), F.round("phi", 6).alias("phi"))


query("depth_outliers_normal", model_sql("(depth_sum - lam) / sqrt(lam + phi * lam * lam)", NormalDist().inv_cdf(0.05)))(lambda s, *_: model_outliers(s, "normal"))
query("depth_outliers_ragweed", model_sql("(y - mu) / sqrt(v)", NormalDist().inv_cdf(2 * NormalDist().cdf(-2.0))))(lambda s, *_: model_outliers(s, "ragweed"))
# tails of the discrete models: tested against exact sums
query("depth_outliers_nbinom")(lambda s, *_: model_outliers(s, "nbinom"))
query("depth_outliers_poisson")(lambda s, *_: model_outliers(s, "poisson"))


@query("an_histogram", "select cast(least(an, 40) // 4 as int) as bin, count(*) as n from sa where an >= 8 group by 1")
def _(s, *_):
    return C.an_histogram(counted(s), S.an(), 4, 8, 40)


@query("project_counts", "select site_id, cast(12 as bigint) as an from sa where an >= 12")
def _(s, *_):
    drawn = C.project_counts(counted(s), 12, "site_id").where("drawn is not null")
    return drawn.select("site_id", F.aggregate("drawn", F.lit(0).cast("long"), lambda t, x: t + x).alias("an"))


@query("thin_exponential", """, t as (
  select site_id, chrom, pos, cast(row_number() over (partition by chrom order by pos, site_id) as bigint) as n,
    pos - 1 + greatest(20.0, least(400.0, -100.0 * ln((cast('0x' || substr(md5('7:' || chrom || ':' || pos || ':' || site_id), 1, 8) as bigint) + 0.5) / 4294967296.0))) as goal from lens_sites),
k as (select a.chrom, a.n, greatest(a.n, 1 + (select count(*) from t b where b.chrom = a.chrom and b.pos <= a.goal)) as kept from t a),
w as (with recursive r(chrom, kept) as (
  select chrom, kept from k where n = 1 union all select k.chrom, k.kept from r join k on k.chrom = r.chrom and k.n = r.kept + 1) select * from r)
select site_id, t.chrom, pos from t join w on w.chrom = t.chrom and w.kept = t.n""")
def _(s, *_):
    return Z.thin_exponential(s, 100.0, 20.0, 400.0, seed=7, order=("site_id",)).select("site_id", "chrom", "pos")


def outgroups(s: DataFrame) -> DataFrame:
    """Two outgroup bases a site, some unknown."""
    pick = lambda letters, n: F.element_at(F.array(*map(F.lit, letters)), (F.col("site_id") % n + 1).cast("int"))
    return s.withColumns({"out1": pick("ACNT", 4), "out2": pick("ACNAGCN", 7)})


SEEN = "(({0} = 'A' and n0 > 0) or ({0} = 'C' and n1 > 0) or ({0} = 'G' and n2 > 0))"


@query("est_inference", f""", o as (select *, {SECOND} as sec, substr('ACNT', cast(site_id % 4 + 1 as int), 1) as out1, substr('ACNAGCN', cast(site_id % 7 + 1 as int), 1) as out2 from sa),
e as (select *, cast(least(an, 50) // 5 as int) as b from o where an >= 10 and alc in (1, 2) and ({SEEN.format("out1")} or {SEEN.format("out2")})),
h as (select g.b, count(e.site_id) as n from range(0, 11) g(b) left join e on e.b = g.b group by 1),
q as (with recursive r(b, gid, held, closed) as (
    select b, 0, n, n >= (select count(*) // 4 from e) from h where b = 10
    union all select h.b, r.gid + r.closed::int, h.n + case when r.closed then 0 else r.held end, h.n + case when r.closed then 0 else r.held end >= (select count(*) // 4 from e)
    from r join h on h.b = r.b - 1 where h.b >= 2) select * from r),
g as (select gid, min(b) as low, bool_or(closed) as closed from q group by gid),
z as (select q.b, 5 * coalesce(below.low, g.low) as size from q join g using (gid) left join g below on below.gid = g.gid + 1 and not below.closed),
x as (select e.*, cast(size as int) as bin, row_number() over (partition by size order by chrom, pos, site_id) as ord from e join z using (b)),
y as (select *, cast((ord * 37 + bin) % 101 as double) / 100 as p from x)
select site_id, bin, ord, cast(bin as bigint) as drawn, ['A', 'C', 'G'][case when alc = 1 or p > 0.8 then maj else sec end + 1] as aa, case when alc > 1 and p < 0.2 then 1 - p else p end as aap,
  case out1 when 'A' then '1,0,0,0' when 'C' then '0,1,0,0' when 'T' then '0,0,0,1' else '0,0,0,0' end as anc1 from y where alc = 1 or p > 0.8 or p < 0.2""")
def _(s, *_):
    s, kinds = outgroups(s), {"width": 5, "least": 10, "most": 50}
    enough = E.eligible(s, least=10).count() // 4
    result = lambda lines: lines.select("bin", "ord", (((F.col("ord") * 37 + F.col("bin")) % 101).cast("double") / 100).alias("p"))
    out = E.infer(s, "site_id", result, cut=0.2, enough=enough, **kinds)
    total = F.aggregate(F.transform(F.split("pop", ","), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("site_id", "bin", "ord", total.alias("drawn"), "aa", "aap", "anc1")


@query("f3", """, pf as (select chrom, pos, count(*) filter (pop = 0 and a1 = 1) + count(*) filter (pop = 0 and a2 = 1) as x0, count(*) filter (pop = 0 and a1 in (0, 1)) + count(*) filter (pop = 0 and a2 in (0, 1)) as n0,
count(*) filter (pop = 1 and a1 = 1) + count(*) filter (pop = 1 and a2 = 1) as x1, count(*) filter (pop = 1 and a1 in (0, 1)) + count(*) filter (pop = 1 and a2 in (0, 1)) as n1,
count(*) filter (pop = 2 and a1 = 1) + count(*) filter (pop = 2 and a2 = 1) as x2, count(*) filter (pop = 2 and a1 in (0, 1)) + count(*) filter (pop = 2 and a2 in (0, 1)) as n2 from lens_geno group by 1, 2),
fr as (select cast(x0 as double) / n0 as t, cast(x1 as double) / n1 as a, cast(x2 as double) / n2 as b, n0 from pf where n0 > 1 and n1 > 0 and n2 > 0)
select count(*) as sites, round(avg((t - a) * (t - b) - t * (1 - t) / (n0 - 1)), 9) as f3 from fr""")
def _(s, spark, d):
    return G.f3(W.pop_counts(s, pops(spark, d)), "p0", "p1", "p2").select("sites", F.round("f3", 9).alias("f3"))


@query("map_lines", MAP + """, z as (select chrom, cast(phys as bigint) as phys, gen from mp union all select distinct chrom, 0, 0.0::double from mp),
r as (select *, (lead(gen) over w - gen) / (lead(phys) over w - phys) * 1e6 as rate from z window w as (partition by chrom order by phys)),
q as (select *, coalesce(rate, lag(rate) over (partition by chrom order by phys)) as r2 from r)
select chrom, phys, round(greatest(0.001, least(25, r2)), 3) as rate, round(gen, 5) as gen from q""")
def _(s, spark, d):
    part = F.split("line", "\t")
    return C.map_lines(genetic_map(spark, s)).select("chrom", "phys", F.get(part, F.lit(1)).cast("double").alias("rate"), F.get(part, F.lit(2)).cast("double").alias("gen"))


@query("tmrca", f"with {MS}, a as (select *, coalesce(sum((tr - tl) * lam) over (partition by pop order by t_ix rows between unbounded preceding and 1 preceding), 0) as bf, lead(t_ix) over (partition by pop order by t_ix) as nx from ms), b as (select pop, t_ix, cast(j as int) as j, tl + j / 10.0::double * (tr - tl) as t, tl, lam, bf from a, (select unnest(range(0, 10)) as j) u where nx is not null) select pop, t_ix, j, round(t * 2.0::double / 4.85::double, 6) as years, round(lam * exp(-(bf + (t - tl) * lam)), 9) as pdf, round(1 - exp(-(bf + (t - tl) * lam)), 9) as cdf from b", use_lens=False)
def _(spark, d):
    s = F.col("s_suppkey")
    ms = lens.read(spark, d, "supplier").select((s % 5).alias("pop"), F.expr("s_suppkey div 5").alias("t_ix"), (F.expr("s_suppkey div 5") * 10).cast("double").alias("t_left"), (F.expr("s_suppkey div 5") * 10 + 10).cast("double").alias("t_right"), (1 + (s % 7).cast("double") / 7).alias("lam"))
    return G.tmrca(ms, mu=4.85, gen=2.0, run="pop").select("pop", "t_ix", "j", F.round("years", 6).alias("years"), F.round("pdf", 9).alias("pdf"), F.round("cdf", 9).alias("cdf"))


@query("gnn_group_means", "with g as (select n_regionkey as grp, cast(k as bigint) as k, cast((n_nationkey + k) % 4 + 1 as double) / 10 as gnn from nation, (select unnest(range(0, 3)) as k) u), m as (select grp, k, avg(gnn) as mean from g group by 1, 2) select grp, k, round(mean, 6) as mean, round((mean - avg(mean) over w) / nullif(stddev_pop(mean) over w, 0), 6) as z from m window w as (partition by k)", use_lens=False)
def _(spark, d):
    n = lens.read(spark, d, "nation").select(F.col("n_regionkey").alias("grp"), "n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    g = n.select("grp", F.col("k").cast("long").alias("k"), (((F.col("n_nationkey") + F.col("k")) % 4 + 1).cast("double") / 10).alias("gnn"))
    return G.group_means(g, "grp").select("grp", "k", F.round("mean", 6).alias("mean"), F.round("z", 6).alias("z"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-outlier windows of the cohort, with loose thresholds for the smallest tables."""
    return W.depth_outliers(W.window_depth(lens.sites(spark, sf_dir), 250, most_missing=1.0), alpha=0.1, min_sites=5, min_depth=0.0, threshold=0.0, use_median=False)
