"""DuckDB SQL for the training-data queries that SQL can express."""

WORDS = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DEDUP = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORDS}) as ws from documents),
s as (
  select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as sh from w),
d as (select distinct doc_id, sh from s),
n as (select doc_id, count(*) as n from d group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from d a join d b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.i >= 85 * (x.n + y.n - p.i)),
r(doc_id, c) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on r.c = e.a),
k as (select doc_id, min(c) as component_id from r group by doc_id)
select k.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, k.component_id, k.doc_id = k.component_id as kept
from k left join n using (doc_id)
"""

TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""

NEGATIVES = """
with v as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as anchor_id, q.label as own, c.vec_id, c.label, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0),
p as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as n from s where label = own),
n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and s.label <> s.own and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
  where p.n <= 5)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

MIXING = f"""
with d as (
  select doc_id, source, coalesce(source, 'null source') as src, len(regexp_extract_all(coalesce(text, ''), {WORDS})) as size,
    md5('7:' || coalesce(cast(doc_id as varchar), 'null')) as o from documents),
s0 as (select source, any_value(src) as src, cast(sum(size) as bigint) as source_size from d group by source),
s1 as (select *, [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as w from s0),
s2 as (
  select *, row_number() over (order by source_size / w, source nulls last) as n,
    (1.5::double * sum(source_size) over () - 2 * coalesce(sum(source_size) over (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / (sum(w) over () - coalesce(sum(w) over (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) as lvl from s1),
lam as (select arg_min(lvl, n) as lam, min(n) as n0 from s2 where lvl * w <= 2 * source_size),
t as (
  select source, src, source_size, cast(case when n >= n0 then lam * w else 2.0::double * source_size end as double) as target,
    greatest(1, cast(ceil(source_size / 2000000.0) as bigint)) as shards from s2, lam),
tot as (select cast(floor(sum(target) / 16 + 0.5) as bigint) as blocks, sum(target) as all_t, max(source_size) as most from t),
qs as (
  select src, target, k, row_number() over (order by target / (2 * k - 1) desc, target desc, src) as r
  from t, unnest(range(1, 2 + cast(target / 16 + 2 as bigint))) as u(k)),
quota as (select t.src, count(qs.k) filter (qs.r <= tot.blocks) as quota from t cross join tot left join qs on qs.src = t.src group by t.src),
p as (
  select d.*, t.source_size, t.target, quota.quota, cast('0x' || substr(o, 1, 8) as bigint) % t.shards as shard
  from d join t using (src) join quota using (src)),
sh as (select src, shard, any_value(quota) as quota, cast(sum(size) as bigint) as words from p group by src, shard),
shq as (
  select src, shard, words, quota, row_number() over (partition by src order by words / (2 * k - 1) desc, words desc, shard) as r
  from sh, unnest(range(1, 2 + quota)) as u(k) where words > 0),
seat as (select src, shard, count(*) filter (r <= quota) as seats from shq group by src, shard),
st as (
  select sh.src, sh.shard, sh.words, nb, least(coalesce(seats, 0), 2 * nb) as q,
    cast('0x' || substr(md5('7/' || case when sh.src = 'null source' then chr(0) || 'null' else sh.src end || '/' || sh.shard), 1, 8) as bigint) % greatest(nb, 1) as f
  from (select *, cast(ceil(words / 16.0) as bigint) as nb from sh) sh left join seat using (src, shard)),
c as (
  select p.*, coalesce(sum(size) over (partition by src, shard order by o, size rows between unbounded preceding and 1 preceding), 0) as c from p),
x as (
  select c.*, st.words, st.nb, q // greatest(nb, 1) as passes, q % greatest(nb, 1) as r, f from c join st using (src, shard))
select doc_id, cast(size as bigint) as size, source_size, target, cast(passes * size
  + greatest(0, least(c + size, least((f + r) * 16, words)) - greatest(c, f * 16))
  + greatest(0, least(c + size, greatest(0, (f + r) * 16 - nb * 16)) - c) as bigint) as taken
from x
"""
