"""DuckDB SQL for the llm queries that SQL can express on small tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEX = "cast(('0x' || substr(md5({}), 1, 13)) as bigint) / 4503599627370496.0"

#: Poisson counts by the cumulative distribution, and the MD5 of (seed, doc_id, copy) as the shuffle key.
OP2 = f"""with c as (select source, count(*) as n from documents group by source),
t as (select count(*) as k, sum(n) as total from c),
r as (select source, cast(total as double) / k / n as rate from c, t),
p as (select source, rate, unnest(generate_series(0, cast(ceil(20 + rate + 12 * sqrt(rate)) as integer))) as k from r),
q as (select source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by source order by k) as cdf from p),
d as (select doc_id, text, source, {_HEX.format("'17:' || doc_id")} as u from documents),
n as (select d.doc_id, any_value(d.text) as text, any_value(d.source) as source, count(*) filter (where q.cdf <= d.u) as draws
  from d join q on d.source is not distinct from q.source group by d.doc_id),
e as (select doc_id, text, source, unnest(generate_series(0, draws - 1)) as copy from n where draws > 0)
select doc_id, text, source, cast(copy as integer) as copy, {_HEX.format("'17:' || doc_id || ':' || copy")} as shuffle_key from e"""

#: All pairs that share a shingle, and the smallest document that each reaches.
OP3 = f"""with recursive w as (select doc_id, {_WORDS.format(_LOWER)} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as u, b.doc_id as v, count(*) as common from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select u, v from pairs join n x on x.doc_id = u join n y on y.doc_id = v where 100 * common >= 75 * (x.n + y.n - common)),
r(node, least_id) as (select doc_id, doc_id from documents union select l.u, r.least_id from r join l on l.v = r.node)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.least_id) as component_id, d.doc_id = min(r.least_id) as kept
from documents d left join n on n.doc_id = d.doc_id join r on r.node = d.doc_id group by d.doc_id"""

#: All windows of 20 words, numbered among the equal ones; what a later one covers goes.
OP4 = f"""with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
x as (select doc_id, unnest(generate_series(1, len(w) - 19)) as i, w from w where len(w) >= 20),
g as (select doc_id, i, row_number() over (partition by array_to_string(w[i:i + 19], ' ') order by doc_id, i) as n from x),
gone as (select distinct doc_id, unnest(generate_series(i, i + 19)) as p from g where n > 1),
each as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from w),
kept as (select e.doc_id, string_agg(e.word, ' ' order by e.p) as text, count(*) as n from each e anti join gone using (doc_id, p) group by e.doc_id)
select w.doc_id, len(w.w) as n_words, len(w.w) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from w left join kept on kept.doc_id = w.doc_id"""

#: All scores of anchors and rows; components are whole numbers in doubles, so their sums are exact.
OP13 = """with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, cast(list_inner_product(a.q, r.q) as bigint) as score
  from e a join e r on a.vec_id % 50 = 0 and a.vec_id <> r.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3"""

ORACLES = {"op2_mix_sources": OP2, "op3_near_duplicates": OP3, "op4_substring_dedup": OP4, "op13_hard_negatives": OP13}
