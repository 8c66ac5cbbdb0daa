"""DuckDB SQL for the queries that SQL can express; it shares nothing with the operators' methods."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

NEAR_DEDUP = rf"""
with recursive
w as (select doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) >= 3
    then list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))
    when len(ws) > 0 then ['<' || len(ws)::varchar || '>' || array_to_string(ws, ' ')] else [] end) as x
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
e as (
  select c.a, c.b from c join n na on na.doc_id = c.a join n nb on nb.doc_id = c.b
  where 100 * shared >= 85 * (na.n + nb.n - shared)),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
m as (select a as doc_id, min(b) as least_id from r group by a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles,
       least(w.doc_id, coalesce(m.least_id, w.doc_id)) as component_id,
       w.doc_id = least(w.doc_id, coalesce(m.least_id, w.doc_id)) as kept
from w left join n using (doc_id) left join m using (doc_id)"""

_WORDS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
with
i as (select item_id::varchar as item, {_WORDS} as ws from benchmark),
win as (
  select item, least(len(ws), 10) as l,
         unnest(list_transform(range(1, greatest(len(ws) - 10, 0) + 2), lambda k: array_to_string(ws[k:k+9], ' '))) as x
  from i where len(ws) > 0),
d as (select doc_id, {_WORDS} as ws from documents),
sizes as (select distinct l from win),
g as (
  select doc_id, l, unnest(range(1, len(ws) - l + 2)) as k, ws from d join sizes on len(ws) >= l),
dw as (select doc_id, l, k, array_to_string(ws[k:k+l-1], ' ') as x from g),
hit as (select dw.doc_id, dw.k, dw.l, win.item from dw join win on win.x = dw.x and win.l = dw.l),
pos as (
  select doc_id, count(*) as n_hit
  from (select distinct doc_id, unnest(range(k, k + l)) as p from hit) group by doc_id),
its as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join its using (doc_id)"""


_BARE = r"([<\[])(\\*/?(?:s>|INST\]))"

CHAT = rf"""
with
c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g as (
  select conv_id, count(*) as n_turns,
         string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
         coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss,
         sum(17 + length(regexp_replace(role, '{_BARE}', '\1\\\2', 'g')) + length(regexp_replace(text, '{_BARE}', '\1\\\2', 'g'))) as n
  from c group by conv_id)
select conv_id, n_turns::bigint as n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars,
       sha256(loss) as loss_sha256, n::bigint as formatted_chars
from g"""

_BYTES = r"list_transform(regexp_extract_all(hex(x), '..'), lambda h: ('0x' || h)::bigint)"

RESAMPLING = rf"""
with recursive
bits(i, k, c) as (
  select range, 0, range from range(256)
  union all select i, k + 1, case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end from bits where k < 8),
tab as materialized (select list(c order by i) as t from bits where k = 8),
d as materialized (select row_number() over () as row, doc_id, {_WORDS} as ws from documents),
b as materialized (select {_WORDS} as ws from benchmark),
runs as (select unnest([1, 2, 3]) as l),
df as materialized (
  select row, array_to_string(ws[k:k+l-1], ' ') as x
  from (select row, ws, l, unnest(range(1, len(ws) - l + 2)) as k from d, runs where len(ws) >= l)),
bf as materialized (
  select array_to_string(ws[k:k+l-1], ' ') as x
  from (select ws, l, unnest(range(1, len(ws) - l + 2)) as k from b, runs where len(ws) >= l)),
f as materialized (
  select x, xor(list_reduce(list_prepend(4294967295, {_BYTES}),
                lambda p, q: xor(p >> 8, t[(xor(p, q) & 255) + 1])), 4294967295) % 10000 as bucket
  from (select distinct x from (select x from df union all select x from bf)), tab),
s as (select bucket, count(*) as n from df join f using (x) group by bucket),
t as (select bucket, count(*) as n from bf join f using (x) group by bucket),
gains as materialized (
  select range as bucket,
         floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select count(*) from df) + 10000)::double
           / ((coalesce(s.n, 0) + 1)::double * ((select count(*) from bf) + 10000)::double)))::bigint as gain
  from range(10000) left join s on s.bucket = range left join t on t.bucket = range),
w as (select row, count(*) as n, sum(gain) as weight from df join f using (x) join gains using (bucket) group by row),
scored as (
  select doc_id, len(ws) as n_words, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::bigint + 0.5::double) / 4294967296))))::bigint as score
  from d left join w using (row)),
r as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as total
  from scored where n_words >= 20)
select scored.doc_id, n_features, weight, score, rank::bigint as rank
from scored left join (select * from r where rank <= 5 * total // 100) r using (doc_id)"""

_TERMS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

SOURCE_AUDIT = f"""
with
d as materialized (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, {_TERMS} as ts from documents),
w as materialized (select row, lang, source, unnest(ts) as term from d),
kept as materialized (select lang, term, count(*) as n from w group by lang, term having count(distinct row) >= 3),
v as (select lang, count(*) as v, sum(n) as n from kept group by lang),
g as (select distinct lang, source from d),
c as materialized (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
tot as (select lang, source, sum(n) as n from c group by all),
p as materialized (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as count,
         (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(tot.n, 0) + v.v))::hugeint as p,
         (1 + (1000000000::hugeint * (k.n + 1)) // (v.n + v.v))::hugeint as q
  from g join kept k using (lang) join v using (lang) left join tot on tot.lang = g.lang and tot.source = g.source
  left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
everyone as (
  select x.lang, x.source, y.source as item, coalesce(value, 0)::bigint as value
  from g x join g y on x.lang = y.lang and x.source <> y.source
  left join pairs on pairs.lang = x.lang and pairs.source = x.source and pairs.item = y.source),
terms as (select lang, source, term as item, (((p - q) * (p - q)) // q)::bigint as value from p where count > 0 and p > q),
ranked as (
  select lang, source, 'pair' as part, item, value from everyone
  union all select lang, source, 'term', item, value from terms)
select lang, source, part, item, value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from ranked)
where part = 'pair' or rank <= 200"""


def ORACLES() -> dict[str, str]:
    return {
        "op2_near_dedup": NEAR_DEDUP,
        "op8_decontamination": DECONTAMINATION,
        "op11_chat_format": CHAT,
        "op12_resampling": RESAMPLING,
        "op13_source_audit": SOURCE_AUDIT,
    }
