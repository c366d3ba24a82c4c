"""The queries in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from .common import UPPER
from .mixture import PRIMES
from .quality import GRIDS, PATH

LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"


def words(text: str, separators: str = r"[\x20\x09-\x0D]+") -> str:
    return f"list_filter(regexp_split_to_array({text}, '{separators}'), lambda w: w <> '')"


ALNUM = words(LOWER, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")

DECONTAMINATE = f"""
with d as (select doc_id, {ALNUM} as w from documents),
i as (select item_id, w, least(10, len(w)) as n from (select item_id, {ALNUM} as w from benchmark) where len(w) > 0),
iw as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') as win from (select *, unnest(range(1, len(w) - n + 2)) as k from i)),
dw as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d cross join (select distinct n from iw))),
hit as (select doc_id, k, dw.n, item_id from dw join iw on dw.n = iw.n and dw.win = iw.win),
spans as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from hit) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hit) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join spans using (doc_id) left join named using (doc_id)"""

SEED, BLOCK = 17, 64
MIXTURE = f"""
with recursive s as (select doc_id, source, len({words("coalesce(text, '')")})::bigint as size,
  md5(concat_ws(':', '{SEED}', coalesce(doc_id::varchar, ''), md5(coalesce(text, '')))) as key from documents),
src as (select source, sum(size)::bigint as source_size, 3 * sum(size)::bigint as most,
  [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w from s group by source),
total as (select sum(source_size)::bigint as t, sum(w)::bigint as ws, count(*) as n from src),
ranked as (select *, coalesce(sum(most) over o, 0)::bigint as m0, coalesce(sum(w) over o, 0)::bigint as w0 from src
  window o as (order by most / w, source nulls last rows between unbounded preceding and 1 preceding)),
held as (select ranked.*, t, ws, most * (ws - w0) <= (t - m0) * w as is_full from ranked, total),
level as (select (max(t) - coalesce(sum(most) filter (is_full), 0))::bigint / (max(ws) - coalesce(sum(w) filter (is_full), 0))::bigint as l from held),
goal as (select source, source_size, case when is_full then most::double else l * w end as target, t from held, level),
dealt as (select source, target / (2 * j + 1) as q from (select source, target, unnest(range(0, greatest(t // {BLOCK}, 1))) as j from goal where t > 0)),
won as (select source, count(*) as n from (select source from dealt order by q desc, source nulls last limit (select greatest(max(t) // {BLOCK}, 1) from goal)) group by 1),
plan as (select goal.*, case when source_size < {BLOCK} then 1 else {BLOCK} end as z, greatest((source_size + z - 1) // z, 1)::bigint as b,
  case when source_size < {BLOCK} then least(floor(target + 0.5), 3 * source_size) else least(coalesce(n, 0), 3 * ((source_size + {BLOCK - 1}) // {BLOCK})) end::bigint as quota
  from goal left join won on goal.source is not distinct from won.source),
placed as (select *, (sum(size) over (partition by source order by key rows between unbounded preceding and current row) - size)::bigint as c from s),
met as (select doc_id, p.source, size, source_size, target, c, z, b, least(quota // b, 3) as f, quota - least(quota // b, 3) * b as r
  from placed p join plan on p.source is not distinct from plan.source),
cut as (select *, unnest(range(c // z, (c + size - 1) // z + 1)) as j from met where size > 0),
got as (select doc_id, sum((least(c + size, (j + 1) * z) - greatest(c, j * z))
  * (f + case when f < 3 and (({PRIMES[SEED % len(PRIMES)]} % b) * j + {SEED * 7919}) % b < r then 1 else 0 end))::bigint as taken from cut group by 1)
select doc_id, source, size, source_size, target, coalesce(taken, 0)::bigint as taken from met left join got using (doc_id)"""

_ALPHA, _LEVEL = 0.05, 0.05
_PATH = ", ".join(f"({t}, {list(GRIDS).index(k)}, '{k}', {cut}::double)" for t, (k, cut) in enumerate(PATH))
_SCORES = {
    "symbols": "n_symbols / nullif(n_words, 0)",
    "repeats": "n_repeat_words / nullif(n_words, 0)",
    "dup_lines": "n_dup_lines / nullif(n_lines, 0)",
    "long_words": "word_chars / nullif(n_words, 0)",
    "short_words": "-(word_chars / nullif(n_words, 0))",
}
QUALITY = f"""
with d as (select doc_id, lang, text, {words("coalesce(text, '')")} as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines from documents),
win as (select doc_id, k, array_to_string(w[k:k + 4], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 3)) as k from d)),
again as (select doc_id, k, count(*) over (partition by doc_id, win) as c from win),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(k, k + 5)) as p from again where c > 1) group by 1),
m as (select d.doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::bigint as n_symbols,
  len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
  from d left join rep using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m),
path as (select * from (values {_PATH}) g(t, i, rule, cut)),
score as ({" union all ".join(f"select doc_id, lang, base_failed, '{k}' as rule, {v} as score from b" for k, v in _SCORES.items())}),
good as (select doc_id from labels where doc_id is not null group by 1 having max(quality) = 1),
over as (select doc_id, lang, rule, i, t from score join path using (rule) where score > cut),
early as (select b.doc_id, b.lang, min(t) as first from b join good on b.doc_id = good.doc_id left join over on b.doc_id = over.doc_id where not base_failed group by 1, 2),
seen as (select lang, t, count(*) as n, count(*) filter (first <= t) as k from early cross join path group by 1, 2),
tail as (select *, case when k >= n * {_ALPHA} then 1.0 else (select sum(exp(lgamma(n + 1.0) - lgamma(x + 1.0) - lgamma(n - x + 1.0) + x * ln({_ALPHA}) + (n - x) * ln(1 - {_ALPHA})))
  from (select unnest(range(0, k + 1)) as x)) end as p from seen),
ok as (select *, bool_and(p <= {_LEVEL} / (select count(distinct coalesce(lang, '~null')) from seen)) over (partition by lang order by t) as fine from tail),
force as (select lang, count(*) as steps from ok where fine group by 1),
gone as (select doc_id, string_agg(rule, ',' order by i) as rules from (select distinct o.doc_id, o.rule, o.i from over o join force f on o.lang is not distinct from f.lang where o.t < f.steps) group by 1)
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and rules is null as kept, coalesce(rules, '') as rejected_by from b left join gone using (doc_id)"""

WARC = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest, case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when first is not null and page_id is distinct from first then first end as refers_to from p left join f using (payload_digest)"""

NGRAM_JOIN = f"""
with recursive d as (select doc_id, {words(LOWER)} as w from documents),
sh as (select distinct doc_id, array_to_string(w[k:k + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from d where len(w) > 0)),
size as (select doc_id, count(*) as n from sh group by 1),
met as (select a.doc_id as x, b.doc_id as y, count(*) as o from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
link as (select x, y from met join size p on p.doc_id = x join size q on q.doc_id = y where 100 * o >= 80 * (p.n + q.n - o)),
reach as (select doc_id as x, doc_id as y from documents union select reach.x, link.y from reach join link on reach.y = link.x),
least as (select x, min(y) as component_id from reach group by 1)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from d left join size using (doc_id) join least on x = d.doc_id"""

LINE_DEDUP = f"""
with raw as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents),
l as (select *, {words("line")} as w, array_to_string({words("line")}, ' ') as t from raw),
f as (select t, len(any_value(w)) as words, min((doc_id, k)) as place, any_value(w) as w from l where t <> '' group by t),
e as (select 'words' as unit, t, words, place, w as u from f where words >= 5
  union all select 'chars', t, words, place, string_split(t, '') from f where words <= 5 and length(t) between 20 and 1000),
v as (select *, len(u) - 1 as n, array_to_string(u[:i - 1] || u[i + 1:], chr(31)) as v from (select *, unnest(range(1, len(u) + 1)) as i from e)),
met as (select a.unit, a.t, b.t as other from v a join v b on a.unit = b.unit and a.v = b.v and a.n = b.n and a.i = b.i and b.place < a.place
    and (a.unit = 'words' or least(a.words, b.words) < 5)
  union select s.unit, case when s.place < v.place then v.t else s.t end, '' from e s join v on s.unit = v.unit and array_to_string(s.u, chr(31)) = v.v and len(s.u) = v.n
    and (s.unit = 'words' or least(s.words, v.words) < 5)),
near as (select distinct t from met),
fate as (select l.*, case when l.t = '' then 0 when near.t is not null then 2 when (doc_id, k) <> place then 1 else 0 end as gone
  from l left join f on f.t = l.t left join near on near.t = l.t)
select doc_id, count(*) filter (t <> '')::bigint as n_lines, count(*) filter (gone = 1)::bigint as n_exact, count(*) filter (gone = 2)::bigint as n_near,
  length(coalesce(string_agg(line, chr(10) order by k) filter (gone = 0), ''))::bigint as n_chars,
  sha256(coalesce(string_agg(line, chr(10) order by k) filter (gone = 0), '')) as text_sha256 from fate group by doc_id"""

ORACLES = {
    "op1_decontaminate": DECONTAMINATE,
    "op2_mixture": MIXTURE,
    "op4_quality": QUALITY,
    "op5_warc": WARC,
    "op7_ngram_join": NGRAM_JOIN,
    "op10_line_dedup": LINE_DEDUP,
}
