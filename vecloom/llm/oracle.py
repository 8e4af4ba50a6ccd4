"""DuckDB's SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

UPPER, LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""
with l as (
  select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents)
), k as (select *, translate(trim(line, {SPACES}), {UPPER}, {LOW}) as key from l),
f as (select key, min(doc_id) as first from k where length(key) >= 10 group by key),
m as (select doc_id, i, line, coalesce(f.first < k.doc_id, false) as gone from k left join f on f.key = k.key and length(k.key) >= 10)
select doc_id, count(*)::bigint as n_lines, count_if(gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""

WORDS = "regexp_extract_all(translate(coalesce(text, ''), {}, {}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(UPPER, LOW)

BENCHMARK = f"""
with b as (select item_id::varchar as item, {WORDS} as w from benchmark),
win as (
  select distinct item, least(13, len(w)) as m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as s
  from b, lateral (select unnest(range(1, len(w) - least(13, len(w)) + 2)) as i) where len(w) > 0
),
d as (select doc_id, {WORDS} as w from documents),
ms as (select distinct m from win),
spots as (
  select doc_id, m, unnest(range(1, greatest(1, len(w) - m + 2))) as i, unnest(list_transform(range(1, greatest(1, len(w) - m + 2)), lambda i: array_to_string(w[i : i + m - 1], ' '))) as s
  from d, ms
),
hit as (select doc_id, i, spots.m, item from spots join win on win.s = spots.s and win.m = spots.m),
n as (select doc_id, count(distinct p)::bigint as n_hit from (select doc_id, unnest(range(i, i + m)) as p from (select distinct doc_id, i, m from hit)) group by doc_id),
items as (select doc_id, count(*)::bigint as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join n using (doc_id) left join items using (doc_id)
"""

#: Bytes as hex digits, so a byte is two characters.
REPEATS = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
n as (select doc_id, h, range(0, greatest(0, length(h) // 2 - 49)) as ps from d),
w as (select doc_id, unnest(ps) as p, unnest(list_transform(ps, lambda p: md5(substring(h, 2 * p + 1, 100)))) as s from n),
r as (select s, min(doc_id) as first from w group by s having count(distinct doc_id) > 1),
c as (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from w join r using (s) where doc_id > first),
g as (select doc_id, p, sum(case when before is null or p > before + 50 then 1 else 0 end) over (partition by doc_id order by p) as run from c),
t as (select doc_id, run, min(p) as a, max(p) + 50 as z from g group by doc_id, run),
x as (select doc_id, run, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as begin, lead(a) over (partition by doc_id order by a) is null as last from t),
kept as (
  select doc_id, string_agg(substring(h, 2 * begin + 1, 2 * (a - begin)) || case when last then substring(h, 2 * z + 1) else '' end, '' order by a) as k,
    sum(z - a)::bigint as n_removed, count(*)::bigint as n_spans
  from x join d using (doc_id) group by doc_id
)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from d left join kept using (doc_id)
"""

ORACLE_SQL = {"op1_suffix_dedup": REPEATS, "op5_line_dedup": LINES, "op10_decontaminate": BENCHMARK}
