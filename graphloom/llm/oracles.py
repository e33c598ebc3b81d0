"""SQL for the operators that SQL can express on whole tables; the rest is tested against brute force."""

from __future__ import annotations

from graphloom.llm.hard_negatives import OP11_SQL
from graphloom.llm.nearest import OP4_SQL
from graphloom.llm.quality import OP13_SQL

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP2_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED = r"'[^\x20\x09-\x0D]+'"

OP2_SQL = f"""
with d as (select row_number() over () as r, doc_id, {OP2_WORDS} as w from documents),
b as (select distinct item_id, {OP2_WORDS} as w from benchmark),
bw as (select item_id, least(13, len(w)) as n, unnest(list_transform(generate_series(1, len(w) - least(13, len(w)) + 1), lambda i: array_to_string(w[i : i + least(13, len(w)) - 1], ' '))) as win from b where len(w) > 0),
spot as (select r, n, w, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from bw) where len(w) >= n),
hits as (select r, i, spot.n, item_id from spot join bw on spot.n = bw.n and array_to_string(w[i : i + spot.n - 1], ' ') = win),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(generate_series(i, i + n - 1)) as p from hits) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item_id::varchar as item from hits where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (r) left join named using (r)
"""

OP7_SQL = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) as w from documents),
win as (select r, i, md5(array_to_string(w[i : i + 34], ' ')) as s from (select r, w, unnest(generate_series(1, len(w) - 34)) as i from d where len(w) >= 35)),
gone as (select distinct r, unnest(generate_series(i, i + 34)) as p from win where s in (select s from win group by s having count(*) > 1)),
lost as (select r, count(*) as n from gone group by r),
kept as (select r, string_agg(word, ' ' order by p) as kept from (select r, unnest(w) as word, unnest(generate_series(1, len(w))) as p from d) anti join gone using (r, p) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(lost.n, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join lost using (r) left join kept using (r)
"""

OP8_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), {SPACED}) as w from documents),
sh as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [len(w) || ' ' || array_to_string(w, ' ')]
  else list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i : i + 3], ' ')) end) as s from d),
n as (select doc_id, count(*) as n from sh group by doc_id),
links as (select x.doc_id as a, y.doc_id as b from sh x join sh y on x.s = y.s and x.doc_id <> y.doc_id join n p on p.doc_id = x.doc_id join n q on q.doc_id = y.doc_id
  group by all having 100 * count(*) >= 85 * (max(p.n) + max(q.n) - count(*))),
reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) as component_id
from d left join n on n.doc_id = d.doc_id left join (select a, min(b) as b from reach group by a) m on m.a = d.doc_id
"""

SQL = {"op2_decontamination": OP2_SQL, "op4_nearest": OP4_SQL, "op7_substring_dedup": OP7_SQL, "op8_jaccard_join": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op13_quality_rules": OP13_SQL}
