"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

# SQL has no case folding for ASCII letters only, so the pattern spells both cases.
_ASSIGN = (
    "'("
    + "|".join(
        "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
        for w in ("password", "passwd", "secret", "token", "api_?key")
    )
    + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
)

ORACLES: dict[str, str] = {
    "op8_line_dedup": r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(10)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
shared as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40
  group by key having count(distinct doc_id) >= 5),
marked as (
  select k.doc_id, k.pos, k.line, s.key is not null and k.doc_id <> s.keeper as gone
  from keyed k left join shared s on k.key = s.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""",
    "op10_benchmark_decontamination": r"""
with cut as (
  select doc_id as id, false as asked,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') as w
  from documents
  union all
  select item_id, true,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+')
  from benchmark),
short as (select id, array_to_string(w, ' ') as s from cut where asked and len(w) between 1 and 4),
placed as (
  select id, asked, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from cut where len(w) > 0),
shingles as (select distinct id, asked, array_to_string(w[i:i + 4], ' ') as s from placed),
items as (select id, s, count(*) over (partition by id) as n from shingles where asked and id not in (select id from short)),
found as (
  select d.id as doc_id, q.id as item_id, any_value(n) as n_shingles, count(*) as n_shared
  from shingles d join items q on d.s = q.s
  where not d.asked
  group by d.id, q.id having count(*) >= 0.8 * any_value(n)
  union all
  select d.id, q.id, 1, 1 from cut d join short q on contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || q.s || ' ')
  where not d.asked)
select doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles as containment from found
""",
    "op13_filter_interactions": r"""
with cut as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
firsts as (select text, min(doc_id) as least from cut group by text),
known as (
  select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic
  from labels group by doc_id),
failed as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
          100 * length(regexp_replace(cut.text, '[^A-Z]', '', 'g')) > 2 * length(cut.text),
          regexp_matches(cut.text, '[#$%&*|]'), coalesce(doc_id > least, false)] as fails
  from cut join firsts using (text) left join known using (doc_id)),
letters(k) as (values (1), (2), (3), (4), (5)),
orders as (
  select [a.k, b.k, c.k, d.k, e.k] as o
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
counted as (
  select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
  from failed group by part, fails),
placed as (
  select part, n, good, toxic, list_aggregate(list_transform(o, lambda k: 'ABCDE'[k]), 'string_agg', '') as filter_order,
         step, o[step] as k, fails[o[step]] as hit,
         len(list_filter(o[1:step - 1], lambda k: fails[k])) > 0 as gone,
         len(list_filter(fails, lambda f: f)) as n_fails
  from counted, orders, (select unnest(range(1, 6)) as step)),
summed as (
  select part, filter_order, step, k,
         sum(case when not hit and not gone then n else 0 end) as kept,
         sum(case when hit and not gone then n else 0 end) as removed,
         sum(case when hit and gone then n else 0 end) as redundant,
         sum(case when hit and n_fails = 1 then n else 0 end) as unique_fails,
         sum(case when hit and not gone then good else 0 end) as good_lost,
         sum(case when hit and not gone then toxic else 0 end) as toxic_lost
  from placed group by part, filter_order, step, k),
shares as (select part, k, sum(removed) as shapley from summed group by part, k)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept,
       cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
       cast(toxic_lost as bigint) as toxic_lost, cast(shapley as bigint) as shapley
from summed join shares using (part, k)
""",
    "op1_secret_ownership": r"""
with texts as (
  select row_number() over () as row, doc_id, coalesce(text, '') as text, source as owner,
         concat_ws('/', source, lang) as repository
  from documents),
patterns(kind, name, pattern, grp, least) as (values
  (0, 'assign', @ASSIGN@, 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20),
  (2, 'hex', '[0-9a-f]+', 0, 24)),
cut as (
  select row, 0 as kind,
         regexp_extract_all(text, @ASSIGN@, 0) as whole,
         regexp_extract_all(text, @ASSIGN@, 2) as value,
         string_split_regex(text, @ASSIGN@) as gap
  from texts
  union all
  select row, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0),
         string_split_regex(text, 'AKIA[A-Z0-9]+') from texts
  union all
  select row, 2, regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0),
         string_split_regex(text, '[0-9a-f]+') from texts),
flat as (
  select row, kind, unnest(range(1, len(whole) + 1)) as i, unnest(whole) as whole, unnest(value) as value,
         unnest(gap[1:len(whole)]) as gap
  from cut),
placed as (
  select row, f.kind, value, length(whole) as n,
         sum(length(gap) + length(whole)) over (partition by row, f.kind order by i) as stop, p.name
  from flat f join patterns p on f.kind = p.kind
  qualify length(value) >= p.least),
spans as (
  select row, kind, value, stop - n as start, name || ':' || (stop - n) || ':' || stop as span from placed),
owned as (
  select value, count(distinct owner) as n_owners, count(distinct repository) as n_repositories
  from spans join texts using (row) group by value),
per_doc as (
  select row,
         count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access,
         count(*) filter (where kind = 2) as n_hex,
         string_agg(span, ',' order by start, kind) as spans,
         count(*) filter (where n_owners >= 3) as n_copied, count(*) filter (where n_owners < 3) as n_live,
         max(n_owners) as max_owners, max(n_repositories) as max_repositories,
         string_agg(span, ',' order by start, kind) filter (where n_owners < 3) as live_spans
  from spans join owned using (value) group by row)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans,
       coalesce(n_copied, 0) as n_copied, coalesce(n_live, 0) as n_live, coalesce(max_owners, 0) as max_owners,
       coalesce(max_repositories, 0) as max_repositories, coalesce(live_spans, '') as live_spans
from texts left join per_doc using (row)
""".replace("@ASSIGN@", _ASSIGN),
}
