"""DuckDB SQL of the queries, written from their definitions."""

from __future__ import annotations

SECRET_SCANS = r"""
with docs as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),
lists as (
  select 'assign' as kind, 0 as pos, 12 as least, r, string_split_regex(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as gaps,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) as hits,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) as vals from docs
  union all select 'access', 1, 18, r, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) from docs
  union all select 'hex', 2, 16, r, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0) from docs
  union all select 'candidate', 3, 20, r, string_split_regex(t, '[A-Za-z0-9+/_=-]{20,}'), regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}', 0), regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}', 0) from docs),
parts as (
  select kind, pos, least, r, unnest(gaps[1:len(hits)]) as gap, unnest(hits) as hit, unnest(vals) as val, unnest(range(len(hits))) as k
  from lists where len(hits) > 0),
placed as (
  select kind, pos, least, r, val, cast(ends - length(hit) as bigint) as s, cast(ends as bigint) as e
  from (select *, sum(length(gap) + length(hit)) over (partition by kind, r order by k) as ends from parts)),
base as (select * from placed where pos < 3 and length(val) >= least),
-- Allowed parts of a run of candidate characters are blanked out.
blanked as (
  select r, s, array_to_string(list_transform(regexp_extract_all(val, '[A-Za-z0-9+-]+|[/=_]+'), lambda p: case
    when regexp_matches(p, '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$')
      or regexp_matches(p, '(?i)example|sample|placeholder|dummy|changeme|your-|your$')
      or regexp_matches(p, '^[+-]*$') or regexp_matches(p, '^(0123456789|abcdefghij)')
    then repeat(' ', length(p)) else p end), '') as val
  from placed where pos = 3),
windows as (select r, s, unnest(range(length(val) - 19)) as w, val from blanked),
whole as (
  select r, s, w, val[w + 1:w + 20] as x, w - length(regexp_extract(val[1:w], '[^ ]*$')) as piece
  from windows where not contains(val[w + 1:w + 20], ' ') and not regexp_matches(val[w + 1:w + 20], '^[0-9]+$')),
judged as (
  select *, case when regexp_matches(x, '^[0-9a-fA-F]+$') then 3.05
    when regexp_matches(x, '[0-9]') and regexp_matches(x, '[A-Za-z]') then 3.65 else 4.15 end as bits
  from whole),
letters as (select r, s, piece, bits, w, unnest(string_split(x, '')) as c from judged),
counts as (select r, s, piece, bits, w, c, count(*) as n from letters group by all),
noisy as (
  select r, s, piece, w from counts group by r, s, piece, w, bits
  having log2(20) - sum(n * log2(n)) / 20 >= bits - 1e-10),
spans as (
  select r, kind, pos, s, e from base
  union all select r, 'entropy', 3, s + min(w), s + max(w) + 20 from noisy group by r, s, piece),
written as (
  select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, pos) filter (pos < 3) as b,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, pos) as a
  from spans group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(b, '')) as base_sha256, coalesce(a, '') as spans
from docs left join written using (r)
"""

BENCHMARK_DECONTAMINATION = r"""
with doc_words as (
  select doc_id as doc, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w
  from documents where doc_id is not null),
item_words as (
  select distinct item_id as item, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w
  from benchmark where item_id is not null),
doc_at as (select doc, w, unnest(range(len(w) - 4)) as p from doc_words where len(w) >= 5),
item_at as (select item, w, len(w) as n, unnest(range(len(w) - 4)) as p from item_words where len(w) >= 5),
doc_shingles as (select doc, len(w) as dn, p, array_to_string(w[p + 1:p + 5], ' ') as s from doc_at),
item_shingles as (select item, n, p, array_to_string(w[p + 1:p + 5], ' ') as s from item_at),
shared_places as (
  select distinct d.doc, d.dn, i.n, d.p, greatest(0, least(d.p - i.p, d.dn - i.n)) as anchored, greatest(0, least(d.p, d.dn - i.n)) as inwards
  from doc_shingles d join item_shingles i using (s)),
-- Every start place of a window that holds a shingle of an item of its length; the others have similarity 0.
windows as (
  select distinct doc, n, unnest(range(greatest(0, least(p - n + 5, dn - n)), greatest(0, least(p, dn - n)) + 1)) as start
  from shared_places),
first_choice as (
  select doc, n, anchored as start from shared_places union select doc, n, inwards from shared_places),
window_counts as (
  select v.doc, v.n, v.start, d.s, count(*) as c
  from windows v join doc_shingles d on d.doc = v.doc and d.p between v.start and v.start + v.n - 5 group by all),
window_sizes as (select doc, n, start, sum(c) as size from window_counts group by all),
item_counts as (select item, n, s, count(*) as c from item_shingles group by all),
shared as (
  select v.doc, v.n, v.start, i.item, sum(least(v.c, i.c)) as m
  from window_counts v join item_counts i using (n, s) group by all),
scored as (
  select doc, item, start, m / (z.size + (n - 4) - m) as similarity
  from shared join window_sizes z using (doc, n, start)),
best as (
  select s.*, row_number() over (partition by s.doc, s.item order by similarity desc, f.start is null, s.start) as k
  from (select scored.*, i.n from scored join (select distinct item, n from item_counts) i using (item)) s
    left join first_choice f on f.doc = s.doc and f.n = s.n and f.start = s.start
  where similarity >= 0.8)
select doc as doc_id, item as item_id, cast(start as bigint) as start, round(similarity, 6) as similarity from best where k = 1
"""

NGRAM_JACCARD_JOIN = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r\f\v]+'), lambda x: x <> '') as w
  from documents),
places as (select doc_id, w, unnest(range(greatest(len(w) - 4, least(len(w), 1)))) as p from words),
shingles as (select distinct doc_id, array_to_string(w[p + 1:p + 5], ' ') as s from places),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select x.doc_id as a, y.doc_id as b, count(*) as m
  from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by all),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where m / (x.n + y.n - m) >= 0.8),
reach(a, b) as (
  select a, b from links
  union
  select reach.a, links.b from reach join links on reach.b = links.a),
lowest as (select a, min(b) as low from reach group by a),
degree as (select a, count(*) as n from links group by a)
select d.doc_id, least(d.doc_id, coalesce(low, d.doc_id)) as class_id, coalesce(n, 0) as n_links
from documents d left join lowest on lowest.a = d.doc_id left join degree on degree.a = d.doc_id
"""

FILTER_INTERACTION_AUDIT = r"""
with docs as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
firsts as (select t, min(doc_id) as least from docs group by t),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels group by doc_id),
split as (
  select d.*, f.least, list_filter(string_split_regex(d.t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from docs d join firsts f on d.t = f.t),
judged as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (case when len(w) < 50 then 1 else 0 end)
    + (case when 100 * len(list_distinct(w)) < 65 * len(w) then 2 else 0 end)
    + (case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) then 4 else 0 end)
    + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
    + (case when s.doc_id > least then 16 else 0 end) as fails
  from split s left join marks m on s.doc_id = m.doc_id),
cells as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from judged group by part, fails),
letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, bit)),
orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a, letters b, letters c, letters d, letters e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (
  select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::bigint as before
  from orders, (select unnest(range(1, 6)) as step)),
lines as (
  select part, filter_order, step, bit,
    sum(case when fails & (before | bit) = 0 then n else 0 end) as kept,
    sum(case when fails & before = 0 and fails & bit > 0 then n else 0 end) as removed,
    sum(case when fails & before > 0 and fails & bit > 0 then n else 0 end) as redundant,
    sum(case when fails = bit then n else 0 end) as unique_fails,
    sum(case when fails & before = 0 and fails & bit > 0 then good else 0 end) as good_lost,
    sum(case when fails & before = 0 and fails & bit > 0 then toxic else 0 end) as toxic_lost
  from cells, steps group by part, filter_order, step, bit)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from lines
"""

CONVERSATION_TRIE = r"""
with own as (
  select conv_id, role, text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(role) || ':' || role || text)) - 1 as pos
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
sizes as (select conv_id, count(*) as n from own group by conv_id),
heads as (
  select conv_id, n, conv_id - conv_id % 20 as base,
    xor(4294967295, list_reduce(
      list_concat([4294967295], list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ord(c) as bigint))),
      lambda crc, b: list_reduce(
        list_concat([xor(crc, b)], range(8)),
        lambda y, z: case when y % 2 = 1 then xor(y >> 1, 3988292384) else y >> 1 end))) % 4 as h
  from sizes),
convs as (
  select c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) as taken
  from heads c left join sizes b on b.conv_id = c.base),
rebuilt as (
  select c.conv_id, t.pos, t.role, t.text from convs c join own t on t.conv_id = c.base and t.pos < c.taken
  union all
  select c.conv_id, t.pos - c.h + c.taken, t.role, t.text from convs c join own t on t.conv_id = c.conv_id and t.pos >= c.h),
paths as (
  select conv_id, pos + 1 as depth, list({'r': role, 't': text}) over (partition by conv_id order by pos) as prefix,
    len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as words,
    lead(pos) over (partition by conv_id order by pos) is null as ends
  from rebuilt
  union all
  select conv_id, 0, [], 0, conv_id not in (select conv_id from rebuilt) from convs),
nodes as (
  select depth, prefix, min(conv_id) as conv_id, count(*) as n_convs, min(words) as words,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256
  from paths group by depth, prefix),
owners as (select p.conv_id as member, p.depth, n.conv_id as owner from paths p join nodes n on p.depth = n.depth and p.prefix = n.prefix),
linked as (
  select n.*, o.owner as parent_conv_id
  from nodes n left join owners o on o.member = n.conv_id and o.depth = n.depth - 1),
children as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from linked where depth > 0 group by all),
counted as (select l.*, coalesce(c.n_children, 0) as n_children from linked l left join children c using (conv_id, depth)),
sums as (
  select o.owner as conv_id, o.depth, sum(case when c.n_children = 0 then 1 else 0 end) as n_leaves, sum((c.n_convs - 1) * c.words) as saved_tokens
  from counted c join owners o on o.member = c.conv_id and o.depth <= c.depth group by all)
select conv_id, cast(depth as bigint) as depth, parent_conv_id, n_convs, n_children,
  cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, ends_sha256
from counted join sums using (conv_id, depth)
"""
