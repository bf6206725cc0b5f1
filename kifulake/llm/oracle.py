r"""DuckDB SQL with the rows of those corpus queries that SQL can express.

op1: DuckDB's ``levenshtein`` counts bytes, so characters outside ASCII are first mapped to
control characters, of which there are 26 to spare. op3: the exact similarities that BagMinHash
searches for. op6: links as tables hold them; of their targets, character references and dot
segments are left as they stand.
"""

OP1 = r"""
with parts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as p from documents),
lines as (select * from (select doc_id, unnest(range(len(p))) as n, unnest(p) as line from parts) where regexp_matches(line, '[^\x20\x09-\x0D]')),
firsts as (select line, min(struct_pack(d := doc_id, n := n)) as f from lines group by line),
odd as (select string_agg(c, '' order by c) as chars from (select distinct unnest(regexp_extract_all(line, '[^\x00-\x7F]')) as c from lines)),
narrow as (select f, length(line) as size, translate(line, chars, array_to_string(list_transform(list_filter(range(1, 32), lambda i: i not between 9 and 13), lambda i: chr(i::int)), '')) as line from firsts, odd where length(line) >= 16),
links as (select a.f as a, b.f as b from narrow a join narrow b on b.size between a.size and a.size + least(2, a.size // 16) and a.f <> b.f and (a.size < b.size or a.f < b.f)
  where levenshtein(a.line, b.line) <= least(2, a.size // 16)),
ends as (select a as f, b as o from links union all select b, a from links),
linked as (select f, count(*) as links, bool_or(o < f) as near, string_agg(o.d || ':' || o.n, ' ' order by o) as others from ends group by f),
judged as (select l.doc_id, l.n, f.f, (f.f.d <> l.doc_id or f.f.n <> l.n) as copy, coalesce(k.links, 0) as links, coalesce(k.near, false) as near, k.others
  from lines l join firsts f using (line) left join linked k on k.f = f.f),
told as (select doc_id, count(*) as n_lines, count(*) filter (copy) as n_copies, count(*) filter (near and not copy) as n_near, sum(links)::bigint as n_links,
  string_agg(n, ',' order by n) filter (copy or near) as removed,
  string_agg(n || '=' || f.d || ':' || f.n || case when not copy and others is not null then '~' || others else '' end, ';' order by n) filter (copy or links > 0) as members
  from judged group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_copies, 0) as n_copies, coalesce(n_near, 0) as n_near, coalesce(n_links, 0) as n_links, coalesce(removed, '') as removed, coalesce(members, '') as members
from documents d left join told using (doc_id)
"""

OP3 = r"""
with texts as (select t, min(doc_id) as id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from (select doc_id, coalesce(text, '') as t from documents) group by t),
shingles as (select id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from texts),
bags as (select id, s, count(*) as c from shingles group by id, s),
sizes as (select id, sum(c) as size from bags group by id),
shared as (select a.id as a, b.id as b, sum(least(a.c, b.c)) as n from bags a join bags b on a.s = b.s and a.id < b.id group by a.id, b.id),
links as (select a, b from shared join sizes x on x.id = a join sizes y on y.id = b where n >= 0.8 * (x.size + y.size - n)),
ends as (select a, b from links union all select b, a from links),
reach as (with recursive r(a, b) as (select id, id from texts union select r.a, e.b from r join ends e on r.b = e.a) select a, min(b) as root from r group by a),
members as (select d.doc_id, root from documents d join texts on t = coalesce(text, '') join reach on a = id),
classes as (select root, min(doc_id) as class_id, count(*) as class_size from members group by root)
select doc_id, class_id, class_size, doc_id = class_id as keep from members join classes using (root)
"""

OP5 = r"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, t, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) as v(t, r)),
formatted as (select *, row_number() over w as pos, 4 + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</', '<\/'), ':', '\:')) + 2 as head,
  length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/')) + 8 as tail from rows window w as (partition by conv_id order by turn nulls first, role, text)),
placed as (select *, coalesce(sum(head + tail) over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding), 0) as before from formatted)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
  sum(head + tail)::bigint as formatted_chars, count(*) filter (role = 'assistant') as n_examples, coalesce(sum(before + head) filter (role = 'assistant'), 0)::bigint as context_chars
from placed group by conv_id
"""

OP6 = r"""
with rules(verdict, host, path) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut as (select page_id, url, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1), '') as query from pages),
tags as (select url, host, path, query, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\brel\s*=\s*["'']?canonical\b')), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda x: regexp_extract(x, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1)))) as target
  from cut where url like '%://%'),
named as (select host || path || query as a, case when regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') then target when target like '//%' then 'x:' || target when target like '/%' then 'x://' || host || target
    else 'x://' || host || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || target end as u from tags where target <> ''),
links as (select a, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) || regexp_extract(u, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1) as b from named),
vertices as (select distinct v, regexp_extract(v, '(?s)^([^/?]*)', 1) as host, regexp_extract(v, '(?s)^[^/?]*([^?]*)', 1) as path, regexp_extract(v, '(?s)^[^?]*\?(.*)$', 1) as query
  from (select host || path || query as v from cut where url like '%://%' union all select a from links union all select b from links)),
plain as (select v as a, case when regexp_matches(host, '^(www|m)\..*\.') then regexp_replace(host, '^(www|m)\.', '') else host end || regexp_replace(path, '/+$', '')
    || case when query = '' then '' else regexp_replace('?' || array_to_string(list_filter(string_split(query, '&'), lambda x: not regexp_full_match(x, '(?:utm_\w+|ref|fbclid|gclid)(=.*)?')), '&'), '[?&]$', '') end as b from vertices),
edges as (select a, b from links union select a, b from plain),
ends as (select a, b from edges where a <> b union select b, a from edges where a <> b),
reach as (with recursive r(a, b) as (select a, a from ends union select r.a, e.b from r join ends e on r.b = e.a) select * from r),
said as (select a as v, (select verdict from rules u where (h = u.host or ends_with(h, '.' || u.host)) and starts_with(p, u.path) order by length(u.host || u.path) desc, verdict limit 1) as verdict
  from (select distinct a, regexp_extract(a, '(?s)^([^/?]*)', 1) as h, regexp_extract(a, '(?s)^[^/?]*([^?]*)', 1) as p from ends)),
inherited as (select r.a as v, case when bool_or(verdict = 'allow') then 'allow' when bool_or(verdict = 'block') then 'block' end as verdict from reach r join said s on s.v = r.b group by r.a),
judged as (select page_id, c.host, c.path, host || path || query as v, (select struct_pack(r := u.host || u.path, s := u.verdict) from rules u where (c.host = u.host or ends_with(c.host, '.' || u.host)) and starts_with(c.path, u.path)
  order by length(u.host || u.path) desc, u.verdict limit 1) as own from cut c)
select page_id, host, path, own.r as rule, coalesce(own.s, i.verdict, 'allow') as verdict from judged j left join inherited i on i.v = j.v
"""

OP11 = r"""
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
words as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as first from texts),
said as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
failing as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
  {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} as f
  from words left join said using (doc_id)),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
fails as (select part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: case x when 'A' then f.A when 'B' then f.B when 'C' then f.C when 'D' then f.D else f.E end) as failed from failing),
bins as (select part, failed, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from fails group by part, failed),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select filter_order, s::int as step, filter_order[s] as x, string_split(left(filter_order, s - 1), '') as before from orders, unnest(range(1, 6)) as u(s)),
told as (select part, filter_order, step, x,
  coalesce(sum(n) filter (not list_contains(failed, x) and not list_has_any(failed, before)), 0)::bigint as kept,
  coalesce(sum(n) filter (list_contains(failed, x) and not list_has_any(failed, before)), 0)::bigint as removed,
  coalesce(sum(n) filter (list_contains(failed, x) and list_has_any(failed, before)), 0)::bigint as redundant,
  coalesce(sum(n) filter (failed = [x]), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (list_contains(failed, x) and not list_has_any(failed, before)), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (list_contains(failed, x) and not list_has_any(failed, before)), 0)::bigint as toxic_lost
  from bins, steps group by part, filter_order, step, x)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, x))::bigint as shapley from told
"""

OP12 = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
split as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from split group by lang),
sizes as (select unnest(range(1, 6)) as k),
phrases as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from split, sizes, lateral (select unnest(range(1, len(w) - k + 2)) as i)),
found as (select lang, k, phrase, count(*) as a from phrases group by lang, k, phrase having count(*) >= 100),
kept as (select * from found c where k >= 2 and not exists (select 1 from found o where o.lang = c.lang and o.k > c.k and 100 * o.a >= 100 * c.a and contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts as (select c.*, i, array_to_string(string_split(phrase, ' ')[: i], ' ') as p, array_to_string(string_split(phrase, ' ')[i + 1 :], ' ') as q from kept c, lateral (select unnest(range(1, c.k)) as i)),
scored as (select c.lang, c.phrase, c.a, x.a as l, y.a as r, n, i, (1000::hugeint * c.a * n) // (x.a::hugeint * y.a) as score
  from cuts c join found x on x.lang = c.lang and x.phrase = p join found y on y.lang = c.lang and y.phrase = q join totals t on t.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, i) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score from best qualify rank <= 2000
"""

ORACLE = {"op1_line_dedup": OP1, "op3_bagminhash": OP3, "op5_chat_format": OP5, "op6_url_filter": OP6, "op11_filter_audit": OP11, "op12_collocations": OP12}
