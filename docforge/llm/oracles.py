"""DuckDB SQL with the same rows as the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = rf"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as shingles from w),
x as (select doc_id, unnest(shingles) as sh from s), n as (select doc_id, len(shingles) as n from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as both_n from x a join x b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * both_n >= 75 * (na.n + nb.n - both_n)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a)
select doc_id, n as n_shingles, (select min(b) from r where a = doc_id) as component_id from n
"""

OP4 = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
g as (select doc_id, s, array_to_string(ws[s:s + 19], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as s from w)),
d as (select doc_id, s from g qualify row_number() over (partition by k order by doc_id, s) > 1),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as p from d),
a as (select doc_id, p, ws[p] as word from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as p from w)),
k as (select a.doc_id, string_agg(word, ' ' order by a.p) as kept, count(*) as n_kept from a left join gone on gone.doc_id = a.doc_id and gone.p = a.p where gone.p is null group by 1)
select w.doc_id, len(ws) as n_words, len(ws) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (doc_id)
"""

OP7 = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
g as (select doc_id, s, md5_number(h[2 * s - 1:2 * s + 98]) as k from (select doc_id, h, unnest(range(1, length(h) // 2 - 48)) as s from h)),
d as (select doc_id, s from g qualify min(doc_id) over (partition by k) < doc_id),
gone as (select distinct doc_id, unnest(range(s, s + 50)) as p from d),
runs as (select doc_id, count(*) as n_removed, count_if(before is null or before < p - 1) as n_spans from (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from gone) group by 1),
a as (select doc_id, p, h[2 * p - 1:2 * p] as byte from (select doc_id, h, unnest(range(1, length(h) // 2 + 1)) as p from h)),
k as (select a.doc_id, string_agg(byte, '' order by a.p) as kept from a left join gone on gone.doc_id = a.doc_id and gone.p = a.p where gone.p is null group by 1)
select h.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from h left join runs using (doc_id) left join k using (doc_id)
"""

OP10 = rf"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bn as (select item_id, ws, least(10, len(ws)) as n from bw where len(ws) > 0),
bk as (select distinct item_id, n, array_to_string(ws[s:s + n - 1], ' ') as k from (select item_id, n, ws, unnest(range(1, len(ws) - n + 2)) as s from bn)),
sizes as (select distinct n from bk),
dk as (select doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') as k from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as s from dw, sizes)),
m as (select doc_id, item_id, s, dk.n from dk join bk on bk.n = dk.n and bk.k = dk.k),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from m) group by 1),
items as (select doc_id, count(item_id) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from (select distinct doc_id, item_id from m) group by 1)
select dw.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hit using (doc_id) left join items using (doc_id)
"""

OP13 = """
with recursive t as (select vendor_id, date_diff('day', date '1970-01-01', cast(shipped_at as date))::bigint as d, sum(quantity)::bigint as q from sale_lines where quantity is not null and shipped_at is not null group by 1, 2),
b as (select vendor_id, min(d) as lo, max(d) as hi from t group by 1),
f as (select x.vendor_id, x.d, coalesce(t.q, 0)::hugeint as q from (select vendor_id, unnest(range(lo, hi + 1)) as d from b) x left join t on t.vendor_id is not distinct from x.vendor_id and t.d = x.d),
p as (select vendor_id, d, sum(q) over (partition by vendor_id order by d) as s, sum(q * q) over (partition by vendor_id order by d) as s2 from f),
v as (select vendor_id, min(d) as first_day, count(*) as n, list_prepend(0::hugeint, list(s::hugeint order by d)) as s, list_prepend(0::hugeint, list(s2::hugeint order by d)) as s2 from p group by 1),
r as (select vendor_id, first_day, n, s, s2, 0::bigint as m, [{'c': 0::bigint, 'k': 0::bigint, 'a': 0::bigint}] as st from v
union all select vendor_id, first_day, n, s, s2, m + 1, list_append(st, list_min(list_filter(list_transform(range(0, m + 1), lambda a: case when st[a + 1].c is not null and m + 1 - a >= least(14, n) then
{'c': st[a + 1].c + case when a > 0 then 40000 else 0 end + (m + 1 - a) * floor(1000 * ln((1 + ((m + 1 - a) * (s2[m + 2] - s2[a + 1]) - (s[m + 2] - s[a + 1]) * (s[m + 2] - s[a + 1])) // ((m + 1 - a) * (m + 1 - a)))::double))::bigint, 'k': st[a + 1].k + 1, 'a': a} end), lambda x: x is not null))) from r where m < n),
w as (select vendor_id, first_day, s, s2, st, st[n + 1].k as parts, st[n + 1].c as best, n as b, st[n + 1].a as a from r where m = n
union all select vendor_id, first_day, s, s2, st, parts, best, a, st[a + 1].a from w where a > 0),
g as (select vendor_id, st[b + 1].k::int as segment_no, first_day + a as first_day, b - a as n_days, (s[b + 1] - s[a + 1])::bigint as total, (1 + ((b - a) * (s2[b + 1] - s2[a + 1]) - (s[b + 1] - s[a + 1]) * (s[b + 1] - s[a + 1])) // ((b - a) * (b - a)))::bigint as spread, parts as n_segments, best as best_cost from w)
select vendor_id, segment_no, first_day, n_days, total, spread, n_days * floor(1000 * ln(spread::double))::bigint as cost, n_segments, best_cost from g
"""

OP12 = rf"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) as tail from u),
s as (select *, case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/' when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/' when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from h)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
when regexp_matches(host || tail, '/(login|signin|signup|register|cart|checkout|search|feed|rss|wp-admin)([/.?#]|$)|[?&]utm_source=feed([&#]|$)|[?&](replytocom|sessionid|phpsessid|jsessionid)=|\.(jpg|jpeg|png|gif|css|js|zip|exe|mp3|mp4)([?#]|$)') then 'block' else 'allow' end as verdict from s
"""

OP11 = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
b as (select row_number() over () as q, item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from benchmark),
c as (select count_if(len(ws) > 0) as n, sum(len(ws))::bigint as l from d),
t as (select r, term, count(*) as tf from (select r, unnest(ws) as term from d) group by 1, 2),
f as (select term, count(*) as df from t group by 1),
w as (select term, floor(1000 * ln((2.0::double * n + 2) / (2 * df + 1)))::bigint as w from f, c),
m as (select r, doc_id, 25 + (75 * len(ws) * n) // l as m from d, c where len(ws) > 0),
q as (select q, term, count(*) as times from (select q, unnest(ws) as term from b) group by 1, 2),
s as (select q, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from q join w using (term) join t using (term) join m using (r) group by 1, 2),
k as (select q, doc_id, score, row_number() over (partition by q order by score desc, doc_id) as rank from s join m using (r) where score > 0)
select item_id, rank::int as rank, doc_id, score from k join b using (q) where rank <= 10
"""
