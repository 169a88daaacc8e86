"""SQL that must give the same rows as the registered queries, written from their contracts."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_SQL = f"""
with recursive texts as (select doc_id, {_WORDS.format(text=_LOWER)} as w from documents where doc_id is not null),
sets as (
    select doc_id, case
        when len(w) = 0 then cast([] as varchar[])
        when len(w) < 5 then [array_to_string(w, ' ')]
        else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))
    end as shingles
    from texts
),
rows_ as (select doc_id, len(shingles) as n, unnest(shingles) as shingle from sets),
linked as (
    select a.doc_id as one, b.doc_id as two
    from rows_ a join rows_ b on a.shingle = b.shingle and a.doc_id < b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n
    having 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
both_ways as (select one, two from linked union all select two, one from linked),
reached as (
    select one as doc_id, two as other from both_ways
    union
    select r.doc_id, b.two from reached r join both_ways b on b.one = r.other
),
least as (select doc_id, min(other) as other from reached group by doc_id),
classes as (select shingles, min(doc_id) as class_id from sets where len(shingles) > 0 group by shingles)
select s.doc_id, cast(len(s.shingles) as bigint) as n_shingles,
       least(s.doc_id, coalesce(l.other, s.doc_id)) as component_id, coalesce(c.class_id, s.doc_id) as class_id
from sets s left join least l using (doc_id) left join classes c on c.shingles = s.shingles
"""

COPIED_BYTES_SQL = """
with texts as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents where doc_id is not null),
starts as (select doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 99))) as place from texts),
windows as (select doc_id, place, substr(h, 2 * place + 1, 200) as bytes from starts),
copies as (
    select doc_id, place from windows
    qualify row_number() over (partition by bytes order by doc_id, place) > 1
),
marked as (select *, case when place > lag(place) over (partition by doc_id order by place) + 100 then 1 else 0 end as fresh from copies),
numbered as (select *, sum(fresh) over (partition by doc_id order by place rows unbounded preceding) as span from marked),
spans as (select doc_id, span, min(place) as first, max(place) + 100 as past from numbered group by doc_id, span),
gaps as (
    select doc_id, first, past, coalesce(lag(past) over (partition by doc_id order by first), 0) as kept_from from spans
),
kept as (
    select t.doc_id, any_value(t.h) as h, count(g.first) as n_spans, coalesce(sum(g.past - g.first), 0) as n_removed,
           coalesce(string_agg(substr(t.h, 2 * g.kept_from + 1, 2 * (g.first - g.kept_from)), '' order by g.first), '') as front,
           coalesce(max(g.past), 0) as last
    from texts t left join gaps g using (doc_id) group by t.doc_id
)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(n_removed as bigint) as n_removed, cast(n_spans as bigint) as n_spans,
       sha256(unhex(front || substr(h, 2 * last + 1))) as kept_sha256
from kept
"""

REPEATED_WORDS_SQL = f"""
with texts as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as w from documents where doc_id is not null),
windows as (
    select doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 11)), lambda i: array_to_string(w[i:i + 12], ' '))) as window_,
           unnest(range(1, greatest(1, len(w) - 11))) as place
    from texts
),
least as (select window_, min(doc_id) as first_doc from windows group by window_),
removed as (
    select distinct doc_id, unnest(range(w.place, w.place + 13)) as place
    from windows w join least using (window_) where first_doc < doc_id
),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as place from texts),
kept as (
    select doc_id, string_agg(word, ' ' order by place) as rest, count(*) as n
    from words anti join removed using (doc_id, place) group by doc_id
)
select t.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(rest, '')) as kept_sha256
from texts t left join kept using (doc_id)
"""

ARCHIVES_SQL = """
with payloads as (
    select page_id, coalesce(html, '') as payload, max(page_id) over (partition by coalesce(html, '')) as kept_id
    from pages where page_id is not null
),
digests as (select *, sha1(payload) as h from payloads)
select page_id, cast(strlen(payload) as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((cast('0x' || substr(h, 5 * (i // 4) + 1, 5) as integer) >> cast(15 - 5 * (i % 4) as integer)) & 31), 1)), '') as payload_digest,
       case when kept_id = page_id then 'response' else 'revisit' end as record_type,
       case when kept_id <> page_id then kept_id end as refers_to
from digests
"""
