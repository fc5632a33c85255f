"""DuckDB SQL for the contracts that SQL can express."""

from __future__ import annotations

import string

from .mixing import oracle as mixing_sql
from .text import ALNUM_WORD, SPACE_WORD

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_SPACE, _ALNUM = SPACE_WORD, ALNUM_WORD

NEAR_DEDUP = f"""with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '{_SPACE}') as w from documents),
    s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else
        list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) end) as g from w),
    n as (select doc_id, count(*) as n from s group by all),
    c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
    e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
    u as (select a, b from e union all select b, a from e),
    r as (select doc_id as a, doc_id as b from w union select r.a, u.b from r join u on u.a = r.b),
    m as (select a, min(b) as m from r group by all)
    select doc_id, coalesce(n, 0)::bigint as n_shingles, m as component_id, doc_id = m as kept from w left join n using (doc_id) join m on m.a = doc_id"""

SUBSTRING_DEDUP = f"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') as w from documents),
    x as (select doc_id, i, array_to_string(w[i:i + 34], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from w where len(w) >= 35)),
    t as (select g from x group by g having count(*) > 1),
    p as (select distinct doc_id, unnest(range(i, i + 35)) as i from x semi join t using (g)),
    k as (select doc_id, i, word from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from w) anti join p using (doc_id, i)),
    j as (select doc_id, count(*) as n, string_agg(word, ' ' order by i) as kept from k group by doc_id)
    select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
    from w left join j using (doc_id)"""

DECONTAMINATION = f"""with d as (select doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as w from documents),
    b as (select item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as w from benchmark where item_id is not null),
    bw as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as g from
        (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
    dw as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g from
        (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d cross join (select distinct k from bw) where len(w) >= k)),
    h as (select doc_id, i, k, item_id from dw join bw using (k, g)),
    p as (select doc_id, len(list_distinct(flatten(list(range(i, i + k))))) as n_hit, list_sort(list_distinct(list(item_id::varchar))) as items from h group by doc_id)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items,
    sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join p using (doc_id)"""

WARC = """with p as (select page_id, coalesce(html, '') as h from pages),
    k as (select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as payload_digest, max(page_id) over (partition by h) as keeper from p)
    select page_id, payload_bytes, payload_digest,
    case when payload_bytes >= 1000 and page_id != keeper then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= 1000 and page_id != keeper then keeper end as refers_to from k"""

MIXING = mixing_sql()

LEXICAL_SEARCH = f"""with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as w from documents),
    i as (select row_number() over () as i, item_id, list_distinct(regexp_extract_all({_LOWER}, '{_ALNUM}')) as w from (select distinct item_id, text from benchmark)),
    q as (select i, unnest(w) as t from i), p as (select r, t, count(*) as tf from (select r, unnest(w) as t from d) group by all),
    s as (select count(*) as docs, sum(len(w))::bigint as words from d where len(w) > 0),
    f as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, s where t in (select t from q) group by t, docs),
    m as (select r, doc_id, (100 - 50 + (50 * len(w) * docs) // words)::bigint as m from d, s where len(w) > 0),
    x as (select i, r, sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from q join f using (t) join p using (t) join m using (r) group by all),
    o as (select i, doc_id, score, row_number() over (partition by i order by score desc, doc_id nulls first) as rank from x join m using (r) where score > 0)
    select item_id, rank::int as rank, doc_id, score from o join i using (i) where rank <= 50"""

HARD_NEGATIVES = """with e as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label, embedding as x from embeddings
        where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
    v as (select r, vec_id, label, list_transform(x, lambda c: floor(256 * c::double)::bigint) as v from e),
    s as (select a.r, a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.v, b.v, true), lambda c: c[1] * c[2]))::bigint as score
        from v a join v b on a.vec_id % 100 = 0 and a.r != b.r),
    p as (select r, anchor_id, other_id as positive_id, score as positive_score, row_number() over (partition by r order by score desc, other_id) as n from s where same),
    q as (select p.r, p.n, p.anchor_id, positive_id, positive_score, other_id as negative_id, score as negative_score,
        row_number() over (partition by p.r, p.n order by score desc, other_id) as rank
        from p join s on p.r = s.r and not same and 80 * positive_score <= 100 * score and score <= positive_score where p.n <= 5)
    select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from q where rank <= 5"""
