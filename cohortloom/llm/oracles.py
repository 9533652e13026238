"""The queries that SQL can express, as DuckDB SQL in a form of their own."""

from __future__ import annotations

CHAT = r"""
with t0 as (
    select conv_id, turn, coalesce(role, '') as role, coalesce("text", '') as txt from conversations
    union all
    select -7, n, case n when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from (values (0), (1)) v(n)
),
t1 as (
    select *, (strlen(txt) + 3) // 4 + 4 as tok,
        row_number() over w as pos
    from t0 window w as (partition by conv_id order by turn nulls first, role, txt)
),
t2 as (
    select *, sum(tok) over (partition by conv_id order by pos) as fin,
        length(txt) + 2 * (length(txt) - length(replace(replace(replace(replace(txt, '%', ''), '<', ''), '[', ''), '|', ''))) as body,
        length(role) + 8 as marks,
        max(case when pos = 1 and role = 'system' then tok end) over (partition by conv_id) as stok,
        max(case when pos = 1 and role = 'system' then length(txt) + 2 * (length(txt) - length(replace(replace(replace(replace(txt, '%', ''), '<', ''), '[', ''), '|', ''))) end) over (partition by conv_id) as sbody
    from t1
),
t3 as (select *, greatest(1, floor((1024 - 256 - coalesce(stok, 0)) / 2)) as stride from t2),
t4 as (select *, floor((fin - 1) / stride) as cell, tok <= stride as rest from t3),
spans as (
    select conv_id, cell, rest, min(fin - tok) as beg, min(pos) as first_pos, max(sbody) as sbody from t4 group by all
),
repeated as (
    select s.conv_id, sum(t.body + t.marks + 6) as chars
    from spans s join t4 t on s.conv_id is not distinct from t.conv_id and t.pos < s.first_pos
        and t.fin - t.tok >= s.beg - 256 and not (t.pos = 1 and t.stok is not null)
    group by 1
),
systems as (
    select conv_id, sum(sbody + length('system') + 8 + 6) as chars from spans where first_pos > 1 and sbody is not null group by 1
)
select t.conv_id, count(*) as n_turns,
    sha256(string_agg(t.role || chr(10) || t.txt || chr(10), '' order by t.pos)) as turns_sha256,
    coalesce(sum(length(t.txt)) filter (where t.role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(t.txt, '' order by t.pos) filter (where t.role = 'assistant'), '')) as loss_sha256,
    (sum(t.body + t.marks) + coalesce(any_value(r.chars), 0) + coalesce(any_value(y.chars), 0))::bigint as formatted_chars
from t4 t
left join repeated r on r.conv_id is not distinct from t.conv_id
left join systems y on y.conv_id is not distinct from t.conv_id
group by t.conv_id
"""

LEAKS = r"""
with item as (
    select distinct item_id, list_filter(string_split_regex(lower(coalesce("text", '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from benchmark
),
doc as (
    select distinct doc_id, list_filter(string_split_regex(lower(coalesce("text", '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents
),
item_gram as (
    select item_id, len(w) as m, i as k, list_aggregate(w[i + 1 : i + least(5, len(w))], 'string_agg', ' ') as g
    from item, range(0, greatest(len(w) - 4, least(len(w), 1))) r(i)
),
doc_gram as (
    select doc_id, w, i as k, list_aggregate(w[i + 1 : i + 5], 'string_agg', ' ') as g from doc, range(0, len(w) - 4) r(i)
),
place as (
    select distinct d.doc_id, d.w, i.m, greatest(d.k - i.k, 0) as beg
    from doc_gram d join (select distinct m, k, g from item_gram) i using (g)
),
seen as (
    select doc_id, m, beg, list_aggregate(w[beg + i + 1 : beg + i + 5], 'string_agg', ' ') as g, count(*) as n
    from (select doc_id, m, beg, w, unnest(range(0, greatest(least(len(w) - beg, m) - 4, 0))) as i from place) group by all
),
total as (select doc_id, m, beg, sum(n) as n from seen group by all),
bag as (select item_id, m, g, count(*) as n from item_gram group by all),
bag_total as (select item_id, m, sum(n) as n from bag group by all),
common as (
    select s.doc_id, b.item_id, s.m, s.beg, sum(least(s.n, b.n)) as c from seen s join bag b using (m, g) group by all
),
scored as (
    select c.doc_id, c.item_id, c.m, c.beg, c.c::double / (t.n + b.n - c.c)::double as similarity
    from common c join total t on t.doc_id = c.doc_id and t.m = c.m and t.beg = c.beg
    join bag_total b on b.item_id = c.item_id
)
select doc_id, item_id, beg::bigint as start_word, m::bigint as n_words, similarity
from scored where similarity >= 0.8
qualify row_number() over (partition by doc_id, item_id order by similarity desc, beg) = 1
"""

ORACLES: dict[str, str] = {
    "op6_budgeted_chat_windows": CHAT,
    "op10_simhash_decontamination": LEAKS,
}
