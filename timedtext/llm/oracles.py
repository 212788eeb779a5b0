"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from timedtext.llm.decontam import COVERED, LEAST_WORDS, NUMBER_WORDS, UNITS, WINDOW
from timedtext.llm.tokenjoin import WORDS

_SPLIT = r"'[ \t\n\x0b\x0c\r]+'"

#: Brute force: every pair of documents that share a shingle is counted and compared.
NGRAM_JOIN = rf"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_SPLIT}), lambda x: x <> '') as w from documents),
 g as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < {WORDS} then [array_to_string(w, ' ')]
   else list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) end) as g from w),
 n as (select doc_id, len(g)::bigint as n from g), s as (select doc_id, unnest(g) as g from g),
 p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b using (g) where a.doc_id < b.doc_id group by all),
 l as (select x, y from p join n i on i.doc_id = x join n j on j.doc_id = y where 100 * k >= 75 * (i.n + j.n - k)),
 e as (select x, y from l union select y, x from l),
 r as (select doc_id as x, doc_id as y from n union select r.x, e.y from r join e on e.x = r.y)
 select doc_id, n as n_shingles, min(y) as component_id from n join r on r.x = doc_id group by doc_id, n"""


def _plain(text: str) -> str:
    joined = f"coalesce({text}, '')"
    for _ in range(2):
        joined = rf"regexp_replace({joined}, '([0-9])[.,:/]([0-9])', '\1\2', 'g')"
    for a, b in (("[0-9]", r"\p{L}"), (r"\p{L}", "[0-9]")):
        joined = rf"regexp_replace({joined}, '({a})({b})', '\1 \2', 'g')"
    return rf"list_filter(string_split(trim(regexp_replace({joined}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"


_TEMPLATE = rf"list_transform(w, lambda x: case when regexp_full_match(x, '\p{{Lu}}\p{{Ll}}*') then '@' when regexp_full_match(lower(x), '\p{{N}}+|{NUMBER_WORDS}') then '#' when regexp_full_match(lower(x), '{UNITS}') then '&' else lower(x) end)"
_SLOTS = "list_filter(range(1, k + 1), lambda i: t[i] in ('@', '#', '&'))"

DECONTAMINATION = rf"""with recursive d as (select row_number() over () as rid, doc_id, {_plain('text')} as w from documents), dc as (select *, {_TEMPLATE} as c from d),
 b as (select item_id, {_plain('text')} as w from benchmark), bc as (select *, {_TEMPLATE} as c, len(w) as item_words from b where len(w) >= {LEAST_WORDS}),
 bw as (select item_id, item_words, least({WINDOW}, item_words) as k, unnest(range(0, item_words - least({WINDOW}, item_words) + 1)) as pos, w, c from bc),
 bi as (select item_id, item_words, k, pos as item_at, w[pos + 1:pos + k] as item_v, c[pos + 1:pos + k] as t from bw),
 bl as (select * from bi where 2 * len(list_filter(t, lambda x: x not in ('@', '#', '&'))) >= k),
 ks as (select distinct k from bl), dw as (select rid, doc_id, k, unnest(range(0, len(w) - k + 1)) as pos, w, c from dc, ks where len(w) >= k),
 di as (select rid, doc_id, k, pos, w[pos + 1:pos + k] as v, c[pos + 1:pos + k] as t from dw),
 m as (select rid, doc_id, item_id, item_words, k, pos, item_at, pos - item_at as start, v, item_v, t from di join bl using (k, t)),
 cover as (select rid, doc_id, item_id, item_words, start, count(distinct x) as covered from (select *, unnest(range(item_at, item_at + k)) as x from m) group by all),
 word as (select rid, item_id, start, bool_and(lower(array_to_string(item_v, ' ')) = lower(array_to_string(v, ' '))) as verbatim from m group by all),
 slot as (select rid, item_id, start, count(distinct (i, d)) as slots, count(distinct i) as ni, count(distinct d) as nd from (select rid, item_id, start, lower(item_v[x]) as i, lower(v[x]) as d from (select *, unnest({_SLOTS}) as x from m)) group by all),
 ok as (select rid, doc_id, item_id, item_words, start, covered, verbatim, coalesce(slots, 0) as slots from cover join word using (rid, item_id, start) left join slot using (rid, item_id, start)
  where covered >= {COVERED} * item_words and coalesce(slots, 0) = coalesce(ni, 0) and coalesce(slots, 0) = coalesce(nd, 0)),
 best as (select *, row_number() over (partition by rid, item_id order by covered desc, start, verbatim desc, slots desc) as rn from ok)
 select doc_id, item_id, start::int as start, covered::int as covered, item_words::int as item_words, slots::int as slots, verbatim from best where rn = 1"""

SQL = {"op2_decontamination": DECONTAMINATION, "op4_ngram_join": NGRAM_JOIN}
