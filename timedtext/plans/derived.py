"""Queries of scalar and small-table operators over tables of inputs derived from ``events``.

Each input is written once as SQL that Spark and DuckDB both read, over ``i``, the event's id, so an oracle sees the same
inputs and works out the answers by its own way: mostly from the numbers an input was made of.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.functions import addresses, names, similarity, text
from timedtext.operators import tables, timeline
from timedtext.plans.registry import query
from timedtext.sources import export, payloads


def given(spark: SparkSession, d: str, **columns: str) -> DataFrame:
    """``i`` of every event, and columns made from it."""
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("i"), "props").select("i", *(F.expr(e).alias(c) for c, e in columns.items()))


def duck(**columns: str) -> str:
    return "(select event_id as i" + "".join(f", {e} as {c}" for c, e in columns.items()) + " from events) g"


def _by(k: int, *cases: str) -> str:
    """The case by ``i`` modulo k."""
    return f"case i % {k} " + " ".join(f"when {n} then {c}" for n, c in enumerate(cases)) + " end"


_S = "cast({} as string)"
_I = _S.format("i")


# --- delays ------------------------------------------------------------------------------------------------------------

_SEG = {"grp": "cast(floor(i / 6) as bigint)", "start": "cast((i * 37) % 200 as double)", "delay": "((i % 7) - 3) * cast(0.5 as double)"}


@query(
    "delay_segment_merge",
    f"""with recursive a as (select grp, list({{'s': "start", 'd': delay}} order by "start", delay) as a from {duck(**_SEG)} group by grp),
 p as (select grp, a, 1 as k, []::struct(s double, d double)[] as o from a
  union all select grp, a, k + case when joins then 2 else 1 end, case when abs(x.d) > 1e-6 then list_append(o, x) else o end
  from (select *, case when joins then {{'s': a[k].s, 'd': a[k].d + a[k + 1].d}} else a[k] end as x
   from (select *, coalesce(a[k + 1].s - a[k].s <= 10, false) as joins from p where k <= len(a)))),
 q as (select grp, o as a from p where k > len(a)),
 m as (select grp, a, 1 as k, []::struct(s double, d double)[] as o from q
  union all select grp, a, k + 1, case when p > 0 then list_filter(list_transform(o, lambda x, n: case when n = p then {{'s': x.s, 'd': x.d + a[k].d}} else x end), lambda x, n: n <> p or abs(x.d) > 1e-6) else list_append(o, a[k]) end
  from (select *, coalesce(list_position(list_transform(o, lambda x: abs(a[k].s - x.s) <= 30), true), 0) as p from m where k <= len(a)))
 select grp, x.s as "start", x.d as delay from (select grp, unnest(o) as x from m where k > len(a))""",
)
def _(spark, d):
    rows = given(spark, d, **_SEG).groupBy("grp").agg(F.collect_list(F.struct("start", "delay")).alias("segs"))
    return rows.select("grp", F.inline(timeline.combine_segments(F.col("segs"))))


_DELAYS = {"s": _by(5, f"concat({_S.format('i % 90')}, 'm', {_S.format('i % 60')}, 's')", f"concat('-', {_S.format('1 + i % 9')}, 'm', {_S.format('i % 60')}, 's')", f"concat(' ', {_S.format('i % 50')}, '.5 ')", f"concat('-', {_I})", f"concat('x', {_I})")}


@query("delay_input", f"select i, s, cast({_by(5, '(i % 90) * 60 + i % 60', '-((1 + i % 9) * 60 + i % 60)', 'i % 50 + 0.5', '-i', 'null')} as double) as secs from {duck(**_DELAYS)}")
def _(spark, d):
    return given(spark, d, **_DELAYS).select("i", "s", text.delay_seconds(F.col("s")).alias("secs"))


# --- text ---------------------------------------------------------------------------------------------------------------

#: Characters that sound alike share a token.
SOUNDS = {"在": ["#1", "#2"], "再": ["#1", "#2"], "是": ["#3"], "事": ["#3"], "市": ["#3"], "你": ["#4", "#2"], "我": ["#5"], "吗": ["#6"], "马": ["#6"], "好": ["#7", "#8"], "号": ["#7", "#8"]}
_CHARS = "在再是事市你我吗马好号A"
SOUND_CASE = "case z " + " ".join(f"when '{c}' then {t}" for c, t in SOUNDS.items()) + " else [lower(z)] end"


def sound_sql(s: str) -> str:
    return f"flatten(list_transform(string_split({s}, ''), lambda z: {SOUND_CASE}))"


def bag_sql(a: str, b: str) -> str:
    count = lambda x: f"len(list_filter({x}, lambda z: z = q))"
    return f"coalesce(list_sum(list_transform(list_distinct(list_concat({a}, {b})), lambda q: abs({count(a)} - {count(b)}))), 0)"


_SAID = {"a": "concat(" + ", ".join(f"substring('{_CHARS}', cast(1 + {e} as int), 1)" for e in ("i % 12", "floor(i / 12) % 11", "i % 7")) + ")", "b": "concat(" + ", ".join(f"substring('{_CHARS}', cast(1 + {e} as int), 1)" for e in ("(i + 1) % 12", "i % 5")) + ")"}


@query("pinyin_distance", f"select i, a, b, cast({bag_sql('ta', 'tb')} as int) as dist from (select *, {sound_sql('a')} as ta, {sound_sql('b')} as tb from {duck(**_SAID)})")
def _(spark, d):
    return given(spark, d, **_SAID).select("i", "a", "b", similarity.sound_distance(F.col("a"), F.col("b"), SOUNDS).cast("int").alias("dist"))


_RAW = {"s": f"concat({_by(5, f'concat({_I}, {chr(39)}ＡＢＣ１２{chr(39)})', f'concat({_I}, {chr(39)}你 好　吗{chr(39)})', f'concat({_I}, {chr(39)}a  b　c{chr(39)})', 'concat(2, repeat(3, cast(1 + i % 7 as int)))', 'repeat(6, cast(2 + i % 5 as int))')}, {_by(4, chr(39) * 2, chr(39) + '！！！' + chr(39), chr(39) + '~~' + chr(39), chr(39) + ' 。' + chr(39))})"}
_RAW["s"] = _RAW["s"].replace("concat(2, repeat(3,", "concat('2', repeat('3',").replace("repeat(6,", "repeat('6',")


@query(
    "normalize_text",
    f"select i, s, {_by(5, 'i || ' + repr('ABC12'), 'i || ' + repr('你好吗'), 'i || ' + repr('a b c'), 'case when i % 7 = 0 then ' + repr('23') + ' else ' + repr('23333') + ' end', 'case when i % 5 = 0 then ' + repr('66') + ' else ' + repr('66666') + ' end')} as norm from {duck(**_RAW)}",
)
def _(spark, d):
    return given(spark, d, **_RAW).select("i", "s", text.normalize(F.col("s")).alias("norm"))


_ENTITIES = {"s": f"concat('&#', {_S.format('33 + i % 50000')}, ';&#x', lower(hex(128512 + i % 64)), ';z')"}


@query("entity_numeric", f"select i, chr((33 + i % 50000)::int) || chr((128512 + i % 64)::int) || 'z' as out_text from {duck(**_ENTITIES)}")
def _(spark, d):
    return given(spark, d, **_ENTITIES).select("i", text.unescape_numeric(F.col("s")).alias("out_text"))


_BRACES = {"s": "concat(props, case when i % 2 = 0 then chr(92) else chr(10) end)"}


@query("ass_escape", rf"select i, replace(replace(replace(replace(s, '\', '\\'), '{{', '\{{'), '}}', '\}}'), chr(10), '\N') as out_text from {duck(**_BRACES)}")
def _(spark, d):
    return given(spark, d, **_BRACES).select("i", text.ass_escape(F.col("s")).alias("out_text"))


_SIMPLE, _FULL = "这里说话马龙", "這裡說話馬龍"
_SCRIPTS = {"s": f"concat(substring('{_SIMPLE}人', cast(1 + i % 6 as int), 2), substring('{_FULL}', cast(1 + i % 5 as int), 2), {_I})", "mode": "cast(i % 3 as int)"}


@query("script_convert", f"select i, s, mode, case mode when 1 then translate(s, '{_FULL}', '{_SIMPLE}') when 2 then translate(s, '{_SIMPLE}', '{_FULL}') else s end as dst from {duck(**_SCRIPTS)}")
def _(spark, d):
    to_simple, to_full = dict(zip(_FULL, _SIMPLE)), dict(zip(_SIMPLE, _FULL))
    return given(spark, d, **_SCRIPTS).select("i", "s", "mode", text.convert_by_mode(F.col("s"), F.col("mode"), to_simple, to_full).alias("dst"))


def _cn4(n: str, first: str) -> str:
    """Four digits in words; ``first``: whether a ten at the front loses its one."""
    digit = lambda k: f"(({n}) // {10 ** k} % 10)"
    part = lambda k, unit: f"case when {digit(k)} = 0 then '零' else substr('零一二三四五六七八九', {digit(k)} + 1, 1) || '{unit}' end"
    whole = f"regexp_replace(regexp_replace({part(3, '千')} || {part(2, '百')} || {part(1, '十')} || {part(0, '')}, '零+', '零', 'g'), '^零|零$', '', 'g')"
    return f"case when {first} and ({n}) between 10 and 19 then substr({whole}, 2) else {whole} end"


_COUNT = {"n": "(i * i * 7 + i) % 40000000"}


@query(
    "cn_number",
    f"""select i, n, case when n = 0 then '零' when n < 10000 then {_cn4('n', 'true')} else {_cn4('n // 10000', 'true')} || '万' || case when n % 10000 > 0 and (n % 10000 < 1000 or n // 10000 % 10 = 0) then '零' else '' end || {_cn4('n % 10000', 'false')} end as cn from {duck(**_COUNT)}""",
)
def _(spark, d):
    return given(spark, d, **_COUNT).withColumn("cn", names.number_to_chinese(F.col("n")))


_WORDS_OF = {"n": "i % 10000"}


@query("cn_number_back", f"select i, {_cn4('n', 'true')} as cn, n as back from {duck(**_WORDS_OF)} where n > 0")
def _(spark, d):
    rows = given(spark, d, **_WORDS_OF).where("n > 0").select("i", names.number_to_chinese(F.col("n")).alias("cn"))
    return rows.withColumn("back", names.chinese_to_number(F.col("cn")).cast("bigint"))


_HEX = {"s": f"case when i % 5 = 4 then concat('#G', {_I}) when i % 5 = 3 then '#FFF' else concat('#', lpad(lower(hex((i * 7919) % 16777216)), 6, '0')) end"}


@query("color_hex", f"select i, s, (case when i % 5 >= 3 then 16777215 else (i * 7919) % 16777216 end)::int as color from {duck(**_HEX)}")
def _(spark, d):
    return given(spark, d, **_HEX).select("i", "s", text.hex_colour(F.col("s")).alias("color"))


_N = _S.format("(i % 1000)")
_SUB = f"concat('₍', translate({_N}, '0123456789', '₀₁₂₃₄₅₆₇₈₉'), '₎')"
_MARKS = {"s": _by(8, f"concat('哈哈(', {_N}, ')')", f"concat('(', {_N}, ')哈哈')", f"concat('kksk[x', {_N}, ']')", f"concat('[x', {_N}, ']kksk')", f"concat('恭喜', {_SUB})", f"concat({_SUB}, '恭喜')", f"concat('恭喜(笑', {_N}, ')')", f"concat('恭喜', {_N})")}
_TAGS = _by(8, f"concat('(', {_N}, ')')", f"concat('(', {_N}, ')')", f"concat('[x', {_N}, ']')", f"concat('[x', {_N}, ']')", _SUB, _SUB, "null", "null")


@query("count_mark", f"select i, s, case when i % 8 < 6 then i % 1000 end::bigint as n, {_TAGS} as mark from {duck(**_MARKS)}")
def _(spark, d):
    n, tag = text.parse_mark(F.col("s"))
    return given(spark, d, **_MARKS).select("i", "s", n.alias("n"), tag.alias("mark"))


@query(
    "restore_merged",
    f"select i, case when i % 8 < 6 and i % 1000 > 1 then i % 1000 end::bigint as merge_count, round(case when i % 8 < 6 and i % 1000 > 1 then case when i % 1000 <= 5 then 1 else least(ln(i % 1000) / ln(5), 2) end end, 6)::double as merge_scale from {duck(**_MARKS)}",
)
def _(spark, d):
    n, _tag = text.parse_mark(F.col("s"))
    rows = given(spark, d, **_MARKS).withColumn("merge_count", F.when(n > 1, n))
    return rows.select("i", "merge_count", F.when(F.col("merge_count").isNotNull(), F.round(text.enlarge(F.col("merge_count")), 6)).alias("merge_scale"))


_VERSIONS = {"a": f"concat({_S.format('i % 3')}, '.', {_S.format('i % 13')}, '.', {_S.format('i % 11')})", "b": f"concat('v', {_S.format('i % 2')}, '.', {_S.format('i % 12')}, case when i % 4 = 0 then '' else concat('.', {_S.format('i % 10')}) end)"}


@query("versions", f"select i, a, b, list_transform(string_split(a, '.'), lambda x: x::int) > list_transform(string_split(substr(b, 2), '.'), lambda x: x::int) as newer from {duck(**_VERSIONS)}")
def _(spark, d):
    return given(spark, d, **_VERSIONS).select("i", "a", "b", text.version_greater(F.col("a"), F.col("b")).alias("newer"))


_FORCED = {"s": "concat('x', repeat('8', cast(i % 12 as int)), 'y')"}


@query("force_strict", f"select i, case when i % 12 between 3 and 5 then 'x8y' when i % 12 > 5 then 'x8' || repeat('8', (i % 12 - 5)::int) || 'y' else s end as exact, case when i % 12 >= 3 then 'x8y' else s end as open_ended from {duck(**_FORCED)}")
def _(spark, d):
    rules = (("8{3,5}", "8"),)
    once = lambda strict: text.force(F.col("s"), rules, strict_reference=strict, once=True)
    return given(spark, d, **_FORCED).select("i", once(False).alias("exact"), once(True).alias("open_ended"))


# --- titles -----------------------------------------------------------------------------------------------------------------

_LETTER = "substring('abcdfghijklmnopqrtuvw', cast(1 + i % 21 as int), 1)"
_TWO = "lpad(cast({} as string), 2, '0')"
_SEASON, _EPISODE = "1 + i % 20", "1 + i % 99"
_FILES = {
    "name": _by(
        7, f"concat('[Group] Show ', {_LETTER}, ' S', {_TWO.format(_SEASON)}, 'E', {_TWO.format(_EPISODE)}, ' [1080p]')", f"concat('Show.', {_LETTER}, '.2019.S', {_TWO.format(_SEASON)}, 'E', {_TWO.format(_EPISODE)}, '.1080p')",
        f"concat('动画', {_LETTER}, ' 第', {_S.format(_SEASON)}, '季 第', {_S.format(_EPISODE)}, '话')", f"concat('Some Movie ', {_LETTER}, ' - ', {_TWO.format(_EPISODE)}, ' [x]')", f"concat('[Sub] Title ', {_LETTER}, ' [', {_TWO.format(_EPISODE)}, '][1080p]')",
        f"concat('nothing ', {_LETTER})", f"concat('Show ', {_LETTER}, ' S', {_S.format(_SEASON)}, 'E', {_S.format(_EPISODE)}, 'v2')",
    )
}


@query(
    "title_parse",
    f"select i, {_by(7, *(f'concat({p!r}, {_LETTER}{t})' for p, t in (('Show ', ''), ('Show ', ', ' + repr(' (2019)')), ('动画', ''), ('Some Movie ', ''), ('Title ', ''))), 'null', f'concat({chr(39)}Show {chr(39)}, {_LETTER})')} as title, case when i % 7 in (0, 1, 2, 6) then {_SEASON} end::int as season, case when i % 7 <> 5 then {_EPISODE} end::int as episode from {duck(**_FILES)}",
)
def _(spark, d):
    rows = given(spark, d, **_FILES).withColumn("f", names.format_file_name(F.col("name")))
    title, season, episode = names.title_season_episode(F.col("f"))
    return rows.select("i", title.alias("title"), season.alias("season"), episode.alias("episode"))


_SERIES = {"a": f"concat('A', {_LETTER}, ' ', {_TWO.format('i % 90')}, ' x')", "b": f"concat(case when i % 3 = 2 then 'B' else 'A' end, {_LETTER}, ' ', {_TWO.format('1 + i % 90')}, ' x')"}


@query("series_episode", f"select i, case when i % 3 <> 2 then 1 + i % 90 end::bigint as n from {duck(**_SERIES)}")
def _(spark, d):
    return given(spark, d, **_SERIES).select("i", names.differing_episode(F.col("a"), F.col("b")).alias("n"))


_PAIRS = {"a": f"concat({_LETTER}, 'hello', {_S.format('i % 17')})", "b": f"concat(substring('hello world', cast(1 + i % 4 as int), 6), {_S.format('i % 13')})"}


def jaro_sql(phantom: bool) -> str:
    """Scores ``v`` (i, a, b, score) of the pairs ``p`` (i, a, b), by walking the first text: which places of the second are
    matched, and by what. With ``phantom`` both texts have an equal slot 0 that does not count as length."""
    low = 0 if phantom else 1
    last = "least(k + reach + 1, length(b))" if phantom else "least(k + reach, length(b))"
    char = lambda t, z: f"case when {z} = 0 then '^' else substr({t}, {z}, 1) end"
    prefix = "case when a[1] = b[1] then case when a[2] = b[2] then case when a[3] = b[3] then {} else 2 end else 1 end else 0 end"
    prefix = "1 + " + prefix.format(3) if phantom else prefix.format("case when a[4] = b[4] then 4 else 3 end")
    return f"""w as (select i, a, b, greatest(length(a), length(b)) // 2 - 1 as reach, {low}::bigint as k, []::bigint[] as used, []::varchar[] as x from p
  union all select i, a, b, reach, k + 1, case when hit is null then used else list_append(used, hit) end, case when hit is null then x else list_append(x, c) end
  from (select *, list_filter(range(greatest({low}, k - reach), {last} + 1), lambda z: not list_contains(used, z) and {char('b', 'z')} = c)[1] as hit
   from (select *, {char('a', 'k')} as c from w where k <= length(a)))),
 e as (select *, len(x) as m, list_transform(list_sort(used), lambda z: {char('b', 'z')}) as y from w where k > length(a)),
 j as (select i, a, b, case when m = 0 then 0 else (m / length(a) + m / length(b) + (m - len(list_filter(range(1, m + 1), lambda z: x[z] <> y[z])) / 2) / m) / 3 end as jaro from e),
 v as (select i, a, b, case when a = b then 1 else jaro + ({prefix}) * 0.1 * (1 - jaro) end as score from j)"""


PHANTOM = jaro_sql(True)


@query("title_score_standard", f"with recursive p as (select * from {duck(**_PAIRS)}), {jaro_sql(False)} select i, round(score, 6)::double as score from v")
def _(spark, d):
    return given(spark, d, **_PAIRS).select("i", F.round(names.jaro_winkler_udf(phantom=False)("a", "b"), 6).alias("score"))


@query("title_score_phantom", f"with recursive p as (select * from {duck(**_PAIRS)}), {PHANTOM} select i, round(score, 6)::double as score from v")
def _(spark, d):
    return given(spark, d, **_PAIRS).select("i", F.round(names.jaro_winkler_udf()("a", "b"), 6).alias("score"))


_CANDS = {
    "title": f"concat(substring('show of hello', cast(1 + i % 5 as int), 7), {_S.format('i % 23')}, {_by(6, chr(39) * 2, repr('剧场版'), repr('特番'), chr(39) * 2, repr('countdown'), chr(39) * 2)})",
    "hint": _by(4, "'动漫 | 2022'", "'电影'", "''", "'番剧'"),
}
_KIND = "(case when both_ like '%动漫%' then 40 else 0 end + case when both_ like '%番剧%' then 40 else 0 end - case when both_ like '%电影%' then 35 else 0 end - case when both_ like '%剧场版%' then 35 else 0 end)"


@query(
    "topk_candidates",
    f"""with recursive c as (select i, title, hint, title || ' ' || hint as both_, regexp_replace(lower(title), '[\\s!-/:-@\\[-`{{-~]+', '', 'g') as b from {duck(**_CANDS)}), p as (select i, 'show5' as a, b from c), {PHANTOM},
 s as (select c.i, title, round(score * 100 + case when c.b = 'show5' then 30 else 0 end + {_KIND} - case when title like '%countdown%' then 40 else 0 end - case when title like '%特番%' then 40 else 0 end - least(greatest(length(c.b) - 5, 0), 40) * 0.8, 6)::double as score from v join c using (i))
 select row_number() over (order by score desc, i)::int as rnk, i, title, score from s order by score desc, i limit 3""",
)
def _(spark, d):
    scored = given(spark, d, **_CANDS).withColumn("score", F.round(names.title_score(F.lit("Show 5"), F.col("title"), F.col("hint")), 6))
    return tables.top_k(scored, "score", 3, ["i"]).select("rnk", "i", "title", "score")


_SEARCH = {
    "q": "cast(floor(i / 5) as bigint)", "pos": "i % 5", "wanted": "'tv'", "season": "case when floor(i / 5) % 3 = 2 then cast(null as int) else cast(1 + floor(i / 5) % 4 as int) end", "title": "concat('show', cast(cast(floor(i / 5) % 7 as int) as string))",
    "type": "case when floor(i / 5) % 5 = 4 then case when i % 5 = 2 then 'tv' else 'movie' end when i % 2 = 0 then 'tv' else 'movie' end",
    "candidate": "concat(' show', cast(i % 9 as string), case when i % 4 = 0 then ' 第一季' when i % 4 = 2 then ' 第二季 (2020)' else ' 【x】 y' end)",
}


@query(
    "title_match",
    f"""with recursive g as (select * from {duck(**_SEARCH)}), t as (select *, count(*) over (partition by q) as n from g where type = wanted),
 c as (select *, trim(regexp_replace(regexp_replace(trim(candidate), '\\s*\\(.*?\\)\\s*$', ''), '\\s*【.*?】.*$', '')) as b from t where n > 1 and season is not null),
 f as (select *, max(case when b like '%第一季%' and season = 1 then 1 else 0 end) over (partition by q order by pos) as first from c),
 p as (select i, case when first = 1 then title || ' 第一季' when season > 1 then title || ' 第' || substr('一二三四五六七八九', season, 1) || '季' else title end as a, b from f), {PHANTOM},
 r as (select f.q, f.pos, f.candidate, v.score, row_number() over (partition by f.q order by round(v.score, 9) desc, f.pos) as k from v join f using (i))
 select q, pos, candidate, null::double as score from t where n = 1 union all select q, pos, candidate, round(score, 6)::double from r where k = 1 and score >= 0.75""",
)
def _(spark, d):
    rows = given(spark, d, **_SEARCH)
    return tables.match_title(rows, "q", "pos").select("q", "pos", "candidate", F.round("score", 6).alias("score"))


# --- small tables ---------------------------------------------------------------------------------------------------------------

_ENTRIES = {"server": _by(3, "'a'", "'b'", "'c'"), "id": _by(4, "''", "null", _S.format("i % 500"), _S.format("i % 700")), "title": f"concat('Show', case when i % 2 = 0 then '  ' else ' ' end, {_S.format('i % 300')})"}


@query(
    "catalogue_dedup",
    f"select key, server, title, i from (select *, row_number() over (partition by key order by case server when 'c' then 1 when 'b' then 2 else 3 end, i) as k from (select *, case when coalesce(id, '') = '' then replace(title, ' ', '') else id end as key from {duck(**_ENTRIES)})) where k = 1",
)
def _(spark, d):
    rows = given(spark, d, **_ENTRIES)
    keyed = tables.by_server(rows.withColumn("key", tables.entry_key(F.col("id"), F.col("title"))), ["c", "b", "a"])
    return tables.first_of(keyed, ["key"], ["server_rank", "i"]).select("key", "server", "title", "i")


_CHANGES = {"key": "i % 1500", "value": f"concat('v', {_I})", "version": "(i * 31) % 9973"}


@query(
    "history_upsert",
    f"""with g as (select * from {duck(**_CHANGES)}), base as (select distinct key * 2 as key, 'old' as value from g), last as (select key, value from (select *, row_number() over (partition by key order by version desc, value) as k from g where i % 3 = 0) where k = 1)
 select coalesce(l.key, b.key) as key, coalesce(l.value, b.value) as value from base b full join last l on l.key = b.key where coalesce(l.key, b.key) % 7 <> 0""",
)
def _(spark, d):
    rows = given(spark, d, **_CHANGES)
    base = rows.select((F.col("key") * 2).alias("key"), F.lit("old").alias("value")).distinct()
    gone = rows.where("key % 7 = 0").select("key").union(base.where("key % 7 = 0").select("key")).distinct()
    return tables.upsert(base, rows.where("i % 3 = 0").select("key", "value", "version"), "key", gone, ties=["value"])


_WATCHED = {"old": "i * 1000 + i % 24", "history_number": "i % 24", "playing": "i % 26"}


@query("episode_extrapolation", f"select i, old + playing - history_number as id, (old + playing - history_number) % 1000 as number from {duck(**_WATCHED)}")
def _(spark, d):
    new = tables.extrapolate(F.col("old"), F.col("history_number"), F.col("playing"))
    return given(spark, d, **_WATCHED).select("i", new.alias("id"), tables.episode_number(new).alias("number"))


_HINTS = {"hint": _by(7, _S.format("i % 1500"), f"concat('第', {_S.format('i % 1500')}, '话')", f"concat('EP', {_S.format('i % 1500')})", f"concat({_S.format('i % 1500')}, '.5')", "'总集篇'", f"concat('动漫 | 2022 | 来源：', {_I})", f"concat('episode no ', {_I})")}


@query("hint_episode", f"select i, hint, case when i % 7 < 4 and i % 1500 < 1000 then i % 1500 + case when i % 7 = 3 then 0.5 else 0 end when i % 7 = 6 and i < 10 then i end::double as n from {duck(**_HINTS)}")
def _(spark, d):
    return given(spark, d, **_HINTS).select("i", "hint", tables.hint_number(F.col("hint")).alias("n"))


_ITEMS = {
    "list": "cast(floor(i / 10) as bigint)", "hint": f"case when i % 3 = 0 then concat('第', {_S.format('i % 10')}, '话') else {_S.format('i % 10')} end",
    "command": "case when floor(i / 10) % 3 = 0 then 'load-danmaku' when floor(i / 10) % 3 = 1 then case when i % 10 < 7 then 'search-episodes-event' else 'load-danmaku' end else 'seek' end", "selectable": "i % 10 <> 9",
}


@query("episode_lists", f"""select list, case when 2 * count(*) filter (selectable and command <> 'seek') > count(*) filter (selectable) then 2 * count(*) filter (selectable and command = 'load-danmaku') > count(*) filter (selectable) else 2 * count(*) filter (selectable and regexp_matches(hint, '[0-9]')) > count(*) filter (selectable) end as is_episode_list
 from {duck(**_ITEMS)} group by list""")
def _(spark, d):
    rows = given(spark, d, **_ITEMS).withColumn("value", F.array(F.lit("script-message"), F.col("command"), F.lit("1")))
    return tables.episode_lists(rows, "list")


@query("episode_pick", f"select list, min(i) as i, min(case command when 'load-danmaku' then 'episode' when 'search-episodes-event' then 'anime' end) as kind from {duck(**_ITEMS)} where i % 10 = 4 group by list")
def _(spark, d):
    rows = given(spark, d, **_ITEMS).withColumn("value", F.array(F.lit("script-message"), F.col("command"), F.lit("1")))
    wanted = rows.where(tables.hint_number(F.col("hint")) == 4)
    return tables.first_of(wanted, ["list"], ["i"]).select("list", "i", tables.command_kind(F.col("value")).alias("kind"))


_BATCHED = {"total": "i % 900"}


@query("episode_batches", f"select i, unnest(range(1, total + 1, 200)) as first, least(first + 199, total) as last from {duck(**_BATCHED)}")
def _(spark, d):
    return given(spark, d, **_BATCHED).select("i", F.inline(tables.batches(F.col("total"), 200)))


# --- addresses ------------------------------------------------------------------------------------------------------------------

_URLS = {"url": _by(3, f"concat('https://h/video/BV', {_LETTER}, {_I}, '?p=', {_S.format('i % 40')})", f"concat('https://h/video/av', {_I})", f"concat('https://h/x/abc', {_I}, '.html?vid=v', {_S.format('i % 77')})")}


@query("url_identifiers", f"select i, case when i % 3 = 0 then concat('BV', {_LETTER}, i) end as bv, case when i % 3 = 1 then i::varchar end as av, case when i % 3 = 0 then i % 40 else 1 end::int as page, {_by(3, f'concat({chr(39)}BV{chr(39)}, {_LETTER}, i)', f'concat({chr(39)}av{chr(39)}, i)', f'concat({chr(39)}v{chr(39)}, i % 77)')} as vid from {duck(**_URLS)}")
def _(spark, d):
    bv, av, page = addresses.video_and_page(F.col("url"))
    return given(spark, d, **_URLS).select("i", bv.alias("bv"), av.alias("av"), page.alias("page"), addresses.video_parameter(F.col("url")).alias("vid"))


_PATHS = {"s": _by(3, f"concat('a:b:', {_I}, ':c')", f"concat('/b/', {_I}, '/', {_S.format('i % 99')}, 'x.html')", f"concat('/x/y', {_I}, '/z', {_S.format('i % 99')}, '.mp4')")}


@query("path_identifiers", f"select i, {_by(3, 'i::varchar', 'null', 'null')} as third, {_by(3, 'null', 'i::varchar', repr('y') + ' || i')} as collection, {_by(3, 'null', '(i % 99) || ' + repr('x'), repr('z') + ' || (i % 99)')} as video from {duck(**_PATHS)}")
def _(spark, d):
    collection, video = addresses.collection_and_video(F.col("s"))
    return given(spark, d, **_PATHS).select("i", addresses.third_field(F.col("s")).alias("third"), collection.alias("collection"), video.alias("video"))


_ASKED = {"q": _by(4, f"concat('show ', {_I}, ' | 动漫', {_S.format('i % 5')})", f"concat('show ', {_I}, ' @ main', {_S.format('i % 5')})", f"concat('a@b', {_I}, '@')", f"concat('plain ', {_I})")}


@query("query_syntax", f"select i, {_by(4, repr('show ') + ' || i', repr('show ') + ' || i', repr('a@b') + ' || i', repr('plain ') + ' || i')} as name, case when i % 4 = 0 then '动漫' || (i % 5) end as class, case when i % 4 = 1 then 'main' || (i % 5) end as note from {duck(**_ASKED)}")
def _(spark, d):
    name, kind, note = addresses.query_parts(F.col("q"))
    return given(spark, d, **_ASKED).select("i", name.alias("name"), kind.alias("class"), note.alias("note"))


_SERVERS = {"s": f"concat(' u', {_I}, ' | main , w', {_S.format('i % 9')}, case when i % 2 = 0 then ',' else '' end, ',x#n', {_S.format('i % 7')}, ' ')"}


@query("server_list", f"select i, 0 as pos, 'u' || i as url, 'main' as note from {duck(**_SERVERS)} union all select i, 1, 'w' || (i % 9), null from {duck(**_SERVERS)} union all select i, 2, 'x', 'n' || (i % 7) from {duck(**_SERVERS)}")
def _(spark, d):
    return given(spark, d, **_SERVERS).select("i", F.posexplode(addresses.servers(F.col("s"))).alias("pos", "x")).select("i", "pos", "x.url", "x.note")


_TITLED = {"title": _by(3, f"concat('〔组', {_S.format('i % 5')}, '〕Show_', {_I})", f"concat('x', {_S.format('i % 5')}, '《Title', {_I}, '》y')", f"concat('plain ', {_I}, '!+')")}


@query("title_rules", f"select i, {_by(3, repr('组') + ' || (i % 5) || ' + repr(' Show ') + ' || i', repr('Title') + ' || i || ' + repr('y'), repr('plain ') + ' || i || ' + repr('!'))} as out_text from {duck(**_TITLED)}")
def _(spark, d):
    rules = addresses.title_rules('[{"rules":[{"^〔(.-)〕": "%1 "},{"^.*《(.-)》": "%1"},{"[bad": "x"}]}]')
    return given(spark, d, **_TITLED).select("i", addresses.replace_title(F.col("title"), rules).alias("out_text"))


_MEDIA = {"path": _by(3, "'https://h/v'", f"concat('/home/', {_I}, '.mkv')", "'https://h/v'"), "title": _by(3, f"concat('My%20Show+', {_I}, ' | 动漫')", "'T'", "''"), "file": f"concat('file', {_I})"}


@query("media_names", f"select i, {_by(3, repr('My Show ') + ' || i', repr('file') + ' || i', repr('file') + ' || i')} as name from {duck(**_MEDIA)}")
def _(spark, d):
    return given(spark, d, **_MEDIA).select("i", addresses.media_name(F.col("path"), F.col("title"), F.col("file")).alias("name"))


_FAILED = {"e": _by(4, f"concat('Exit code: 7 Error: refused  now ', {_S.format('i % 100')})", f"concat('Exit code: ', {_S.format('100 + i % 100')})", "''", f"concat('Error: it is too long for a hint ', {_I})")}


@query("failure_hints", f"select i, {_by(4, repr('exit 7 连不上服务器：refused now ') + ' || (i % 100)', repr('exit ') + ' || (100 + i % 100)', repr('无详细信息'), repr('it is too long for'))} as hint from {duck(**_FAILED)}")
def _(spark, d):
    return given(spark, d, **_FAILED).select("i", addresses.failure_hint(F.col("e")).alias("hint"))


# --- payloads ---------------------------------------------------------------------------------------------------------------------


def _payloads(rows: DataFrame, item: str, head: str = "", tail: str = "", sep: str = ",") -> DataFrame:
    """One payload for every twenty inputs, in order."""
    parts = rows.select(F.floor(F.col("i") / 20).alias("grp"), F.struct("i", F.expr(item).alias("x")).alias("x")).groupBy("grp").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return parts.select("grp", F.concat(F.lit(head), F.array_join(F.col("x.x"), sep), F.lit(tail)).alias("payload"))


_COLOUR = "(i * 7919) % 16777216"
_HEX6 = f"lpad(lower(hex({_COLOUR})), 6, '0')"
_AT = "(i * 13) % 100000"


@query("parse_array_form", f"select floor(i / 20)::bigint as grp, (({_AT}) / 4.0)::double as time, (case i % 3 when 0 then 1 when 1 then 4 else 5 end) as type, ({_COLOUR})::int as color, 't' || i as text from {duck()}")
def _(spark, d):
    item = f"""concat('[', cast(({_AT}) / 4.0D as string), ',"', case i % 3 when 0 then 'right' when 1 then 'top' else 'bottom' end, '","#', {_HEX6}, '","","t', {_I}, '"]')"""
    return payloads.array_comments(_payloads(given(spark, d), item, '{"danum":20,"danmuku":[', "]}"), keep=("grp",)).select("grp", "time", "type", "color", "text")


_SITES = {
    "position": (f"""concat('{{"time":', cast(({_AT}) * 10 as string), ',"color":"#', {_HEX6}, '","position":', cast(i % 3 as string), ',"text":"t', {_I}, '"}}')""", "[", "]", ","),
    "tagged": (f"concat('<d><content>t', {_I}, '</content><showTime>', cast({_AT} as string), '</showTime><color>', {_HEX6}, '</color></d>')", "", "", ""),
    "items": (f"""concat('{{"time":', cast(({_AT}) * 1000 as string), ',"content":"t', {_I}, '"}}')""", '{"data":{"items":[', "]}}", ","),
    "barrage": (f"""concat('{{"time_offset":"', cast(({_AT}) * 1000 as string), '","content":"t', {_I}, '","content_style":{{"color":"#', {_HEX6}, '"}}}}')""", '{"barrage_list":[', "]}", ","),
}


@query(
    "site_payloads",
    " union all ".join(
        f"select '{site}' as site, ({_AT})::double as time, {'(case i % 3 when 0 then 1 when 1 then 4 else 5 end)' if site == 'position' else 1} as type, {'16777215' if site == 'items' else f'({_COLOUR})::int'} as color, 't' || i as text from {duck()}" for site in [*_SITES, "nested"]
    ),
)
def _(spark, d):
    rows = {site: _payloads(given(spark, d), *how) for site, how in _SITES.items()}
    inner = f"to_json(named_struct('playat', cast(({_AT}) * 1000 as string), 'content', concat('t', {_I}), 'propertis', to_json(named_struct('color', {_COLOUR}))))"
    wrapped = F.to_json(F.struct(F.struct(F.col("payload").alias("result")).alias("data")))
    rows["nested"] = _payloads(given(spark, d), inner, '{"data":{"result":[', "]}}").select("grp", wrapped.alias("payload"))
    return reduce(DataFrame.unionByName, (payloads.READERS[site](p).select(F.lit(site).alias("site"), "time", "type", "color", "text") for site, p in rows.items()))


_RULES = {
    "xml": (f"""concat('<item enabled="', case when i % 3 = 0 then 'false' else 'true' end, '">t=a', {_I}, '</item>')""", "", "", "\n"),
    "json": (f"""concat('{{"type":', cast(i % 2 as string), ',"filter":"a', {_I}, '","opened":', case when i % 3 = 0 then 'false' else 'true' end, ',"id":1}}')""", "[", "]", ","),
    "txt": (f"case when i % 3 = 0 then '  ' else concat('  a', {_I}, ' ') end", "", "\n", "\n"),
}


@query("rule_files", f"select 'xml' as kind, 'a' || i as pattern from {duck()} where i % 3 <> 0 union all select 'json', 'a' || i from {duck()} where i % 3 <> 0 and i % 2 = 0 union all select 'txt', 'a' || i from {duck()} where i % 3 <> 0")
def _(spark, d):
    return reduce(DataFrame.unionByName, (payloads.rules(_payloads(given(spark, d), *how), kind).select(F.lit(kind).alias("kind"), "pattern") for kind, how in _RULES.items()))


@query("mixed_list", f"select (i % 20)::int as pos, case i % 3 when 2 then null else 'u' || i end as url from {duck()}")
def _(spark, d):
    item = f"""case i % 3 when 0 then concat('"u', {_I}, '"') when 1 then concat('{{"url":"u', {_I}, '"}}') else '""' end"""
    return payloads.mixed_list(_payloads(given(spark, d), item, "[", "]")).select("pos", "url")


@query("history_sources", f"select 'p' || i as path, 'u' || i as url, case i % 3 when 0 then 'api' when 1 then 'local' else 'user' end as origin, i % 3 = 0 as blocked, case when i % 3 = 2 then (i % 9) + 0.5 end::double as delay from {duck()}")
def _(spark, d):
    blocked = f"""concat('"p', {_I}, '":{{"sources":{{"u', {_I}, '":{{"from":"api","blocked":true}}}}}}')"""
    open_ = f"""concat('"p', {_I}, '":{{"sources":{{"u', {_I}, '":{{"from":"local"}}}}}}')"""
    old = f"""concat('"p', {_I}, '":{{"sources":["u', {_I}, '<user>{{{{', cast(i % 9 as string), '.5}}}}"]}}')"""
    return payloads.history_sources(_payloads(given(spark, d), f"case i % 3 when 0 then {blocked} when 1 then {open_} else {old} end", "{", "}"))


_P = payloads.STAGE_PREFIX
_TAGGED = {"content": _by(5, f"concat('{export.HEADER}', chr(10), '<!-- {_P}merged -->', {_I})", f"concat('<!--{_P}filtered-->', {_I})", f"concat('<i><d p=1>merged', {_I}, '</d>')", f"concat('<!-- {_P}other -->', {_I})", f"concat('<!-- {_P}MERGED -->', {_I})")}


@query("stage_tags", f"select i, {_by(5, repr('merged'), repr('filtered'), 'null', 'null', repr('merged'))} as stage from {duck()}")
def _(spark, d):
    return given(spark, d, **_TAGGED).select("i", payloads.stage_tag(F.col("content")).alias("stage"))


@query("linked_rows", f"select 't' || i as title, case s when 'a' then 'site a' else 'site b' end as site, s || i as link, '动漫 | ' || (2000 + i % 20) || ' | 来源：' || case s when 'a' then 'site a' else 'site b' end as hint from {duck()}, (values ('a'), ('b')) v(s) where s = 'a' or i % 2 = 0")
def _(spark, d):
    item = f"""concat('{{"titleTxt":"t', {_I}, '","cat_name":"动漫","year":"', cast(2000 + i % 20 as string), '","en_id":"e', {_I}, '","playlinks":{{"sa":"a', {_I}, '"', case when i % 2 = 0 then concat(',"sb":"b', {_I}, '"') else '' end, ',"zz":"q"}}}}')"""
    return payloads.linked_rows(_payloads(given(spark, d), item, '{"data":{"longData":{"rows":[', "]}}}"), {"sa": "site a", "sb": "site b"}).select("title", "site", "link", "hint")
