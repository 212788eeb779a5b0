"""Registered queries of the engine's own operators, with their DuckDB oracles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.functions import addresses, text
from timedtext.functions.similarity import Cascade
from timedtext.operators import layout, merging, tables, timeline
from timedtext.plans import derived  # noqa: F401  (registers its queries)
from timedtext.plans.comments import DUCK, comments, flow
from timedtext.plans.derived import SOUNDS, bag_sql, sound_sql
from timedtext.plans.registry import ORACLES, QUERIES, query
from timedtext.sources import export, payloads

SEGMENTS = [(0.0, 2.0), (5000.0, -1.5), (12000.0, 0.25)]
RULES = ["^cl.ck!+$", "view%f[%s] x$", "[broken", "^%u", "p.rch.-~$"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow(spark, sf_dir, SEGMENTS, RULES)


def _segments():
    return F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("delay")) for a, b in SEGMENTS))


def _mergeable(spark, d) -> DataFrame:
    return comments(spark, d).where("type between 1 and 5")


_SEGS_SQL = "(values " + ", ".join(f"({a}::double, {b}::double)" for a, b in SEGMENTS) + ") s(start, delay)"
_M = f"c as ({DUCK}), m as (select * from c where type between 1 and 5)"


# --- time ---------------------------------------------------------------------------------------------------------------


@query("delay_asof", f"with c as ({DUCK}) select cid, round(time + coalesce((select sum(delay) from {_SEGS_SQL} where start < time), 0), 6) as adj_time from c")
def _(spark, d):
    return comments(spark, d).select("cid", F.round(F.col("time") + timeline.delay_at(_segments(), F.col("time")), 6).alias("adj_time"))


@query("delay_inclusive", f"with c as ({DUCK}) select cid, coalesce((select sum(delay) from {_SEGS_SQL} where start <= time), 0)::double as delay from c")
def _(spark, d):
    return comments(spark, d).select("cid", timeline.delay_at(_segments(), F.col("time"), inclusive=True).alias("delay"))


_SOURCES = "select * from (values ('s0', false, 'raw', 0.5D), ('s1', true, 'raw', 1.0D), ('s2', false, 'merged', -2.0D)) as t(source, blocked, stage, delay)"


@query(
    "source_delays",
    f"with c as ({DUCK}), s as ({_SOURCES.replace('5D', '5').replace('0D', '0')}) select cid, source, time as orig_time, round(time + (case when time > 100 then delay else 0 end), 6)::double as time, stage from c join s using (source) where not blocked",
)
def _(spark, d):
    sources = spark.sql(_SOURCES).withColumn("delay_segments", F.array(F.struct(F.lit(100.0).alias("start"), F.col("delay").alias("delay")))).drop("delay")
    return timeline.apply_delays(comments(spark, d), sources).select("cid", "source", "orig_time", F.round("time", 6).alias("time"), "stage")


_HIT = "case when regexp_matches(text, '^cl.ck!+$') then '^cl.ck!+$' when regexp_matches(text, 'view x$') then 'view%f[%s] x$' when regexp_matches(text, '^[A-Z]') then '^%u' when regexp_matches(text, 'p.rch.*?~$') then 'p.rch.-~$' end"


@query("blacklist_filter", f"with c as ({DUCK}) select cid, text from c where {_HIT} is null")
def _(spark, d):
    return timeline.drop_ruled(comments(spark, d), RULES).select("cid", "text")


@query("first_blacklist_hit", f"with c as ({DUCK}) select cid, {_HIT} as pattern from c where {_HIT} is not null")
def _(spark, d):
    return comments(spark, d).select("cid", timeline.first_rule(F.col("text"), RULES).alias("pattern")).where("pattern is not null")


@query("kway_order", f"with c as ({DUCK}) select cid, source, row_number() over (partition by source order by time, source, cid) as ord from c")
def _(spark, d):
    return timeline.ordered(comments(spark, d), ["source"]).select("cid", "source", F.col("ord").cast("bigint").alias("ord"))


@query("sessions", f"with c as ({DUCK}), w as (select *, case when time - lag(time) over (partition by source order by time, cid) <= 3 then 0 else 1 end as n from c) select cid, source, cast(sum(n) over (partition by source order by time, cid rows unbounded preceding) as bigint) as session from w")
def _(spark, d):
    return timeline.sessions(comments(spark, d), 3, ["source"], order=["cid"]).select("cid", "source", F.col("session").cast("bigint").alias("session"))


_EVENTS = "e as (select cid, type, text, case when type = 1 then floor(time + 0.5) else time end as start_time, case when type = 1 then floor(time + 0.5) + 15 else time + 5 end as end_time from m)"


#: Every 37 seconds of the timeline, to its end.
_POS = "p as (select unnest(range(0, (select max(time) + 37 from m)::bigint, 37))::double as pos)"


def _asked(spark, d) -> DataFrame:
    last = _mergeable(spark, d).agg(F.max("time")).first()[0]
    return spark.range(0, int(last + 37), 37).select(F.col("id").cast("double").alias("pos"))


def _timed(spark, d):
    return layout.timed(comments(spark, d))


@query("active_at", f"with {_M}, {_EVENTS}, {_POS} select pos, cid from p, e where start_time <= pos and start_time >= pos - 15 and end_time >= pos")
def _(spark, d):
    return timeline.active_at(_timed(spark, d), _asked(spark, d), 15).select("pos", "cid")


@query(
    "position_at",
    f"with {_M}, {_EVENTS}, {_POS} select pos, cid, round(1920 + length(text) / 2.0 * 25 / 2 + (-(length(text) / 2.0 * 25 / 2) - (1920 + length(text) / 2.0 * 25 / 2)) * (pos - start_time) / (end_time - start_time), 6)::double as x, (cid * 13) % 1080 <= 918 as shown from p, e "
    "where type = 1 and start_time <= pos and start_time >= pos - 15 and end_time >= pos",
)
def _(spark, d):
    half = text.display_width(F.col("text"), F.lit(25.0)) / 2
    rows = timeline.active_at(_timed(spark, d).where("type = 1"), _asked(spark, d), 15)
    x = timeline.x_at(1920 + half, -half, F.col("start_time"), F.col("end_time"), F.col("pos"))
    return rows.select("pos", "cid", F.round(x, 6).alias("x"), timeline.visible(F.col("cid") * 13 % 1080, 918).alias("shown"))


@query(
    "browse",
    f"""with c as ({DUCK}), e as (select cid, time as start_time, time + 5 as end_time, trim(case cid % 5 when 0 then 'm 0 0 l 5 -7.5 b 1 s' when 1 then '  ' || text || ' ' when 2 then ' ' else text end) as text from c)
 select cid, text, start_time <= 9000 and end_time >= 9000 as active from e where cid % 5 not in (0, 2) and start_time between 0 and 20000
 union all select cid, text, start_time <= 9000 and end_time >= 9000 from e where cid % 5 = 0 and start_time between 0 and 20000""",
)
def _(spark, d):
    # the last letter of the drawing here is none of a drawing, so that text stays
    made = F.expr("case cid % 5 when 0 then 'm 0 0 l 5 -7.5 b 1 s' when 1 then concat('  ', text, ' ') when 2 then case when cid % 2 = 0 then ' ' else 'm 0 0 l 5 -7.5 b 1 2' end else text end")
    events = comments(spark, d).select("cid", made.alias("text"), F.col("time").alias("start_time"), (F.col("time") + 5).alias("end_time"))
    return timeline.browse(events, 20000, 9000).select("cid", "text", "active")


# --- merging ---------------------------------------------------------------------------------------------------------------


_TOLERANCE = f"""with recursive {_M}, r as (select *, row_number() over (partition by text, type order by time, cid) as rn from m),
 walk as (select text, type, rn, cid, time, time as anchor, cid as acid from r where rn = 1
  union all select r.text, r.type, r.rn, r.cid, r.time, case when r.time - w.anchor <= 5 then w.anchor else r.time end, case when r.time - w.anchor <= 5 then w.acid else r.cid end
  from walk w join r on r.text = w.text and r.type = w.type and r.rn = w.rn + 1)
 select acid as cid, text, type, any_value(anchor) as time, count(*)::int as merge_count,
  case when count(*) > 2 or min(time) <> max(time) then text || 'x' || count(*) else text end as out_text from walk group by acid, text, type"""


@query("tolerance_merge", _TOLERANCE)
def _(spark, d):
    return merging.tolerance_merge(_mergeable(spark, d), 5).select("cid", "text", "type", "time", "merge_count", "out_text")


_DIST = "sqrt(pow(((a >> 16) & 255) - ((b >> 16) & 255), 2) + pow(((a >> 8) & 255) - ((b >> 8) & 255), 2) + pow((a & 255) - (b & 255), 2))"


def _colour_rows(spark, d):
    # colours that repeat and lie close: a few channels only
    near = (F.col("cid") * 7 % 5 * 65536 * 6 + F.col("cid") % 3 * 256 * 9 + F.col("cid") % 11).cast("int")
    return comments(spark, d).withColumns({"color": near, "text": F.col("source")})


@query(
    "color_leaders",
    f"""with recursive {_M}, k as (select cid, time, source as text, cast(cid * 7 % 5 * 65536 * 6 + cid % 3 * 256 * 9 + cid % 11 as int) as color from c),
 f as (select text, color, min((time, cid)) as first from k group by text, color), r as (select *, row_number() over (partition by text order by first) as rn from f),
 walk as (select text, rn, color, [color] as leaders, color as leader from r where rn = 1
  union all select r.text, r.rn, r.color, case when len(near) = 0 then list_append(w.leaders, r.color) else w.leaders end, case when len(near) = 0 then r.color else near[1] end
  from walk w join r on r.text = w.text and r.rn = w.rn + 1, lateral (select list_filter(w.leaders, lambda l: sqrt(pow(((l >> 16) & 255) - ((r.color >> 16) & 255), 2) + pow(((l >> 8) & 255) - ((r.color >> 8) & 255), 2) + pow((l & 255) - (r.color & 255), 2)) <= 15) as near) n)
 select k.cid, w.leader as leader_color from k join walk w on w.text = k.text and w.color = k.color""",
)
def _(spark, d):
    return merging.with_leader(_colour_rows(spark, d), ["text"], ["time", "cid"]).select("cid", F.col("leader").alias("leader_color"))


_END = r"[.。,，/?？!！…~～@^、+=\-_♂♀ ]"
_NORM = f"case when regexp_full_match(text, '{_END}*') then text else regexp_replace(text, '{_END}+$', '') end"
# what the derived texts need of normalisation: endings and half-width marks
_NORMED = f"replace(replace({_NORM}, '!', '！'), '?', '？')"
_CHARS = lambda s: f"string_split({s}, '')"
_BAG = lambda a, b: f"coalesce(list_sum(list_transform(list_distinct(list_concat({a}, {b})), lambda q: abs(len(list_filter({a}, lambda z: z = q)) - len(list_filter({b}, lambda z: z = q))))), 0)"
_GRAMS = lambda s: f"list_transform(range(1, greatest(length({s}), 1)), lambda i: substring({s}, i, 2))"
_SQ = lambda a, b: f"coalesce(list_sum(list_transform(list_distinct({a}), lambda q: len(list_filter({a}, lambda z: z = q)) * len(list_filter({b}, lambda z: z = q)))), 0)"
_COS = lambda a, b: f"case when len({a}) = 0 or len({b}) = 0 then 0 else cast(floor({_SQ(a, b)}::double * {_SQ(a, b)} / {_SQ(a, a)} / {_SQ(b, b)} * 100) as bigint) end"


def _cascade_sql(s: str, t: str, sc: str, tc: str, sg: str, tg: str, sound: tuple[str, str] | None = None, dist: int = 5, cosine: int = 45) -> str:
    total, edit = f"(length({s}) + length({t}))", _BAG(sc, tc)
    close = lambda d: f"(case when {total} < {2 * dist} then {d} < {dist} * {total} / {2 * dist}::double else {d} <= {dist} end)"
    within = f"abs(length({s}) - length({t})) <= {dist}"
    heard = f"when abs(len({sound[0]}) - len({sound[1]})) <= {dist} and {close(bag_sql(*sound))} then 'pinyin' " if sound else ""
    return f"case when {s} = {t} then 'identical' when {within} and {close(edit)} then 'edit' {heard}when not ({within} and {edit} >= {total}) and {_COS(sg, tg)} >= {cosine} then 'cosine' end"


#: The published default: 30 seconds, all types, sounds on. A third of the texts is Chinese, so that sounds decide there.
_SPOKEN = "case when cid % 3 = 0 then concat(substring('在再是事市你我吗马好号', cast(1 + cid % 11 as int), 1), substring('吗马好号在再是事市', cast(1 + cid % 9 as int), 1), case when cid % 2 = 0 then '这件事情大家都知道了' else '没有人会知道这一件' end, substring('在再是事市你我', cast(1 + cid % 7 as int), 1), '!') else text end"
_CASCADE = Cascade(sounds=SOUNDS)
_ROWS = "'t': t, 'cid': cid, 's': s, 'ch': ch, 'gr': gr, 'so': so"
_CLUSTER = f"""with recursive {_M}, sp as (select * replace ({_SPOKEN} as text) from m), n as (select *, {_NORMED} as s, cast(floor(time * 1000 + 0.5) as bigint) as t from sp),
 l as (select *, case when t - lag(t) over (partition by source order by t, cid) <= 30000 then 0 else 1 end as new from n),
 q as (select *, sum(new) over (partition by source order by t, cid rows unbounded preceding) as session from l),
 r as (select cid, source, session, type, color, time, t, s, text, {_CHARS('s')} as ch, {_GRAMS('s')} as gr, {sound_sql('s')} as so, row_number() over (partition by source, session order by t, cid) as rn from q),
 walk as (select source, session, rn, cid, cid as leader, 'orig' as reason, [{{{_ROWS}}}] as ls from r where rn = 1
  union all select source, session, rn, cid, case when hit is null then cid else hit.cid end, case when hit is null then 'orig' else hit.reason end,
   case when hit is null then list_append(live, {{{_ROWS}}}) else live end
  from (select source, session, rn, cid, t, s, ch, gr, so, live,
    list_filter(list_transform(live, lambda o: {{'cid': o.cid, 'reason': {_cascade_sql('s', 'o.s', 'ch', 'o.ch', 'gr', 'o.gr', ('so', 'o.so'))}}}), lambda h: h.reason is not null)[-1] as hit
   from (select r.*, list_filter(w.ls, lambda o: r.t - o.t <= 30000) as live from walk w join r on r.source = w.source and r.session = w.session and r.rn = w.rn + 1)))"""


def _spoken(spark, d) -> DataFrame:
    return _mergeable(spark, d).withColumn("text", F.expr(_SPOKEN))


def _assigned(spark, d):
    return merging.fuzzy_assign(_spoken(spark, d), ["source"], cascade=_CASCADE)


@query("fuzzy_assign", f"{_CLUSTER} select cid, leader, reason from walk")
def _(spark, d):
    return _assigned(spark, d).select("cid", "leader", "reason")


_MERGED = f"""{_CLUSTER}, a as (select walk.leader, walk.reason, r.* from walk join r using (cid)),
 g as (select *, row_number() over (partition by leader order by t, cid) - 1 as i, count(*) over (partition by leader) as n from a),
 h as (select leader, max(n)::int as merge_count, max(case when i = least(floor(n * 0.2), n - 1) then time end) as time, max(case when i = least(floor(n * 0.2), n - 1) then color end) as color,
  max(case when i = least(floor(n * 0.2), n - 1) then type end) as rep, bool_or(type = 4) as four, bool_or(type = 5) as five,
  arg_max(reason, case reason when 'identical' then 4 when 'edit' then 3 when 'pinyin' then 2 when 'cosine' then 1 else 0 end) as merge_reason from g group by leader),
 x as (select leader, s, count(*) as k from a group by leader, s), y as (select *, max(k) over (partition by leader) as top from x),
 z as (select *, row_number() over (partition by leader order by length(s), s) as p, count(*) over (partition by leader) as e from y where k = top),
 merged as (select h.leader, time, (case when four then 4 when five then 5 else rep end)::int as type, color, z.s || case when merge_count > 1 then '(' || merge_count || ')' else '' end as text, merge_count,
  round(case when merge_count <= 5 then 1 else greatest(least(ln(merge_count) / ln(5), 2), 1) end, 6)::double as merge_scale, merge_reason, z.s from h join z on z.leader = h.leader and z.p = floor(e / 2.0) + 1)"""


@query("fuzzy_merged", f"{_MERGED} select * exclude (s) from merged")
def _(spark, d):
    return merging.fuzzy_merge(_assigned(spark, d)).withColumn("merge_scale", F.round("merge_scale", 6)).drop("merge_mark")


@query(
    "fuzzy_merged_raw",
    f"""{_MERGED}, raws as (select leader, s, text, count(*) as k, max(i) as last from g group by all), most as (select leader, s, text from (select *, row_number() over (partition by leader, s order by k desc, last) as p from raws) where p = 1)
 select leader, most.text || case when merge_count > 1 then '(' || merge_count || ')' else '' end as text from merged join most using (leader, s)""",
)
def _(spark, d):
    return merging.fuzzy_merge(_assigned(spark, d), normalize_display=False).select("leader", "text")


@query("merge_all", f"{_MERGED}, o as (select * replace ({_SPOKEN} as text) from c where not (type between 1 and 5)) select leader, text, merge_count, merge_scale, merge_reason from merged union all select cid, text, 1, 1, 'orig' from o")
def _(spark, d):
    rows = comments(spark, d).withColumn("text", F.expr(_SPOKEN))
    merged = merging.merge_all(rows, ["source"], cascade=_CASCADE)
    return merged.select("leader", "text", "merge_count", F.round("merge_scale", 6).alias("merge_scale"), "merge_reason")


@query(
    "fuzzy_stats",
    f"""{_MERGED} select (select count(*) from walk) as total, count_if(true)::bigint as clusters, coalesce(sum(case when merge_count > 1 then merge_count end), 0)::bigint as merged, coalesce(max(case when merge_count > 1 then merge_count end), 0)::int as max_combo,
 (select count(*) from walk where reason = 'identical') as identical, (select count(*) from walk where reason = 'edit') as edit, (select count(*) from walk where reason = 'pinyin') as pinyin, (select count(*) from walk where reason = 'cosine') as cosine, count_if(merge_scale > 1.001)::bigint as enlarged,
 count_if(merge_scale < 0.999)::bigint as shrunk, count_if(leader % 7 = 0)::bigint as dropped from merged""",
)
def _(spark, d):
    a = _assigned(spark, d)
    return merging.merge_stats(a, merging.fuzzy_merge(a).withColumn("drop", F.col("leader") % 7 == 0))


@query(
    "weight_hist",
    f"""{_MERGED}, ws as (select range::int as w from range(12)), wn as (select least(greatest(merge_count, 1), 11) as w, count(*) as k from merged group by 1), sh as (select w, coalesce(k, 0) / (select count(*) from merged)::double as share from ws left join wn using (w))
 select w, round(share, 9) as share, round(case when w <= 10 then pow((share + lead(share) over (order by w)) / 2, 3) else share end, 9) as smoothed from sh""",
)
def _(spark, d):
    hist = merging.weight_histogram(merging.fuzzy_merge(_assigned(spark, d)))
    return hist.select("w", F.round("share", 9).alias("share"), F.round("smoothed", 9).alias("smoothed"))


#: Pairs of one source, as far apart as the published window.
_PAIRS = f"""with {_M}, n as (select cid, time, source, {_NORMED} as s, {_CHARS(_NORMED)} as ch, {_GRAMS(_NORMED)} as gr from m),
 p as (select a.cid as ca, b.cid as cb, a.s as s, b.s as z, a.ch as sc, b.ch as zc, a.gr as sg, b.gr as zg from n a join n b on b.source = a.source and (b.time, b.cid) > (a.time, a.cid) and b.time - a.time <= 30)"""


def _scored(spark, d, score, kind: str, out: str):
    rows = _mergeable(spark, d).select("cid", "time", "source", text.normalize(F.col("text")).alias("s"))
    return timeline.scored_pairs(rows, 30, "s", score, kind, stream=["source"], out=out).withColumnsRenamed({"a_cid": "ca", "b_cid": "cb"})


@query("similar_pairs", f"{_PAIRS} select ca, cb, reason from (select ca, cb, {_cascade_sql('s', 'z', 'sc', 'zc', 'sg', 'zg')} as reason from p) where reason is not null")
def _(spark, d):
    return _scored(spark, d, Cascade().reasons, "string", "reason")


@query("char_distance_pairs", f"{_PAIRS} select ca, cb, cast({_BAG('sc', 'zc')} as int) as dist from p")
def _(spark, d):
    return _scored(spark, d, lambda texts, i, j: pa.array(texts.char_distance(i, j), pa.int32()), "int", "dist")


@query("bigram_cos2_pairs", f"{_PAIRS} select ca, cb, cast({_COS('sg', 'zg')} as bigint) as sim from p")
def _(spark, d):
    return _scored(spark, d, lambda texts, i, j: pa.array(texts.bigram_score(i, j)), "bigint", "sim")


@query("density_onscreen", f"""with {_M}, v as (select cid, source, cast(floor(time * 1000 + 0.5) as bigint) as t, sqrt(length(text)) as v from m)
 select cid, round(sum(v) over (partition by source order by t range between 5000 preceding and current row) - (sum(v) over (partition by source, t) - sum(v) over (partition by source, t order by cid rows unbounded preceding)), 6) as onscreen from v""")
def _(spark, d):
    rows = _mergeable(spark, d).withColumn("t_ms", F.floor(F.col("time") * 1000 + 0.5).cast("bigint"))
    return merging.on_screen(rows, ["source"], merging.display_value(F.col("text"), F.lit(25.0))).select("cid", F.round("onscreen", 6).alias("onscreen"))


@query("density_shrink", f"""with {_M}, v as (select cid, source, cast(floor(time * 1000 + 0.5) as bigint) as t, sqrt(length(text)) as v from m),
 o as (select cid, sum(v) over (partition by source order by t range between 5000 preceding and current row) - (sum(v) over (partition by source, t) - sum(v) over (partition by source, t order by cid rows unbounded preceding)) as o from v)
 select cid, round(case when o > 6 and pow(o, 0.35) / pow(6, 0.35) > 1 then 1 / least(pow(o, 0.35) / pow(6, 0.35), 1.732) else 1 end, 6)::double as scale from o""")
def _(spark, d):
    rows = _mergeable(spark, d).withColumns({"t_ms": F.floor(F.col("time") * 1000 + 0.5).cast("bigint"), "merge_scale": F.lit(1.0)})
    return merging.density_shrink(rows, ["source"], 6).select("cid", F.round("merge_scale", 6).alias("scale"))


_DRAW = "((cid::hugeint * 11400714819323198485 + 7161677110969590809) % 18446744073709551616)::double / 18446744073709551616::double"


@query(
    "density_drop",
    f"""with recursive {_M}, v as (select cid, source, cast(floor(time * 1000 + 0.5) as bigint) as t, cast(floor(sqrt(length(text)) * 1048576 + 0.5) as bigint) as v, {_DRAW} as draw from m),
 l as (select *, case when t - lag(t) over (partition by source order by t, cid) <= 5000 then 0 else 1 end as new from v), q as (select *, sum(new) over (partition by source order by t, cid rows unbounded preceding) as s from l),
 r as (select *, row_number() over (partition by source, s order by t, cid) as rn from q),
 walk as (select source, s, rn, cid, false as gone, [{{'t': t, 'v': v}}] as live from r where rn = 1
  union all select source, s, rn, cid, gone, case when gone then live else list_append(live, {{'t': t, 'v': v}}) end
  from (select *, case when o > 6 then rate >= 1 or draw < rate else false end as gone from (select *, (o - 6) / 6 + 0.25 - 0.125 / 4 as rate from (select *, coalesce(list_sum(list_transform(live, lambda x: x.v)), 0)::double / 1048576 as o
   from (select r.*, list_filter(w.live, lambda x: r.t <= x.t + 5000) as live from walk w join r on r.source = w.source and r.s = w.s and r.rn = w.rn + 1)))))
 select cid, gone as drop from walk""",
)
def _(spark, d):
    rows = _mergeable(spark, d).withColumns({"t_ms": F.floor(F.col("time") * 1000 + 0.5).cast("bigint"), "merge_scale": F.lit(1.0), "merge_count": F.lit(1)})
    return merging.density_drop(rows, ["source"], 6).select("cid", "drop")


_CAP = f"""with recursive {_M}, {_EVENTS}, k as (select e.*, c.source from e join c using (cid)),
 x as (select *, case when start_time - lag(start_time) over (partition by source order by start_time, cid) <= 15 then 0 else 1 end as new from k),
 q as (select *, sum(new) over (partition by source order by start_time, cid rows unbounded preceding) as s from x),
 r as (select *, row_number() over (partition by source, s order by start_time, cid) as rn from q),
 walk as (select source, s, rn, [{{'e': end_time, 'n': 0 - rn, 'cid': cid}}] as win, []::bigint[] as gone from r where rn = 1
  union all select source, s, rn, case when len(live) < 2 then list_append(live, me) when top.e > me.e then list_append(list_filter(live, lambda o: o.cid <> top.cid), {{'e': me.e, 'n': top.n, 'cid': me.cid}}) else live end,
   case when len(live) < 2 then gone when top.e > me.e then [top.cid] else [me.cid] end
  from (select *, list_max(live) as top from (select r.source, r.s, r.rn, {{'e': r.end_time, 'n': 0 - r.rn, 'cid': r.cid}} as me, list_filter(w.win, lambda o: o.e > r.start_time) as live, []::bigint[] as gone
   from walk w join r on r.source = w.source and r.s = w.s and r.rn = w.rn + 1))),
 dropped as (select distinct unnest(gone) as cid from walk)
 select cid, cid not in (select cid from dropped) as kept from e"""


@query("screen_cap", _CAP)
def _(spark, d):
    return merging.screen_cap(_timed(spark, d).select("cid", "source", "type", "text", "start_time", "end_time"), ["source"], 2, 15).select("cid", "kept")


@query("trigger_dedup", f"""with recursive {_M}, r as (select cid, text, time, row_number() over (partition by text order by time, cid) as rn from m),
 walk as (select text, rn, cid, time as last, true as accepted from r where rn = 1
  union all select r.text, r.rn, r.cid, case when r.time - w.last >= 5 then r.time else w.last end, r.time - w.last >= 5 from walk w join r on r.text = w.text and r.rn = w.rn + 1) select cid, accepted from walk""")
def _(spark, d):
    return merging.trigger_dedup(_mergeable(spark, d), "text").select("cid", "accepted")


def _lanes(which: str, length: str, size: int, duration: int, blocks: str, mirrored: str = "false") -> str:
    """Walk along each stretch; the state has the rows on screen. The blocking ones in order of their top push a row down."""
    return f"""with recursive {_M}, {_EVENTS}, k as (select e.*, c.source, {length} as len, {mirrored} as up from e join c using (cid) where e.type in ({which})),
 g as (select *, case when start_time - lag(start_time) over (partition by source order by start_time, cid) <= {duration} then 0 else 1 end as new from k),
 q as (select *, sum(new) over (partition by source order by start_time, cid rows unbounded preceding) as s from g),
 r as (select *, (len + 1920) / {duration} as speed, row_number() over (partition by source, s order by start_time, cid) as rn from q),
 walk as (select source, s, 0::bigint as rn, null::bigint as cid, null::bigint as y, []::struct(a bigint, z bigint, e double, c double)[] as rows from (select distinct source, s from r)
  union all select source, s, rn, cid, case when top + {size} > 919 then null when up then 920 - top - {size} else top end, case when top + {size} > 919 then live else list_append(live, {{'a': case when up then 920 - top - {size} else top end, 'z': case when up then 920 - top else top + {size} end, 'e': start_time + {duration}, 'c': start_time + len / speed}}) end
  from (select *, list_reduce(list_prepend({{'a': 0::bigint, 'z': 1::bigint}}, list_sort(list_transform(list_filter(live, lambda p: {blocks}), lambda p: {{'a': case when up then 920 - p.z else p.a end, 'z': case when up then 920 - p.a else p.z end}}))), lambda x, p: {{'a': 0::bigint, 'z': case when p.a >= x.z + {size} then x.z else greatest(x.z, p.z) end}}).z as top
   from (select r.*, list_filter(w.rows, lambda p: p.e > r.start_time) as live from walk w join r on r.source = w.source and r.s = w.s and r.rn = w.rn + 1)))
 select cid, y::int as y from walk where cid is not null"""


@query("lane_rolling", _lanes("1", "length(e.text) / 2.0::double * 200", 200, 15, "start_time < greatest(p.c, p.e - 1920 / speed)"))
def _(spark, d):
    rows = _timed(spark, d).where("type = 1").withColumn("size", F.lit(200))
    return layout.lanes_rolling(layout.with_length(rows.select("cid", "source", "text", "start_time", "end_time", "size")), ["source"], 15).select("cid", "y")


@query("lane_fixed", _lanes("4, 5", "0::double", 300, 5, "true", "e.type = 4"))
def _(spark, d):
    rows = _timed(spark, d).where("type in (4, 5)").withColumn("size", F.lit(300))
    return layout.lanes_fixed(rows.select("cid", "source", "type", "start_time", "end_time", "size"), ["source"]).select("cid", "y")


# --- text ---------------------------------------------------------------------------------------------------------------------


@query("doc_normalized", rf"select doc_id, md5({_NORM.replace('text', 'l')}) as digest from (select doc_id, unnest(string_split(text, chr(10))) as l from documents)")
def _(spark, d):
    lines = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.select("doc_id", F.md5(F.encode(text.trim_ending(F.col("l")), "UTF-8")).alias("digest"))


@query("doc_exact_dups", f"select md5({_NORM}) as digest, count(*) as n from documents where text is not null group by 1 having count(*) > 1")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    return docs.groupBy(F.md5(F.encode(text.trim_ending(F.col("text")), "UTF-8")).alias("digest")).agg(F.count("*").alias("n")).where("n > 1")


_WIDE = "(2 * length({0}) - length(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g')))"


@query("display_width", f"select doc_id, {_WIDE.format('text')}::double as width from documents where text is not null")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", text.display_width(F.col("text")).alias("width"))


@query("entity_unescape", "select page_id, md5(replace(replace(replace(replace(replace(html, '&quot;', '\"'), '&apos;', ''''), '&gt;', '>'), '&lt;', '<'), '&amp;', '&')) as digest from pages where html is not null")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").where("html is not null").select("page_id", F.md5(F.encode(text.unescape_xml(F.col("html")), "UTF-8")).alias("digest"))


@query("color_codes", f"with c as ({DUCK}) select cid, '&H' || substr(lpad(upper(to_hex(color)), 6, '0'), 5, 2) || substr(lpad(upper(to_hex(color)), 6, '0'), 3, 2) || substr(lpad(upper(to_hex(color)), 6, '0'), 1, 2) || '&' as bgr, round({_DIST.replace('a >>', 'color >>').replace('(a &', '(color &').replace('b', '16777215').replace('su16777215', 'sub')}, 6) as dist from c")
def _(spark, d):
    return comments(spark, d).select("cid", text.bgr_tag(F.col("color")).alias("bgr"), F.round(text.colour_distance(F.col("color"), F.lit(16777215)), 6).alias("dist"))


@query("time_format", f"with c as ({DUCK}) select cid, format('{{:d}}:{{:02d}}:{{:02d}}.{{:02d}}', (floor(time)::bigint // 3600), (floor(time)::bigint % 3600 // 60), floor(time)::bigint % 60, floor((time - floor(time)) * 100)::bigint) as hms, floor(time)::double as secs from c")
def _(spark, d):
    hms = text.clock(F.col("time"))
    return comments(spark, d).select("cid", hms.alias("hms"), F.floor(text.clock_seconds(hms)).cast("double").alias("secs"))


@query("url_fields", r"select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, regexp_replace(url, '\?.*$', '') as bare, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)$', 1) as last_segment from pages where url is not null")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").where("url is not null")
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), text.without_query(F.col("url")).alias("bare"), F.regexp_extract(bare, r"([^/]+)$", 1).alias("last_segment"))


@query("enlarge_scale", "select n, round(case when n <= 5 then 1 else greatest(least(ln(n) / ln(5), 2), 1) end, 6)::double as scale from (select range + 1 as n from range(40))")
def _(spark, d):
    return spark.range(1, 41).select(F.col("id").alias("n"), F.round(text.enlarge(F.col("id")), 6).alias("scale"))


@query("font_size", "select n, least(100, 50 + floor(8 * ln(n) + 0.5))::bigint as size from (select range + 1 as n from range(2000))")
def _(spark, d):
    return spark.range(1, 2001).select(F.col("id").alias("n"), text.merged_font_size(50, F.col("id")).cast("bigint").alias("size"))


# --- titles and tables --------------------------------------------------------------------------------------------------------------


@query("mru_history", "select cast(user_id as varchar) as keyword, max(epoch_us(ts)) as last from events group by 1 order by 2 desc, 1 limit 15")
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("keyword"), F.expr("unix_micros(cast(ts as timestamp))").alias("last"))
    return tables.recent(events, 15, time="last")


@query("stage_split", f"with c as ({DUCK}) select cid, case when source = 's2' then 'settled' else 'pending' end as bucket from c")
def _(spark, d):
    return tables.split_stage(comments(spark, d), spark.sql(_SOURCES)).select("cid", "bucket")


@query("systematic_sample", f"with c as ({DUCK}), n as (select cid, row_number() over (order by cid) - 1 as pos from c), s as (select greatest(1, ceil(count(*) * 7 / 10000.0)) as step from n) select cid from n, s where pos % step = 0")
def _(spark, d):
    rows = comments(spark, d).select("cid")
    least = rows.agg(F.min("cid")).first()[0]
    # the derived ids are consecutive, so a position needs no global sort
    return tables.systematic(rows.withColumn("pos", F.col("cid") - least), 7).select("cid")


@query("segment_plan", "select vid, unnest(range(0, greatest(1, floor(secs * 1000)::bigint), 60000)) as seg_start from (values ('a', 150.5), ('b', 0.0), ('c', 3725.0), ('d', 65.0)) t(vid, secs)")
def _(spark, d):
    rows = spark.sql("select * from (values ('a', '150.5'), ('b', 'x'), ('c', '1:02:05'), ('d', '1:05')) as t(vid, s)")
    return rows.select("vid", F.explode(tables.segment_starts(text.length_seconds(F.col("s")))).alias("seg_start"))


@query("hashes", "select doc_id, md5(text) as md5, sha256(text) as sha256, to_base64(encode(text)) as b64 from documents where text is not null")
def _(spark, d):
    t = F.encode("text", "UTF-8")
    return spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", F.md5(t).alias("md5"), F.sha2(t, 256).alias("sha256"), addresses.base64(t).alias("b64"))


@query("fingerprints")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    return docs.select("doc_id", addresses.times33(F.encode("text", "UTF-8")).alias("fingerprint"))


@query("aes_round_trip", "select doc_id, md5(text) as digest from documents where text is not null")
def _(spark, d):
    key, iv = F.encode(F.lit("0123456789abcdef"), "UTF-8"), F.encode(F.lit("fedcba9876543210"), "UTF-8")
    data = F.encode("text", "UTF-8")
    there = addresses.aes_encrypt(addresses.aes_encrypt(data, key), key, "CBC", iv)
    back = addresses.aes_decrypt(addresses.aes_decrypt(there, key, "CBC", iv), key)
    return spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", F.md5(back).alias("digest"))


_PENDING = _TOLERANCE.replace("select * from c where type between 1 and 5", "select * from c where type between 1 and 5 and source <> 's2'")


@query("stage_rejoin", f"select cid, out_text as text, merge_count from ({_PENDING}) union all select cid, text, 1 from ({DUCK}) where type between 1 and 5 and source = 's2'")
def _(spark, d):
    split = tables.split_stage(_mergeable(spark, d), spark.sql(_SOURCES))
    settled = split.where("bucket = 'settled'").select("cid", "text", F.lit(1).alias("merge_count"))
    merged = merging.tolerance_merge(split.where("bucket = 'pending'"), 5).select("cid", F.col("out_text").alias("text"), "merge_count")
    return tables.rejoin(settled, merged)


# --- payloads -----------------------------------------------------------------------------------------------------------------------


def _packed(spark, d, shape: str) -> DataFrame:
    """The comments of each source and ten minutes as one payload."""
    rows = comments(spark, d).withColumn("slice", F.floor(F.col("time") / 600))
    t = text.plain_number(F.col("time"))
    keys = ["source", "slice"]
    if shape == "xml":
        line = export.xml_line(F.col("time"), F.col("type"), F.lit(25), F.col("color"), F.col("text"))
        return rows.groupBy(*keys).agg(F.concat(F.lit(export.HEADER), F.array_join(F.collect_list(line), "\n"), F.lit("</i>")).alias("payload"))
    if shape == "c":
        made = F.struct(F.concat_ws(",", t, F.col("color").cast("string"), F.col("type").cast("string"), F.lit("25"), F.lit("")).alias("c"), F.col("text").alias("m"))
        return rows.groupBy(*keys).agg(F.concat(F.lit("\ufeff"), F.to_json(F.collect_list(made))).alias("payload"))
    made = F.struct(F.concat_ws(",", t, F.col("type").cast("string"), F.col("color").cast("string")).alias("p"), F.col("text").alias("m"), F.lit(1.5).alias("shift"))
    return rows.groupBy(*keys).agg(F.to_json(F.struct(F.collect_list(made).alias("comments"))).alias("payload"))


@query("parse_json_c", f"with c as ({DUCK}) select source, time, type, 25 as size, color, text from c")
def _(spark, d):
    return payloads.c_comments(_packed(spark, d, "c"), keep=("source",)).drop("pos")


@query("parse_api_p", f"with c as ({DUCK}) select source, round(time + 1.5, 6) as time, type, 25 as size, color, text from c")
def _(spark, d):
    return payloads.p_comments(_packed(spark, d, "p"), keep=("source",)).drop("pos").withColumn("time", F.round("time", 6))


@query("parse_xml", f"with c as ({DUCK}) select source, time, type, 25 as size, color, text from c")
def _(spark, d):
    return payloads.xml_comments(_packed(spark, d, "xml"), keep=("source",)).drop("pos")


_LINE = "'<d p=\"' || (case when time = floor(time) then cast(cast(time as bigint) as varchar) else cast(time as varchar) end) || ',' || type || ',25,' || color || '\">' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') || '</d>'"


@query("export_raw", f"with c as ({DUCK}) select cid, {_LINE} as line from c")
def _(spark, d):
    return export.xml_lines(comments(spark, d), by_time=False)


@query("export_filtered", f"with c as ({DUCK}) select row_number() over (order by time, source, cid) as ord, {_LINE} as line from c where {_HIT} is null")
def _(spark, d):
    numbered = timeline.ordered(timeline.drop_ruled(comments(spark, d), RULES))
    return numbered.select(F.col("ord").cast("bigint").alias("ord"), export.xml_line(F.col("time"), F.col("type"), F.lit(25), F.col("color"), F.col("text")).alias("line"))


@query("export_merged", f"{_MERGED} select row_number() over (order by time, merge_count desc, leader) as ord, {_LINE} as line from merged")
def _(spark, d):
    merged = merging.fuzzy_merge(_assigned(spark, d))
    # equal times are in order of falling counts
    numbered = timeline.ordered(merged.withColumns({"source": -F.col("merge_count"), "cid": F.col("leader")}))
    return numbered.select(F.col("ord").cast("bigint").alias("ord"), export.xml_line(F.col("time"), F.col("type"), F.lit(25), F.col("color"), F.col("text")).alias("line"))


@query("history_document", "select json_group_object(k, v) as document from (select keyword as k, {'last': last} as v from (select cast(user_id as varchar) as keyword, max(epoch_us(ts)) as last from events group by 1 order by 2 desc, 1 limit 15) order by keyword)")
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("keyword"), F.expr("unix_micros(cast(ts as timestamp))").alias("last"))
    return export.history_document(tables.recent(events, 15, time="last"), "keyword")


# --- built-in operators, offered for completeness ------------------------------------------------------------------------------------


@query("builtin_rollup", "select l_returnflag, l_linestatus, sum(l_quantity)::double as qty, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def _(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("qty"), F.count("*").alias("n"))


@query("builtin_set_ops", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
def _(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("k")).intersect(spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("k")))


@query("builtin_join_agg", "select n_name, count(*) as orders from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def _(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("orders"))
