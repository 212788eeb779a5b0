"""Operators along a stream's time: delays, rules, order, positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedtext.functions.luapattern import BadPattern, to_java
from timedtext.functions.similarity import Texts

SEGMENT = "struct<start:double,delay:double>"


def delay_at(segments: Column, time: Column, inclusive: bool = False) -> Column:
    """The sum of the delays whose segment starts before ``time``."""
    before = (lambda s: s["start"] <= time) if inclusive else (lambda s: s["start"] < time)
    return F.aggregate(F.filter(F.coalesce(segments, F.array().cast(f"array<{SEGMENT}>")), before), F.lit(0.0), lambda a, s: a + F.coalesce(s["delay"], F.lit(0.0)))


def apply_delays(comments: DataFrame, sources: DataFrame) -> DataFrame:
    """Shift each comment by its source's delays; rows of blocked or unknown sources go. The sources are joined by
    key; the optimizer broadcasts them when their measured size allows."""
    open_ = sources.where(~F.coalesce("blocked", F.lit(False))).select("source", "delay_segments", *(c for c in ("stage",) if c in sources.columns))
    joined = comments.join(open_, "source")
    orig = F.coalesce("orig_time", "time") if "orig_time" in comments.columns else F.col("time")
    return joined.withColumns({"orig_time": orig, "time": orig + delay_at(F.col("delay_segments"), orig)}).drop("delay_segments")


def combine_segments(segments: Column, near: float = 10, apart: float = 30, eps: float = 1e-6) -> Column:
    """Neighbouring segments at most ``near`` apart are added up in pairs, then each result goes into the first kept one
    at most ``apart`` away; sums of zero vanish."""
    item = lambda s, d: F.struct(s.alias("start"), d.alias("delay"))
    empty = F.array().cast(f"array<{SEGMENT}>")
    none = F.lit(None).cast(SEGMENT)

    def keep(out, s):
        return F.when(s.isNotNull() & (F.abs(s["delay"]) > eps), F.concat(out, F.array(s))).otherwise(out)

    # a segment waits until the next one shows whether they pair
    def pair(a, s):
        w = a["wait"]
        joins = w.isNotNull() & (s["start"] - w["start"] <= near)
        return F.when(joins, F.struct(keep(a["out"], item(w["start"], w["delay"] + s["delay"])).alias("out"), none.alias("wait"))).otherwise(
            F.struct(keep(a["out"], w).alias("out"), item(s["start"], s["delay"]).alias("wait"))
        )

    paired = F.aggregate(F.array_sort(segments), F.struct(empty.alias("out"), none.alias("wait")), pair, lambda a: keep(a["out"], a["wait"]))

    def fold(out, s):
        at = F.array_position(F.transform(out, lambda m: F.abs(s["start"] - m["start"]) <= apart), F.lit(True))
        added = F.transform(out, lambda m, i: F.when(i == at - 1, item(m["start"], m["delay"] + s["delay"])).otherwise(m))
        return F.when(at > 0, F.filter(added, lambda m, i: ~((i == at - 1) & (F.abs(m["delay"]) <= eps)))).otherwise(keep(out, s))

    return F.array_sort(F.aggregate(paired, empty, fold))


def compile_rules(patterns: list[str]) -> list[tuple[str, str]]:
    """(pattern, regular expression) of the rules that are valid, in order."""
    out = []
    for p in patterns:
        try:
            out.append((p, to_java(p)))
        except BadPattern:
            continue
    return out


def first_rule(text: Column, patterns: list[str]) -> Column:
    """The first rule that matches, or null."""
    found = F.lit(None).cast("string")
    for pattern, regex in reversed(compile_rules(patterns)):
        found = F.when(text.rlike(regex), pattern).otherwise(found)
    return found


def drop_ruled(comments: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """The comments that no rule matches."""
    regexes = [r for _, r in compile_rules(patterns)]
    if not regexes:
        return comments
    hit = F.col(text).rlike("|".join(f"(?:{r})" for r in regexes)) if not any("\\1" in r for r in regexes) else first_rule(F.col(text), patterns).isNotNull()
    return comments.where(~F.coalesce(hit, F.lit(False)))


#: A slice of a stream's time is so many times the pause or span an operator looks at.
SLICE = 64


def slice_of(time: Column, span: float) -> Column:
    """The number of the time slice of about ``SLICE`` spans that ``time`` lies in."""
    return F.floor(time / F.lit(float(SLICE * span) if span > 0 else float(SLICE)))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of all keys, nulls included."""
    return reduce(lambda x, k: x & a[k].eqNullSafe(b[f"__{k}"]), keys, F.lit(True))


def _with_sums(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the further columns of ``sums``, a table with one row for each of their keys."""
    named = sums.withColumnsRenamed({k: f"__{k}" for k in keys})
    return rows.join(named, _same(rows, named, keys)).drop(*(f"__{k}" for k in keys))


def ordered(comments: DataFrame, stream: list[str] | None = None, out: str = "ord", span: float = 10) -> DataFrame:
    """Number the rows of each stream, or all rows, by (time, source, cid). Slices of the time are numbered by themselves
    and shifted by the rows before them, so no task sees a whole stream."""
    keys = [*(stream or []), "__slice"]
    rows = comments.withColumn("__slice", slice_of(F.col("time"), span))
    before = Window.partitionBy(*keys[:-1]).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))  # a row for each slice
    starts = sizes.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy("time", "source", "cid")))
    return _with_sums(numbered, starts, keys).withColumn(out, F.col("__start") + F.col("__at")).drop("__start", "__at", "__slice")


def sessions(rows: DataFrame, gap: float, keys: list[str], time: str = "time", order: list[str] | None = None, out: str = "session") -> DataFrame:
    """Number the stretches of each key that have no pause over ``gap``. Each time slice of a key is looked at by itself;
    its first stretch may go on from the slice before, which a table of slices tells."""
    by = [*keys, "__slice"]
    w = Window.partitionBy(*by).orderBy(time, *(order or []))
    new = F.when(F.col(time) - F.lag(time).over(w) <= gap, 0).otherwise(1)
    cut = rows.withColumn("__slice", slice_of(F.col(time), gap)).withColumn("__new", new)
    local = cut.withColumn("__local", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = cut.groupBy(*by).agg(F.sum("__new").alias("__n"), F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    along = Window.partitionBy(*keys).orderBy("__slice")
    goes_on = F.when(F.col("__lo") - F.lag("__hi").over(along) <= gap, 1).otherwise(0)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    starts = ends.withColumn("__on", goes_on).select(*by, (F.sum("__n").over(upto) - F.col("__n") - F.sum("__on").over(upto)).alias("__start"))
    return _with_sums(local, starts, by).withColumn(out, F.col("__start") + F.col("__local")).drop("__start", "__local", "__new", "__slice")


def active_at(events: DataFrame, positions: DataFrame, longest: float) -> DataFrame:
    """The events on screen at each position: started at most ``longest`` before it and not ended. Both sides meet in
    buckets of that length, each pair in exactly one."""
    bucketed = events.withColumn("__b", F.floor(F.col("start_time") / longest))
    asked = positions.withColumn("__b", F.explode(F.array(F.floor(F.col("pos") / longest), F.floor(F.col("pos") / longest) - 1)))
    met = asked.join(bucketed, "__b").where((F.col("start_time") <= F.col("pos")) & (F.col("start_time") >= F.col("pos") - longest) & (F.col("end_time") >= F.col("pos")))
    return met.drop("__b")


def browse(events: DataFrame, duration: float, pos: float) -> DataFrame:
    """The rows a list of all comments shows: with a text that is no drawing, started within the stream; ``active`` are
    those on screen at ``pos``. The text shown has no blanks around it."""
    shown = F.regexp_replace(F.regexp_replace("text", r"\Am\s[mbl\s\-0-9.]+\z", ""), r"\A\s+|\s+\z", "")
    rows = events.withColumn("text", shown).where((F.col("text") != "") & F.col("start_time").between(0, duration))
    return rows.withColumn("active", (F.col("start_time") <= pos) & (F.col("end_time") >= pos))


def contains_any(text: Column, patterns: list[str]) -> Column:
    return first_rule(text, patterns).isNotNull()


def visible(y: Column, height: float) -> Column:
    """Whether a row's place is on the visible part of the screen."""
    return F.coalesce(y <= height, F.lit(False))


def x_at(x1: Column, x2: Column, start: Column, end: Column, pos: Column) -> Column:
    return x1 + (x2 - x1) * (pos - start) / (end - start)


def near_pairs(rows: DataFrame, seconds: float, time: str = "time", key: str = "cid", stream: list[str] | None = None) -> DataFrame:
    """Pairs (a, b) of rows of one stream, a first by (time, id), at most ``seconds`` apart; each meets in one pair of
    buckets. The pairs are the result: their number grows with the rows within ``seconds`` of each other."""
    a = rows.select(*(F.col(c).alias(f"a_{c}") for c in rows.columns)).withColumn("__b", F.explode(F.array(F.floor(F.col(f"a_{time}") / seconds), F.floor(F.col(f"a_{time}") / seconds) + 1)))
    b = rows.select(*(F.col(c).alias(f"b_{c}") for c in rows.columns)).withColumn("__b", F.floor(F.col(f"b_{time}") / seconds))
    later = (F.col(f"b_{time}") > F.col(f"a_{time}")) | ((F.col(f"b_{time}") == F.col(f"a_{time}")) & (F.col(f"b_{key}") > F.col(f"a_{key}")))
    met = reduce(lambda x, k: x & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")), stream or [], a["__b"] == b["__b"])
    return a.join(b, met).where(later & (F.col(f"b_{time}") - F.col(f"a_{time}") <= seconds)).drop("__b")


#: Of ``scored_pairs``: a time slice in windows; rows of a slice that one group pairs with later ones; pairs made at once.
WINDOWS, GROUP, PAIRS = 8, 20_000, 1 << 18


def scored_pairs(
    rows: DataFrame, seconds: float, text: str, score: Callable[[Texts, np.ndarray, np.ndarray], pa.Array], kind: str, time: str = "time", key: str = "cid", stream: list[str] | None = None, out: str = "score"
) -> DataFrame:
    """The pairs of ``near_pairs`` as ``a_<key>``, ``b_<key>`` and what ``score(texts, i, j)`` says of the texts at places
    i and j; pairs of which it says null go. The key is a whole number.

    Rows pass once, in order, through one Python process for a slice of a stream's time, each shown to the slice before
    too if a row there may lie near. Pairs are made as arrays, and texts are scored once for each two that meet in a batch.
    A crowded slice is dealt to several groups: each holds a part of the rows that come first and all that may follow."""
    keys, span = stream or [], float(WINDOWS * seconds) if seconds > 0 else 1.0
    slice_at = lambda t: F.floor(t / F.lit(span))
    at = F.col(time).cast("double")
    held = rows.select(*keys, at.alias("__t"), F.col(key).cast("bigint").alias("__key"), F.coalesce(text, F.lit("")).alias("__text"))
    # what is not finite is near nothing
    held = held.where(F.col("__t").between(-1.7e308, 1.7e308)).withColumn("__home", slice_at(F.col("__t")))
    parts = held.groupBy(*keys, F.col("__home").alias("__slice")).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("__parts"))
    shown = held.withColumn("__slice", F.explode(F.array_distinct(F.array("__home", slice_at(F.col("__t") - 2 * seconds)))))
    dealt = _with_sums(shown, parts, [*keys, "__slice"]).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    first = (F.col("__home") == F.col("__slice")) & (F.pmod(F.xxhash64("__key"), F.col("__parts")) == F.col("__part"))
    by = [*keys, "__slice", "__part"]
    n = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = dealt.select(*by, "__t", "__key", "__text", (F.col("__t") - F.col("__slice") * F.lit(span)).alias("__in"), first.alias("__first"))
    names = [f"a_{key}", f"b_{key}", out]
    # candidates are found within a little more than the window, each is then compared exactly
    reach, apart = seconds * (1 + 1e-6) + 1e-6 * span, 2 * span

    def pairs(table: pa.Table, old: int) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(np.concatenate([[False], reduce(np.logical_or, (_changes(table[c]) for c in by))]))
        t, ids, along = table["__t"].to_numpy(), table["__key"].to_numpy(), table["__in"].to_numpy() + group * apart
        coded = table["__text"].combine_chunks().dictionary_encode()
        code, texts = coded.indices.to_numpy().astype(np.int64), Texts(coded.dictionary.to_pylist())
        ahead = table["__first"].to_numpy()
        places = np.flatnonzero(ahead)
        upto = np.cumsum(ahead) - ahead
        since = np.minimum(np.searchsorted(along[places], along - reach), upto)
        since[:old] = upto[:old]
        total = np.concatenate([[0], np.cumsum(upto - since)])
        for lo in range(0, int(total[-1]), PAIRS):
            nth = np.arange(lo, min(lo + PAIRS, int(total[-1])))
            b = np.searchsorted(total, nth, side="right") - 1
            a = places[since[b] + nth - total[b]]
            met = (t[b] - t[a] <= seconds) & ((t[b] > t[a]) | (ids[b] > ids[a]))
            a, b = a[met], b[met]
            if len(a):
                said = texts.once(code[a], code[b], score)
                batch = pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), said], names=names)
                yield batch.filter(said.is_valid()) if said.null_count else batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if live is None else pa.concat_tables([live, pa.Table.from_batches([batch])])
            yield from pairs(table, 0 if live is None else live.num_rows)
            # rows that may still meet later ones: of the last row's group, within the window before it
            last = table.slice(table.num_rows - 1)
            same = reduce(pc.and_, (pc.equal(table[c], last[c][0]) if last[c][0].is_valid else pc.is_null(table[c]) for c in by))
            near = pc.greater_equal(table["__in"], last["__in"][0].as_py() - reach)
            live = table.filter(pc.and_(pc.and_(pc.fill_null(same, False), near), table["__first"]))

    return placed.repartition(n, *by).sortWithinPartitions(*by, "__t", "__key").mapInArrow(run, f"`{names[0]}` bigint, `{names[1]}` bigint, `{out}` {kind}")


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Where a value differs from the one before it, nulls being equal."""
    n = len(column)
    before, after = column.slice(0, n - 1), column.slice(1)
    other = pc.fill_null(pc.not_equal(before, after), False).to_numpy()
    return other | (before.is_null().to_numpy() != after.is_null().to_numpy())
