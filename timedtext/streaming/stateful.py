"""Stateful operators over streams.

Rows wait in state until the watermark passes them and are then taken in order of (time, cid), so results do not depend
on arrival; what a cluster or an anchor needs later is kept small: the time, the id and the text of its first row.
Rows older than the watermark are dropped by Spark; ``counted`` reports how many rows a query saw.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timedtext.functions.similarity import Cascade
from timedtext.functions.text import normalize

_STATE = "waiting string, open string"


def _in_order(rows: DataFrame, key: str, at: str, delay: str, schema: str, step) -> DataFrame:
    """Group a stream by ``key``; ``step(open, row) -> output tuple or None`` sees the rows in order of (ms, cid)."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, opened = ([], []) if not state.exists else map(json.loads, state.get)
        for pdf in batches:
            waiting += pdf[["ms", "cid", "text", "type"]].values.tolist()
        mark = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda r: (r[0], r[1]))
        ready = [r for r in waiting if r[0] < mark]
        waiting = waiting[len(ready) :]
        out = []
        for ms, cid, text, kind in ready:
            made = step(opened, int(ms), int(cid), text, int(kind))
            if made is not None:
                out.append((name[0], *made))
        if waiting:
            state.update((json.dumps([[int(a), int(b), c, int(d)] for a, b, c, d in waiting]), json.dumps(opened)))
            state.setTimeoutTimestamp(max(int(waiting[0][0]), mark) + 1)
        elif opened:
            state.update((json.dumps([]), json.dumps(opened)))
            state.setTimeoutTimestamp(mark + step.keep_ms + 1)
            if state.hasTimedOut:
                state.remove()
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=step.columns)

    prepared = rows.withWatermark(at, delay).withColumn("ms", F.expr(f"unix_millis(cast({at} as timestamp))"))
    return prepared.groupBy(key).applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


class _Fuzzy:
    def __init__(self, threshold: float, cascade: Cascade, key: str):
        self.keep_ms, self.match, self.columns = int(threshold * 1000), cascade.matcher(), [key, "cid", "leader", "reason"]

    def __call__(self, opened, ms, cid, text, kind):
        while opened and ms - opened[0][0] > self.keep_ms:
            opened.pop(0)
        for _, leader, theirs, their_kind in reversed(opened):
            if reason := self.match(text, kind, theirs, their_kind):
                return cid, leader, reason
        opened.append([ms, cid, text, kind])
        return cid, cid, "orig"


class _Dedup:
    def __init__(self, gap: float, key: str):
        self.keep_ms, self.columns = int(gap * 1000), [key, "cid", "accepted"]

    def __call__(self, opened, ms, cid, text, kind):
        accepted = not opened or ms - opened[0][0] >= self.keep_ms
        if accepted:
            opened[:] = [[ms]]
        return cid, accepted


class _Tolerance:
    """Within one key: (cid, anchor) for every row; the anchor is the first row of its run."""

    def __init__(self, threshold: float, key: str):
        self.keep_ms, self.columns = int(threshold * 1000), [key, "cid", "anchor"]

    def __call__(self, opened, ms, cid, text, kind):
        if not opened or ms - opened[0][0] > self.keep_ms:
            opened[:] = [[ms, cid]]
        return cid, opened[0][1]


def fuzzy_assign(rows: DataFrame, key: str, at: str = "ts", delay: str = "10 seconds", threshold: float = 30, cascade: Cascade = Cascade()) -> DataFrame:  # noqa: B008
    """Leader clustering of a stream; each row comes out once, with its leader, when the watermark has passed it."""
    return _in_order(rows.withColumn("text", normalize(F.col("text"))), key, at, delay, f"{key} string, cid long, leader long, reason string", _Fuzzy(threshold, cascade, key))


def trigger_dedup(rows: DataFrame, key: str, at: str = "ts", delay: str = "10 seconds", gap: float = 5) -> DataFrame:
    return _in_order(rows, key, at, delay, f"{key} string, cid long, accepted boolean", _Dedup(gap, key))


def tolerance_merge(rows: DataFrame, key: str, at: str = "ts", delay: str = "10 seconds", threshold: float = 5) -> DataFrame:
    return _in_order(rows, key, at, delay, f"{key} string, cid long, anchor long", _Tolerance(threshold, key))


class _OnScreen:
    """Within one key: (cid, value on screen) for every row, its own and that of rows up to the span before it."""

    def __init__(self, span_ms: int, key: str):
        self.keep_ms, self.columns = span_ms, [key, "cid", "onscreen"]

    def __call__(self, opened, ms, cid, text, kind):
        while opened and ms - opened[0][0] > self.keep_ms:
            opened.pop(0)
        opened.append([ms, len(text) ** 0.5])
        return cid, sum(v for _, v in opened)


def on_screen(rows: DataFrame, key: str, at: str = "ts", delay: str = "10 seconds", span_ms: int = 5000) -> DataFrame:
    """The exact value on screen after each row of a stream, as the batch operator has it at font size 25."""
    return _in_order(rows, key, at, delay, f"{key} string, cid long, onscreen double", _OnScreen(span_ms, key))


def late_rows(query) -> int:
    """How many rows of a running query came after the watermark had passed them and were dropped."""
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"])


def density(rows: DataFrame, at: str = "ts", delay: str = "10 seconds", span: str = "5 seconds", slide: str = "1 second") -> DataFrame:
    """Rows and text on screen by sliding window."""
    return rows.withWatermark(at, delay).groupBy(F.window(at, span, slide)).agg(F.count("*").alias("n"), F.sum(F.sqrt(F.char_length("text"))).alias("value"))


def session_counts(rows: DataFrame, key: str, at: str = "ts", delay: str = "10 seconds", gap: str = "5 seconds") -> DataFrame:
    return rows.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))


def counted(rows: DataFrame, name: str = "rows_in") -> tuple[DataFrame, Observation]:
    """The rows, and an observation of how many there were."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("n")), seen
