"""Placing comments on a screen: lanes for rolling rows, stacks for fixed ones, and the drawn text."""

from __future__ import annotations

from bisect import insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedtext.functions.text import ass_escape, bgr_tag, display_width
from timedtext.operators.merging import _fold

SCREEN_X, SCREEN_Y = 1920, 1080


def timed(comments: DataFrame, scroll: float = 15, fixed: float = 5) -> DataFrame:
    """Adds start_time and end_time; rows of other types than 1 to 5 go. Type 1 starts at whole seconds."""
    start = F.when(F.col("type") == 1, F.floor(F.col("time") + 0.5).cast("double")).otherwise(F.col("time"))
    return comments.where(F.col("type").between(1, 5)).withColumn("start_time", start).withColumn("end_time", F.col("start_time") + F.when(F.col("type") <= 3, F.lit(float(scroll))).otherwise(F.lit(float(fixed))))


class Screen:
    """Rows on the screen in order of their top edge: (top, first line below, time it ends, time from which a slow row may
    follow it). Lines are counted from the edge that rows are stacked from."""

    def __init__(self, height: int):
        self.height = height
        self.rows: list[tuple[int, int, float, float]] = []

    def put(self, now: float, size: int, end: float, clear: float, blocks) -> int | None:
        """Put a row into the first gap of ``size`` lines between the rows that block it; its top line, or None."""
        self.rows = [r for r in self.rows if r[2] > now]
        top = 1
        for other in self.rows:
            if other[0] >= top + size:
                break
            if other[1] > top and blocks(other):
                top = other[1]
        if top + size > self.height + 1:
            return None
        insort(self.rows, (top, top + size, end, clear))
        return top

    def upside_down(self) -> None:
        """Count lines from the other edge."""
        self.rows = sorted((self.height + 2 - below, self.height + 2 - top, end, clear) for top, below, end, clear in self.rows)


def roll(screen: Screen, start: float, length: float, size: int, duration: float) -> int | None:
    """Place a row that crosses the screen. It may enter behind another one when that one's tail is inside, and when it
    reaches the far edge, ``SCREEN_X / speed`` after its start, no earlier than the other one has left. For a row no faster
    than the other the second follows from the first."""
    speed = (length + SCREEN_X) / duration
    crossing = SCREEN_X / speed
    return screen.put(start, size, start + duration, start + length / speed, lambda other: start < max(other[3], other[2] - crossing))


def stack(screen: Screen, start: float, size: int, duration: float, upward: bool) -> int | None:
    """Place a row that stands still, from the top or from the bottom; any row in its way blocks it."""
    if not upward:
        return screen.put(start, size, start + duration, 0.0, lambda other: True)
    screen.upside_down()
    from_below = screen.put(start, size, start + duration, 0.0, lambda other: True)
    screen.upside_down()
    return None if from_below is None else screen.height + 2 - from_below - size


def lanes_rolling(events: DataFrame, stream: list[str], duration: float = 15, height: int = 918) -> DataFrame:
    """Adds ``y`` to rolling rows (start_time, length, size), null where no lane is free."""
    step = lambda s, start, length, size: roll(s, start, length, size, duration)
    return _fold(events, stream, duration, "start_time", lambda: Screen(height), step, "y", "int", ["start_time", "length", "size"])


def lanes_fixed(events: DataFrame, stream: list[str], duration: float = 5, height: int = 918) -> DataFrame:
    """Adds ``y`` to fixed rows (start_time, type, size): type 5 from the top, type 4 from the bottom, in one stack."""
    step = lambda s, start, kind, size: stack(s, start, size, duration, kind == 4)
    return _fold(events, stream, duration, "start_time", lambda: Screen(height), step, "y", "int", ["start_time", "type", "size"])


def font_size(base: int, scale: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(base) * scale + 0.5)).cast("int")


def with_length(events: DataFrame, size: str = "size") -> DataFrame:
    return events.withColumn("length", display_width(F.col("text"), F.col(size)))


def drawn(text: Column, colour: Column, y: Column, length: Column, rolling: Column) -> Column:
    """The row's drawing text: movement or place, colour, escaped text."""
    half = F.floor(length / 2).cast("bigint")
    move = F.format_string("{\\move(%d, %d, %d, %d)}", F.lit(SCREEN_X) + half, y, -half, y)
    place = F.format_string("{\\pos(%d, %d)}", F.lit(SCREEN_X // 2), y)
    return F.concat(F.when(rolling, move).otherwise(place), F.lit("{\\c"), bgr_tag(colour), F.lit("}"), ass_escape(text))
