"""Distances between short texts as column expressions, and the same on plain strings for ordered folds and on arrays of
texts for pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from timedtext.functions.text import chars


def _count(items: Column, x: Column) -> Column:
    return F.size(F.filter(items, lambda y: y == x))


def bag_distance(a: Column, b: Column) -> Column:
    """L1 distance of two bags of items."""
    return F.aggregate(F.array_distinct(F.concat(a, b)), F.lit(0), lambda acc, x: acc + F.abs(_count(a, x) - _count(b, x)))


def char_distance(a: Column, b: Column) -> Column:
    return bag_distance(chars(a), chars(b))


def bigrams(text: Column) -> Column:
    n = F.char_length(text)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def bigram_score(a: Column, b: Column) -> Column:
    """floor(100 * dot^2 / (|a|^2 * |b|^2)) of bigram counts; 0 if either has none."""
    ga, gb = bigrams(a), bigrams(b)
    square = lambda g: F.aggregate(F.array_distinct(g), F.lit(0.0), lambda acc, x: acc + _count(g, x) * _count(g, x))
    dot = F.aggregate(F.array_distinct(ga), F.lit(0.0), lambda acc, x: acc + _count(ga, x) * _count(gb, x))
    na, nb = square(ga), square(gb)
    return F.when((na > 0) & (nb > 0), F.floor(dot * dot / na / nb * 100)).otherwise(F.lit(0)).cast("bigint")


def sound_tokens(text: Column, sounds: dict[str, list[str]]) -> Column:
    """Each character's sounds where the caller's table has them, else the character, ASCII letters in lower case."""
    table = F.create_map(*(x for k, v in sounds.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if sounds else None
    plain = lambda c: F.array(F.when(c.rlike("[A-Z]"), F.lower(c)).otherwise(c))
    return F.flatten(F.transform(chars(text), lambda c: F.coalesce(F.try_element_at(table, c), plain(c)) if table is not None else plain(c)))


def sound_distance(a: Column, b: Column, sounds: dict[str, list[str]]) -> Column:
    return bag_distance(sound_tokens(a, sounds), sound_tokens(b, sounds))


class _ColumnText:
    """A normalised text as a column, as ``Cascade`` looks at it."""

    def __init__(self, text: Column, sounds: dict):
        self.text, self.size = text, F.char_length(text)
        self.tokens = sound_tokens(text, sounds)
        self.heard = F.size(self.tokens)

    def apart(self, other: _ColumnText, near: Column) -> Column:
        return char_distance(self.text, other.text)

    def apart_in_sound(self, other: _ColumnText, near: Column) -> Column:
        return bag_distance(self.tokens, other.tokens)

    def score(self, other: _ColumnText) -> Column:
        return bigram_score(self.text, other.text)


class _PlainText:
    """The same of a plain string; distances are not computed where lengths are too far apart."""

    def __init__(self, text: str, sounds: dict):
        self.text, self.size = text, len(text)
        tokens = [t for c in text for t in (sounds.get(c) or [c.lower() if "A" <= c <= "Z" else c])] if sounds else []
        self.heard = len(tokens)
        self.chars, self.tokens, self.grams = Counter(text), Counter(tokens), Counter(map("".join, zip(text, text[1:])))
        self.square = sum(v * v for v in self.grams.values())

    def apart(self, other: _PlainText, near: bool) -> float:
        return self.size + other.size - 2 * _common(self.chars, other.chars) if near else float("inf")

    def apart_in_sound(self, other: _PlainText, near: bool) -> float:
        return self.heard + other.heard - 2 * _common(self.tokens, other.tokens) if near else float("inf")

    def score(self, other: _PlainText) -> int:
        if not self.square or not other.square or self.grams.keys().isdisjoint(other.grams):
            return 0
        dot = sum(v * other.grams[k] for k, v in self.grams.items() if k in other.grams)
        return int(dot * dot / self.square / other.square * 100)


def _common(a: Counter, b: Counter) -> int:
    return sum(min(v, b[k]) for k, v in a.items() if k in b)


class Bags:
    """Bags of tokens, bag ``i`` holding the tokens whose owner is ``i``, as sorted keys and counts."""

    #: Tokens looked up at once.
    BLOCK = 1 << 20

    def __init__(self, n: int, owner: np.ndarray, token: np.ndarray):
        known, place = np.unique(token, return_inverse=True)
        self.width = max(len(known), 1)
        self.keys, self.counts = np.unique(owner * self.width + place, return_counts=True)
        self.starts = np.searchsorted(self.keys, np.arange(n + 1) * self.width)
        self.sizes = np.bincount(owner, minlength=n)
        self.squares = np.bincount(self.keys // self.width, self.counts * self.counts, minlength=n).astype(np.int64)

    def common(self, i: np.ndarray, j: np.ndarray, fold: Callable) -> np.ndarray:
        """The sum of ``fold(count in bag i, count in bag j)`` over the tokens in both, for each pair of bags."""
        upto = np.cumsum(self.starts[i + 1] - self.starts[i])
        out, lo = np.zeros(len(i), np.int64), 0
        while lo < len(i):
            done = upto[lo - 1] if lo else 0
            hi = max(int(np.searchsorted(upto, done + self.BLOCK, side="right")), lo + 1)
            long = np.diff(upto[lo:hi], prepend=done)
            pair = np.repeat(np.arange(hi - lo), long)
            mine = np.arange(len(pair)) + np.repeat(self.starts[i[lo:hi]] - (upto[lo:hi] - long - done), long)
            wanted = self.keys[mine] % self.width + j[lo:hi][pair] * self.width
            theirs = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[theirs] == wanted
            out[lo:hi] = np.bincount(pair[hit], fold(self.counts[mine[hit]], self.counts[theirs[hit]]), minlength=hi - lo)
            lo = hi
        return out

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.sizes[i] + self.sizes[j] - 2 * self.common(i, j, np.minimum)


class Texts:
    """Different texts, compared in pairs of places by whole arrays."""

    #: Up to so many possible pairs those that occur are marked in a table, beyond they are sorted.
    TABLE = 1 << 22

    def __init__(self, texts: list[str]):
        self.texts, n = texts, len(texts)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(n), [len(t) for t in texts])
        self.chars = Bags(n, owner, points)
        inner = owner[:-1] == owner[1:]
        self.grams = Bags(n, owner[:-1][inner], points[:-1][inner] * 0x110000 + points[1:][inner])

    def sounds(self, sounds: dict[str, list[str]]) -> Bags:
        tokens = [_PlainText(t, sounds).tokens for t in self.texts]
        names: dict[str, int] = {}
        flat = [(i, names.setdefault(k, len(names))) for i, bag in enumerate(tokens) for k in bag.elements()]
        owner, token = np.array(flat, np.int64).reshape(-1, 2).T
        return Bags(len(tokens), owner, token)

    def char_distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.chars.distance(i, j)

    def bigram_score(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        dot = self.grams.common(i, j, np.multiply).astype(float)
        a, b = self.grams.squares[i], self.grams.squares[j]
        return np.where((a > 0) & (b > 0), np.floor(dot * dot / np.maximum(a, 1) / np.maximum(b, 1) * 100), 0).astype(np.int64)

    def once(self, i: np.ndarray, j: np.ndarray, score: Callable[[Texts, np.ndarray, np.ndarray], pa.Array]) -> pa.Array:
        """``score(self, i, j)``, worked out once for each two texts."""
        n = len(self.texts)
        code = i * n + j
        if n * n <= self.TABLE:
            seen = np.zeros(n * n, bool)
            seen[code] = True
            pairs = np.flatnonzero(seen)
            place = np.empty(n * n, np.int32)
            place[pairs] = np.arange(len(pairs))
            at = place[code]
        else:
            pairs, at = np.unique(code, return_inverse=True)
        return score(self, pairs // n, pairs % n).take(pa.array(at))


class _PlacedTexts:
    """The texts at places of ``Texts``, as ``Cascade`` looks at them."""

    def __init__(self, texts: Texts, heard: Bags | None, at: np.ndarray):
        self.texts, self.tokens, self.at = texts, heard, at
        self.text, self.size = at, texts.chars.sizes[at]
        self.heard = heard.sizes[at] if heard else None

    def apart(self, other: _PlacedTexts, near: np.ndarray) -> np.ndarray:
        return self.texts.char_distance(self.at, other.at)

    def apart_in_sound(self, other: _PlacedTexts, near: np.ndarray) -> np.ndarray:
        return self.tokens.distance(self.at, other.at)

    def score(self, other: _PlacedTexts) -> np.ndarray:
        return self.texts.bigram_score(self.at, other.at)


@dataclass(frozen=True)
class Cascade:
    """When two texts count as alike: the same, by characters, by sound, by bigrams."""

    max_dist: int = 5
    max_cosine: int = 45
    sounds: dict = field(default_factory=dict)
    cross_types: bool = True

    @property
    def min_size(self) -> int:
        return max(1, 2 * self.max_dist)

    def tests(self, a, b):
        """(reason, whether it holds, distance) of each test in order, for texts as columns or as plain strings. Conditions
        are joined by ``&`` and ``|``, which both understand."""
        m, size = self.max_dist, self.min_size

        def close(gap, distance, total):
            return (gap <= m) & (gap >= -m) & (((total < size) & (distance * size < m * total)) | ((total >= size) & (distance <= m)))

        yield "identical", a.text == b.text, 0
        gap, total = a.size - b.size, a.size + b.size
        edit = a.apart(b, (gap <= m) & (gap >= -m))
        yield "edit", close(gap, edit, total), edit
        if self.sounds:
            gap_in_sound = a.heard - b.heard
            heard = a.apart_in_sound(b, (gap_in_sound <= m) & (gap_in_sound >= -m))
            yield "pinyin", close(gap_in_sound, heard, total), heard
        if self.max_cosine <= 100:
            score = a.score(b)
            # texts of like length without a common character are not looked at
            yield "cosine", ((gap > m) | (gap < -m) | (edit < total)) & (score >= self.max_cosine), score

    def columns(self, a: Column, b: Column) -> tuple[Column, Column]:
        """(reason, distance) for two normalised texts, null where they differ."""
        reason = distance = F
        for name, holds, value in self.tests(_ColumnText(a, self.sounds), _ColumnText(b, self.sounds)):
            reason, distance = reason.when(holds, name), distance.when(holds, value)
        return reason, distance.cast("bigint")

    def reasons(self, texts: Texts, i: np.ndarray, j: np.ndarray) -> pa.Array:
        """The reason for the texts at places i and j, null where they differ."""
        heard = texts.sounds(self.sounds) if self.sounds else None
        tests = list(self.tests(_PlacedTexts(texts, heard, i), _PlacedTexts(texts, heard, j)))
        which = np.select([holds for _, holds, _ in tests], range(len(tests)), -1)
        return pa.array([name for name, _, _ in tests], pa.string()).take(pa.array(which, mask=which < 0))

    def features(self, text: str) -> _PlainText:
        return _PlainText(text, self.sounds)

    def compare(self, a: _PlainText, b: _PlainText) -> str | None:
        """The reason why two texts are alike, or None."""
        return next((name for name, holds, _ in self.tests(a, b) if holds), None)

    def matcher(self, most: int = 200_000):
        """(text, type, text, type) -> reason or None; remembers a bounded number of texts and answers."""
        texts: dict[str, _PlainText] = {}
        known: dict[tuple[str, str], str | None] = {}

        def of(text: str) -> _PlainText:
            found = texts.get(text)
            if found is None:
                if len(texts) >= most // 10:
                    texts.clear()
                found = texts[text] = self.features(text)
            return found

        def match(a: str, kind_a: int, b: str, kind_b: int) -> str | None:
            if kind_a != kind_b and not self.cross_types:
                return None
            if a == b:
                return "identical"
            try:
                return known[a, b]
            except KeyError:
                if len(known) >= most:
                    known.clear()
                found = known[a, b] = self.compare(of(a), of(b))
                return found

        return match
