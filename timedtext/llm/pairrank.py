"""Quality scores by Bradley-Terry pairwise ranking.

Preference pairs (a document labelled good over one labelled bad) train a linear score by logistic loss on feature
differences. Features are shares and counts of the whole text, and its words and pairs of neighbouring words, hashed to a
fixed number of places, so that what is said and in which order counts too. The score at the quantile that equals the
share of bad labels becomes the threshold, and a logistic of the distance to it maps scores to 0..1, so 0.5 is the threshold.

Defined results: a null or empty text has the features of an empty text and still gets a score. Rows with a null label
are not learned from; of several labels of one id the smallest holds, and of several texts of one id the one whose features
come first. Without both labels every score is 0.5. Repeated rows each get a row. Other columns pass through; one named
like the new one is replaced.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedtext.llm.common import mixed, received, sampled, send, small_batches, tidy
from timedtext.llm.tokenjoin import word_hashes

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>@^~=+_\\/{}[]",
    "mark": b"!?",
    "comma": b",;:",
    "stop": b".",
    "quote": b"\"'()-",
    "line": b"\n",
    "blank": b" \t\r\x0b\x0c",
}
FEATURES = [*_CLASSES, "log_words", "log_chars", "word_length", "distinct_words", "top_word", "top_line", "line_copies", "short_lines", "repeats", "line_words", "stops_per_word", "marks_per_word", "symbols_per_word", "tiny"]


def _lookup() -> np.ndarray:
    table = np.full(256, len(_CLASSES), np.uint8)
    for k, chars in enumerate(_CLASSES.values()):
        table[list(chars)] = k
    return table


LOOKUP = _lookup()


def features(text: str | None) -> np.ndarray:
    """The features of one whole text."""
    raw = (text or "").encode("utf-8", "replace")
    per = np.bincount(LOOKUP[np.frombuffer(raw, np.uint8)], minlength=len(_CLASSES) + 1)[: len(_CLASSES)].astype(float)
    n = max(len(raw), 1)
    words = raw.lower().split()
    k = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    found = Counter(words)
    pairs = set(zip(words, words[1:], words[2:]))
    line_counts = Counter(lines)
    by = dict(zip(_CLASSES, per))
    rest = [
        math.log1p(len(words)),
        math.log1p(len(raw)),
        min(sum(map(len, words)) / k, 40) / 10,
        len(found) / k,
        max(found.values(), default=0) / k,
        max(line_counts.values(), default=0) / max(len(lines), 1),
        1 - len(line_counts) / max(len(lines), 1),
        sum(len(x) < 20 for x in lines) / max(len(lines), 1),
        1 - len(pairs) / max(len(words) - 2, 1) if len(words) > 2 else 0.0,
        min(len(words) / max(len(lines), 1), 500) / 100,
        by["stop"] / k,
        min(by["mark"] / k, 3),
        min(by["symbol"] / k, 5),
        float(len(words) < 10),
    ]
    return np.concatenate([np.sqrt(per / n), rest])


#: Places for hashed words, and as many for hashed pairs of words.
PLACES = 1 << 12
_CHAIN = np.uint64(0x9E3779B97F4A7C15)


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words and of the pairs of words of one whole text, and their weights: logarithms of counts, of length one
    for the words and for the pairs."""
    _, words = word_hashes(np.frombuffer((text or "").encode("utf-8", "replace") + b" ", np.uint8))
    at, weight = [], []
    for k, x in enumerate((words, mixed(words[:-1] * _CHAIN + words[1:]) if len(words) > 1 else words[:0])):
        n = np.bincount((x & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES)
        here = np.flatnonzero(n)
        value = np.log1p(n[here])
        at.append(here + k * PLACES)
        weight.append(value / max(math.sqrt((value * value).sum()), 1e-12))
    return np.concatenate(at), np.concatenate(weight)


class Hashed:
    """Hashed features of many texts, one after the other in flat arrays."""

    def __init__(self, rows: list[bytes]):
        """rows: places as 16-bit integers, then as many weights as 16-bit floats."""
        half = [len(r) // 2 for r in rows]
        self.start = np.concatenate([[0], np.cumsum([h // 2 for h in half])]).astype(np.int64)
        self.at = np.frombuffer(b"".join(r[:h] for r, h in zip(rows, half)), "<u2")
        self.weight = np.frombuffer(b"".join(r[h:] for r, h in zip(rows, half)), "<f2")

    def blocks(self, rows: int = 500):
        """(first row, row of each entry, place, weight), a few rows at a time."""
        n = len(self.start) - 1
        for a in range(0, n, rows):
            b = min(a + rows, n)
            lo, hi = self.start[a], self.start[b]
            yield a, b, np.repeat(np.arange(b - a), np.diff(self.start[a : b + 1])), self.at[lo:hi].astype(np.int64), self.weight[lo:hi].astype(float)

    def score(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.start) - 1)
        for a, b, row, at, weight in self.blocks():
            out[a:b] = np.bincount(row, weights=weight * w[at], minlength=b - a)
        return out

    def back(self, per_row: np.ndarray) -> np.ndarray:
        """The sum of the rows, each times its number."""
        out = np.zeros(2 * PLACES)
        for a, b, row, at, weight in self.blocks():
            out += np.bincount(at, weights=weight * per_row[a:b][row], minlength=2 * PLACES)
        return out


def packed(text: str | None) -> bytes:
    at, weight = hashed(text)
    return at.astype("<u2").tobytes() + weight.astype("<f2").tobytes()


class Ranker:
    """``words``: a weight for each place, or None where nothing was learned."""

    def __init__(self, mean, scale, weights, words, threshold, width):
        self.mean, self.scale, self.weights, self.words, self.threshold, self.width = mean, scale, weights, words, threshold, width

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        x = np.array([features(t) for t in texts])
        s = np.einsum("ij,j->i", np.clip((x - self.mean) / self.scale, -8, 8), self.weights)
        if self.words is not None:
            for k, t in enumerate(texts):
                at, weight = hashed(t)
                s[k] += (self.words[at] * weight).sum()
        return 1 / (1 + np.exp(-np.clip((s - self.threshold) / self.width, -40, 40)))


def learn(x: np.ndarray, y: np.ndarray, hashes: Hashed | None = None, pairs: int = 60_000, rounds: int = 25, steps: int = 30, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """Logistic loss of score differences between good (1) and bad (0) rows, over at most ``pairs`` pairs (40 for each
    possible one where there are few): Newton's method for the counts, then accelerated gradients for the hashed words
    beside them."""
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), None, 0.0, 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    m = min(pairs, 40 * len(good) * len(bad))
    better, worse = rng.choice(good, m), rng.choice(bad, m)
    d = z[better] - z[worse]
    w = np.zeros(width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", d, w), -40, 40)))
        gradient = np.einsum("ij,i->j", d, 1 - p) / m - ridge * w
        hessian = np.einsum("ij,i,ik->jk", d, p * (1 - p), d) / m + ridge * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    s = np.einsum("ij,j->i", z, w)
    words = None
    if hashes is not None:
        # a pair's features are no longer than 2 * sqrt(2), so the loss curves by at most 2 + ridge
        rate = 1 / (2 + ridge)
        words, ahead = np.zeros(2 * PLACES), np.zeros(2 * PLACES)
        for k in range(steps):
            t = s + hashes.score(ahead)
            p = 1 / (1 + np.exp(np.clip(t[better] - t[worse], -40, 40)))
            pull = np.bincount(better, weights=p, minlength=len(y)) - np.bincount(worse, weights=p, minlength=len(y))
            then = ahead + rate * (hashes.back(pull) / m - ridge * ahead)
            ahead = then + k / (k + 3) * (then - words)
            words = then
        s = s + hashes.score(words)
    q = len(bad) / len(y)
    # the middle of the gap at the quantile
    o = np.sort(s)
    k = min(max(int(round(q * len(o))), 1), len(o) - 1)
    threshold = (o[k - 1] + o[k]) / 2
    return Ranker(mean, scale, w, words, threshold, max(float(np.std(s)), 1e-6) / 4)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = 20_000) -> Ranker:
    """Learn from at most about ``max_docs`` labelled rows, drawn by a hash of the id."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("doc_id"), F.col(label).alias("label"))
    small_batches(docs.sparkSession)
    rows = sampled(rows, "doc_id", max_docs).groupBy("doc_id").agg(F.min("label").alias("label"))

    def featured(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": [features(t).tobytes() for t in pdf["text"]], "h": [packed(t) for t in pdf["text"]]})

    # the labels are bounded by max_docs, so they can go to every executor; one row for each of them comes back
    taken = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(rows), "doc_id")
    made = taken.mapInPandas(tidy(featured), "doc_id long, label int, x binary, h binary")
    found = made.groupBy("doc_id", "label").agg(F.min(F.struct("x", "h")).alias("f")).orderBy("doc_id").select("label", "f.x", "f.h").collect()
    if not found:
        return learn(np.zeros((0, len(FEATURES))), np.zeros(0, int))
    x, y, h = np.array([np.frombuffer(r[1]) for r in found]), np.array([r[0] for r in found], int), Hashed([r[2] for r in found])
    del found
    return learn(x, y, h)


def predict(docs: DataFrame, ranker: Ranker, text: str = "text", out: str = "score") -> DataFrame:
    """Add a score from 0 to 1 to every row."""
    small_batches(docs.sparkSession)
    sent = send(docs.sparkSession, ranker)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = received(sent)
        for texts in parts:
            yield pd.Series(model.score(texts.tolist()), dtype=float)

    return docs.withColumn(out, scored(text))
