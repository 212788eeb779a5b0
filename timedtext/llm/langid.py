"""Language identification by word-first backoff.

A word known from training scores by its log frequency in each language. An unseen word falls back to its character
4-grams, those unknown to their 3-grams, and so on down to single letters; the mean over its longest known grams counts.
Word scores add up over the whole text. Words of a text are not independent, so the evidence for the best language
grows with the square root of their number: the score is the posterior for the sum divided by that root. It tells mixed
texts from plain ones at any length.

Frequencies are shares of a language's words (or grams), with the same small share for unseen ones in every language (a
fifth of one word of the largest), so that a language is not preferred for having little text. A word or gram thus has an entry only for the languages it was
seen in, and the model's size follows the vocabulary and not the number of languages.

Defined results: a null, empty or letterless text is ``und`` with score 0; letters are what Unicode calls alphabetic, so
digits, fractions and circled numbers are none. Ties between languages go to the alphabetically first. Repeated rows each
get their own row. With no training rows every text is ``und``. Other columns pass through; one named like a new one is
replaced.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedtext.llm.common import give_back, materialize, received, release, sampled, send, small_batches, tidy


def _letters() -> str:
    """A class of the alphabetic characters: word characters but for the digits and the other numbers."""
    numbers, spans = [c for c in range(128, 0x110000) if chr(c).isalnum() and not chr(c).isalpha()], []
    for c in numbers:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return rf"[^\W\d_{''.join(f'{chr(a)}-{chr(b)}' for a, b in spans)}]"


WORD = re.compile(f"{_letters()}+")
GRAMS = (4, 3, 2, 1)
#: Characters of a text that are taken apart at once, words of a chunk, sums held for its texts, and new words looked up at once.
PIECE, CHUNK, CELLS, SLICE = 1_000_000, 40_000, 1_000_000, 5_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def pieces_of(text: str) -> Iterator[list[str]]:
    """The words of a text, a bounded number of characters at a time."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
            end += 1
        yield words_of(text[start:end])
        start = end


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of stretches of the given sizes, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


class Units:
    """Words, or grams of one length: for each its languages and how much more than an unseen one it counts there."""

    def __init__(self, counts: list[dict[str, int]], unseen: float, most: int | None = None):
        """counts: unit -> count for each language. ``most``: units kept, by their greatest share in any language."""
        if most is not None and len(set().union(*counts)) > most:
            best: dict[str, float] = {}
            for found in counts:
                total = sum(found.values())
                for u, n in found.items():
                    best[u] = max(best.get(u, 0.0), n / total)
            kept = set(sorted(best, key=lambda u: (-best[u], u))[:most])
            counts = [{u: n for u, n in found.items() if u in kept} for found in counts]
        self.at = {u: i for i, u in enumerate(sorted(set().union(*counts)))}
        unit = np.fromiter((self.at[u] for found in counts for u in found), np.int64)
        lang = np.repeat(np.arange(len(counts), dtype=np.int32), [len(found) for found in counts])
        n = np.fromiter((n for found in counts for n in found.values()), float)
        order = np.argsort(unit, kind="stable")
        totals = np.bincount(lang, weights=n, minlength=len(counts))
        # how much more than the logarithm of the share of unseen ones, which is the same for all languages
        small = unseen / max(totals.max(initial=0), 1)
        self.lang, self.more = lang[order], np.log1p(n / totals[lang] / small)[order]
        self.start = np.searchsorted(unit[order], np.arange(len(self.at) + 1))


class Backoff:
    """Log frequencies by language for words and character n-grams."""

    def __init__(self, counts: dict[str, dict[str, int]], max_grams: int = 60_000, unseen: float = 0.2):
        """counts: language -> word -> count."""
        self.langs = sorted(counts)
        found = [counts[x] for x in self.langs]
        self.levels = [Units(found, unseen)]
        for n in GRAMS:
            grams = [Counter() for _ in found]
            for into, words in zip(grams, found):
                for w, k in words.items():
                    for g in grams_of(w, n):
                        into[g] += k
            self.levels.append(Units(grams, unseen, max_grams))

    def rows_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: how many entries each has, and their languages and values. A word none of whose letters is
        known has none."""
        made = []
        rest = range(len(words))
        for k, units in enumerate(self.levels):
            who, at, left = [], [], []
            for i in rest:
                known = [u for g in ([words[i]] if k == 0 else grams_of(words[i], GRAMS[k - 1])) if (u := units.at.get(g)) is not None]
                if known:
                    who.append(i)
                    at.append(known)
                else:
                    left.append(i)
            rest = left
            if who:
                grams = np.array([len(x) for x in at])
                flat = np.array([u for x in at for u in x])
                sizes = units.start[flat + 1] - units.start[flat]
                entry = _spread(units.start[flat], sizes)
                # the mean over the grams of a word
                cell = np.repeat(np.repeat(np.array(who), grams), sizes) * len(self.langs) + units.lang[entry]
                cells, inverse = np.unique(cell, return_inverse=True)
                value = np.bincount(inverse, weights=units.more[entry] / np.repeat(np.repeat(grams, grams), sizes))
                made.append((cells, value))
        cells, values = (np.concatenate(x) for x in zip(*made)) if made else (np.zeros(0, np.int64), np.zeros(0))
        order = np.argsort(cells, kind="stable")
        owner, lang = np.divmod(cells[order], max(len(self.langs), 1))
        return np.bincount(owner, minlength=len(words)), lang.astype(np.int32), values[order]

    def scorer(self, max_cached: int = 100_000):
        """texts -> languages and scores; words met before keep their row in a bounded cache."""
        cache: dict[str, int] = {}
        empty = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)
        sizes, langs, values = empty
        n_langs = len(self.langs)

        def sums(held: list[list[str]]) -> np.ndarray:
            nonlocal sizes, langs, values
            flat = [w for ws in held for w in ws]
            new = list(dict.fromkeys(w for w in flat if w not in cache))
            if new:
                if len(cache) > max_cached:
                    cache.clear()
                    sizes, langs, values = empty
                    new = list(dict.fromkeys(flat))
                cache.update(zip(new, range(len(cache), len(cache) + len(new))))
                made = [self.rows_of(new[a : a + SLICE]) for a in range(0, len(new), SLICE)]
                sizes, langs, values = (np.concatenate(x) for x in zip((sizes, langs, values), *made))
            doc = np.repeat(np.arange(len(held)), [len(ws) for ws in held])
            at = np.fromiter((cache[w] for w in flat), np.int64, len(flat))
            starts = np.cumsum(sizes) - sizes
            entry = _spread(starts[at], sizes[at])
            cell = np.repeat(doc, sizes[at]) * n_langs + langs[entry]
            return np.bincount(cell, weights=values[entry], minlength=len(held) * n_langs).astype(float).reshape(len(held), n_langs)

        def score(texts: list[str | None]) -> tuple[list[str], list[float]]:
            names: list[str] = []
            scores: list[float] = []

            def done(totals: np.ndarray, words: list[int]) -> None:
                best = totals.argmax(axis=1)
                gap = (totals - totals[np.arange(len(best)), best][:, None]) / np.sqrt(np.maximum(words, 1))[:, None]
                share = 1 / np.exp(np.clip(gap, -60, 0)).sum(axis=1)
                for b, s, n in zip(best, share, words):
                    names.append(self.langs[b] if n else "und")
                    scores.append(float(s) if n else 0.0)

            held: list[list[str]] = []
            size = 0
            for text in texts:
                if not n_langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                if text and len(text) > PIECE:
                    # by itself, piece by piece
                    if held:
                        done(sums(held), [len(x) for x in held])
                        held, size = [], 0
                    total, n = np.zeros((1, n_langs)), 0
                    for words in pieces_of(text):
                        total += sums([words])
                        n += len(words)
                    done(total, [n])
                    continue
                held.append(words_of(text) if text else [])
                size += len(held[-1])
                if size >= CHUNK or len(held) * n_langs >= CELLS:
                    done(sums(held), [len(x) for x in held])
                    held, size = [], 0
            if held:
                done(sums(held), [len(x) for x in held])
            return names, scores

        return score


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = 20_000, max_words: int = 60_000) -> Backoff:
    """Learn from at most about ``max_docs`` labelled rows, drawn by a hash of the id. Every language keeps its most
    frequent words: its part of ``max_words``, 50 at least, and fewer where equally frequent words would pass that; words
    beyond it are left to their grams. So the model has a fixed bound."""
    small_batches(labelled.sparkSession)
    rows = sampled(labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), key, max_docs)

    def counted(batches):
        found: Counter = Counter()
        for pdf in batches:
            for text_, lang_ in zip(pdf["text"], pdf["lang"]):
                found[(lang_, "")] += 0
                for words in pieces_of(text_):
                    found.update((lang_, w) for w in words)
                if len(found) > 500_000:
                    yield _frame(found)
                    found.clear()
        yield _frame(found)

    counts = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInPandas(tidy(counted), "lang string, word string, n long")
    by_word = materialize(counts.groupBy("word", "lang").agg(F.sum("n").alias("n")), "words")
    # how many words of each language come how often; from there its least frequent level that fits the quota
    levels: dict[str, list] = {r["lang"]: [] for r in by_word.where("n = 0").collect()}
    for r in by_word.where("n > 0").groupBy("lang", "n").agg(F.count("*").alias("words")).collect():
        levels[r["lang"]].append((r["n"], r["words"]))
    quota = max(50, max_words // max(len(levels), 1))
    least = []
    for name, found in levels.items():
        room, low = quota, None
        for n, words in sorted(found, reverse=True):
            room -= words
            if room < 0:
                break
            low = n
        if low is not None:
            least.append((name, low))
    learned: dict[str, dict[str, int]] = {name: {} for name in levels}
    if least:
        limits = labelled.sparkSession.createDataFrame(least, "lang string, low long")
        # one row for each language learned, at most max_docs
        for r in by_word.join(F.broadcast(limits), "lang").where("n >= low").select("lang", "word", "n").collect():
            learned[r["lang"]][r["word"]] = r["n"]
    release(by_word)
    model = Backoff(learned)
    give_back()
    return model


def _frame(found: Counter) -> pd.DataFrame:
    return pd.DataFrame([(a, b, n) for (a, b), n in found.items()], columns=["lang", "word", "n"])


def predict(docs: DataFrame, model: Backoff, text: str = "text", out: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """Add the predicted language and its score (0 to 1) to every row."""
    small_batches(docs.sparkSession)
    sent = send(docs.sparkSession, model)

    @F.pandas_udf("struct<lang:string,score:double>")
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = received(sent).scorer()
        for texts in parts:
            names, scores = run(texts.tolist())
            yield pd.DataFrame({"lang": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})
        del run
        give_back()

    return docs.withColumn("__guess", guess(text)).withColumns({out: F.col("__guess.lang"), score: F.col("__guess.score")}).drop("__guess")
