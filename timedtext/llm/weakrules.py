"""Quality rules by weak supervision.

Each rule looks at one or two counts of a document and votes good, bad or abstains. Expectation-maximisation over the
counts of vote patterns (at most 3^rules, whatever the corpus) estimates how often each rule is right, and the
posterior probability of good quality replaces the demand that every rule pass.

Everything on the rows is DataFrame functions; only the table of vote patterns reaches the driver.

Defined results: a null text counts as empty: no words, failed. Repeated rows each get a row. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedtext.llm.common import SPACES, materialize

SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def words_array(text: Column) -> Column:
    """The words of a text, in order. Splitting leaves an empty string only at the ends."""
    return F.filter(F.split(text, SPLIT), lambda w: w != "")


def repeated_words(windows: Column) -> tuple:
    """How to count the words covered by windows that occur twice or more, in three steps of their own so that none is
    worked out twice: the sorted pairs of ``windows`` (a hash of each by its start), a function from those to the starts
    of repeated ones, and one from the starts to the count.

    Equal windows are neighbours after sorting by (hash, start). Their starts, sorted again, cover
    min(5, distance to the next start) words each.
    """
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, i, j: F.coalesce(F.get(a, i)["h"] == F.get(a, j)["h"], F.lit(False))
    marked = lambda a: F.filter(a, lambda x, i: same(a, i, i - 1) | same(a, i, i + 1))
    starts = lambda a: F.array_sort(F.transform(marked(a), lambda x: x["i"]))
    covered = lambda s: F.aggregate(
        F.transform(s, lambda p, i: F.coalesce(F.least(F.lit(WINDOW), F.get(s, i + 1) - p), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return pairs, starts, covered


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts that the rules look at, one row for each document."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("doc_id"), t.alias("t")).withColumn("w", words_array(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    n = F.size("w")
    hashes = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))
    one = base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.translate("t", "!?", ""))).cast("long").alias("n_marks"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
        (F.length("t") - F.length(F.translate("t", "0123456789", ""))).cast("long").alias("n_digits"),
        lines.alias("lines"),
        hashes.alias("h"),
    )
    # only texts in which some window comes twice pay for sorting
    two = one.select(
        *[c for c in one.columns if c not in ("lines", "h")],
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.col("h")).alias("h"),
    )
    pairs, starts, covered = repeated_words(F.col("h"))
    three = two.withColumn("h", pairs)
    four = three.withColumn("h", starts(F.col("h")))
    return four.withColumn("n_repeat_words", F.coalesce(covered(F.col("h")), F.lit(0)).cast("long")).drop("h")


#: rule -> (good, bad): when a rule votes; otherwise it abstains.
RULES = {
    "length": ("n_words >= 50", "n_words < 20"),
    "word_length": ("word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    "symbols": ("100 * n_symbols <= word_chars", "100 * n_symbols > 8 * word_chars"),
    "symbol_words": ("20 * n_symbols <= n_words", "10 * n_symbols > 3 * n_words"),
    "line_copies": ("10 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    "repeats": ("100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 15 * n_words"),
    "capitals": ("100 * n_capitals <= 15 * word_chars", "100 * n_capitals > 35 * word_chars"),
    "marks": ("50 * n_marks <= n_words", "10 * n_marks > 3 * n_words"),
    "digits": ("20 * n_digits <= word_chars", "3 * n_digits > word_chars"),
}


def votes(counted: DataFrame) -> DataFrame:
    """A vote of 1, -1 or 0 for each rule, in columns ``v_<rule>``."""
    return counted.withColumns({f"v_{r}": F.when(F.expr(good), 1).when(F.expr(bad), -1).otherwise(0) for r, (good, bad) in RULES.items()})


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100, prior: float = 0.8) -> tuple[float, list[float], list[dict]]:
    """Expectation-maximisation over (votes, count). The share of good documents is kept between 0.05 and 0.95, so that
    neither side runs out of examples. Gives the share of good documents and, for each rule, the
    chances of its votes when the document is good and when it is bad; starts from rules that are mostly right."""
    if not patterns:
        return prior, [], []
    k = len(patterns[0][0])
    table = [{True: {1: 0.8, 0: 0.18, -1: 0.02}, False: {1: 0.4, 0: 0.2, -1: 0.4}} for _ in range(k)]
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        post = [posterior(v, prior, table) for v, _ in patterns]
        good = sum(p * n for p, (_, n) in zip(post, patterns))
        new = min(max((good + 1) / (total + 2), 0.05), 0.95)
        for r in range(k):
            for side in (True, False):
                seen = {1: 1.0, 0: 1.0, -1: 1.0}
                for p, (v, n) in zip(post, patterns):
                    seen[v[r]] += n * (p if side else 1 - p)
                whole = sum(seen.values())
                table[r][side] = {x: c / whole for x, c in seen.items()}
            # a rule stays on its own side: a vote for good may not count against it
            if table[r][True][1] * table[r][False][-1] < table[r][False][1] * table[r][True][-1]:
                for x in (1, -1):
                    table[r][True][x] = table[r][False][x] = (table[r][True][x] + table[r][False][x]) / 2
        if abs(new - prior) < 1e-9:
            break
        prior = new
    return prior, [t[True][1] for t in table], table


def posterior(v: tuple[int, ...], prior: float, table: list[dict]) -> float:
    odds = math.log(prior) - math.log(1 - prior)
    for x, t in zip(v, table):
        odds += math.log(t[True][x]) - math.log(t[False][x])
    return 1 / (1 + math.exp(-max(min(odds, 500), -500)))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Counts, base verdict, posterior ``quality`` and ``kept`` for each document."""
    spark = docs.sparkSession
    names = [f"v_{r}" for r in RULES]
    counted = materialize(votes(counts(docs, key, text)), "quality-counts")
    patterns = [(tuple(r[c] for c in names), r["n"]) for r in counted.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    prior, _, table = estimate(sorted(patterns))
    scored = [(*v, posterior(v, prior, table)) for v, _ in patterns]
    # one row for each pattern of votes that occurs, 3^9 at most
    by_votes = spark.createDataFrame(scored, ", ".join(f"{c} int" for c in names) + ", quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        counted.join(F.broadcast(by_votes), names)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )
