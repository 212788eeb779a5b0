"""Benchmark decontamination by template canonicalisation.

Words are runs of letters and digits. Numbers (as digits or words), names (words in title case) and units become typed
placeholders, names or numbers in a row one placeholder, the rest goes to lower case. Windows of such tokens of the benchmark, of eight and of a quarter of
the item (four at least), are joined by hash with those of the documents; bitmaps sized to the benchmark drop nearly all
windows of a document before any row is made. Matches on one diagonal (position in the document less position in the item) make a
run; runs on neighbouring diagonals are put together, as inserted and dropped words and longer names shift them: an item is
found when the windows matched there cover at least half of its words and either three quarters of the places of names map
one to one, or four fifths of the words covered are the same, or stretches of eight same words cover half of the item. So a
question with other numbers and names counts and a chance likeness does not; numbers and units may change freely.

All of it is DataFrame functions.

Defined results: a null or empty text holds nothing. Windows with fewer than half literal tokens are not joined by their
template; items with such windows, and items of fewer than four words, are joined by their exact words in lower case too, so
that a copy word for word is always found: an item of one word is found wherever that word is. Repeated rows each get
theirs. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedtext.llm.common import materialize

WINDOW = 8
LEAST_WORDS = 4
#: Tokens of the shortest template.
SHORTEST = 3
COVERED = 0.5
#: Shares of the places of names that must agree, or of the covered words that must be the same.
CONSISTENT, ALIKE = 0.75, 0.8
NAME, NUMBER, UNIT = "@", "#", "&"
UNITS = (
    "mm|cm|dm|m|km|in|inch|inches|ft|foot|feet|yd|yards?|miles?|mg|g|kg|grams?|kilograms?|tons?|tonnes?|oz|ounces?|lb|lbs|pounds?|ml|cl|l|liters?|litres?|gallons?|"
    "ms|s|sec|secs|seconds?|min|mins|minutes?|h|hr|hrs|hours?|days?|weeks?|months?|years?|meters?|metres?|kilometers?|kilometres?|centimeters?|centimetres?|"
    "dollars?|cents?|euros?|usd|eur|gbp|percent|degrees?|kmh|mph|watts?|kw|volts?|bytes?|kb|mb|gb|tb"
)
#: Numbers as words; "one" is more often a pronoun.
NUMBER_WORDS = "two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|(?:thir|four|fif|six|seven|eigh|nine)teen|(?:twen|thir|for|fif|six|seven|eigh|nine)ty|hundred|thousand|million|billion"
#: Slots of a bitmap for each window in it, the fewest and the most; beyond that the benchmark is taken in blocks.
SLOTS, LEAST_SLOTS, MOST_SLOTS = 16, 1 << 14, 1 << 25
#: Where in a hash its slots are read: few for prefixes, which are tested at every word, more for whole windows.
PREFIX_SHIFTS, WHOLE_SHIFTS = (0, 24), (0, 8, 16, 24, 32, 39)
#: Rows up to which the benchmark's windows are broadcast (about 100 MB); beyond, both sides are shuffled, a frequent window
#: to as many tasks as there are salts.
BROADCAST_ROWS, SALTS = 400_000, 16


def _spelled(alternatives: str) -> list[str]:
    """The words that alternatives match, each a word with a group of beginnings before it or an optional last letter."""
    out = []
    for one in re.split(r"\|(?![^(]*\))", alternatives):
        heads, stem, last = re.fullmatch(r"(?:\(\?:([\w|]+)\))?(\w*?)(?:(\w)\?)?", one).groups()
        out += [head + stem + tail for head in (heads or "").split("|") for tail in {"", last or ""}]
    return out


def _by_letter(words: list[str]) -> str:
    """A pattern of the words that branches by one letter after the other, so that a word that is none of them is passed
    after a few letters rather than held against each."""
    tails: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        tails.setdefault(word[:1], []).append(word[1:])
    ends = tails.pop("", None) is not None
    branches = [first + _by_letter(rest) for first, rest in tails.items()]
    if len(branches) == 1 and not ends:
        return branches[0]
    return f"(?:{'|'.join(branches)})" + ("?" if ends else "") if branches else ""


def plain(text: Column) -> Column:
    """Words joined by single spaces: separators inside numbers go, digits and letters part. Each pattern begins with what
    is rare, so that most places of a text are passed at one look."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[.,:/](?<=\d.)(?=\d)", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(\d)(?=\p{L})", "$1 "), r"(\d)(?<=\p{L}\d)", " $1")
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def template(words: Column) -> Column:
    """The canonical form of ``plain`` text, word for word. Patterns begin with the space before a word."""
    named = F.regexp_replace(F.concat(F.lit(" "), words), r" \p{Lu}\p{Ll}*(?![^ ])", f" {NAME}")
    numbered = F.regexp_replace(F.lower(named), rf" (?:\p{{N}}+|{_by_letter(_spelled(NUMBER_WORDS))})(?![^ ])", f" {NUMBER}")
    return F.ltrim(F.regexp_replace(numbered, rf" {_by_letter(_spelled(UNITS))}(?![^ ])", f" {UNIT}"))


def _words(joined: Column) -> Column:
    """The words of a text with single spaces between them."""
    return F.array_remove(F.split(joined, " "), "")


def _hash(words: Column, at: Column, n: int, exact: bool = False) -> Column:
    return F.xxhash64(*([F.lit(1)] if exact else []), *(F.get(words, at + k) for k in range(n)))


def _bitmap(hashes: DataFrame, slots: int, shifts: tuple[int, ...]):
    """A test of a hash against a literal with one byte for each slot. A hash falls into one slot for each shift; it passes
    if all of its slots are set by some hash. The literal is written out wherever the driver describes a plan, so a test
    names it once."""
    out = np.zeros(slots, np.uint8)
    values = hashes.toArrow().column(0).drop_null().to_numpy().view(np.uint64)
    for shift in shifts:
        out[(values >> np.uint64(shift)) & np.uint64(slots - 1)] = 1
    bitmap = F.lit(out.tobytes())

    def passes(h: Column) -> Column:
        slot = lambda shift: F.call_function("shiftrightunsigned", h, shift).bitwiseAND(F.lit(slots - 1)).cast("int")
        return F.forall(F.array(*map(F.lit, shifts)), lambda shift: F.substring(bitmap, slot(shift) + 1, 1) == F.lit(b"\x01"))

    return passes


def _collapsed(c: Column) -> Column:
    """A template with names in a row and numbers in a row as one token each."""
    return F.regexp_replace(c, rf"([{NAME}{NUMBER}])(?: \1)+", "$1")


def _starts() -> Column:
    """The word that each token of the template ``c`` starts at."""
    first = lambda i: ~F.get("c", i).isin(NAME, NUMBER) | (i == 0) | (F.get("c", i - 1) != F.get("c", i))
    return F.filter(F.transform("c", lambda x, i: i), first)


def _tokens(df: DataFrame) -> DataFrame:
    """``p`` becomes w and l, its words as they are and in lower case; c, their template; t, its tokens; s, the word each
    token starts at."""
    others = [c for c in df.columns if c != "p"]
    df = df.withColumn("c", template(F.col("p")))
    df = df.select(*others, _words(F.col("p")).alias("w"), _words(F.lower("p")).alias("l"), _words(F.col("c")).alias("c"), _words(_collapsed(F.col("c"))).alias("t"))
    return df.withColumn("s", _starts())


def _values(i: Column, k: Column | int) -> Column:
    """The words in lower case that the k tokens from token i stand for."""
    value = lambda j: F.lower(F.array_join(F.slice("w", F.get("s", j) + 1, F.coalesce(F.get("s", j + 1), F.size("w")) - F.get("s", j)), " "))
    return F.transform(F.sequence(i, i + (k - 1)), value)


def _window(i: Column, k: int) -> Column:
    """The window of k tokens from token i: where it and its second token start, hash and values."""
    return F.struct(F.lit(k).alias("k"), F.get("s", i).alias("at"), F.get("s", i + 1).alias("next"), _hash(F.col("t"), i, k).alias("h"), _values(i, k).alias("v"))


def _exact_window(i: Column, k: int) -> Column:
    """The window of k words from word i, by the words in lower case."""
    return F.struct(F.lit(k).alias("k"), i.alias("at"), (i + 1).alias("next"), _hash(F.col("l"), i, k, True).alias("h"), F.slice("l", i + 1, k).alias("v"))


def _lengths(n: Column) -> Column:
    """The lengths of the windows of an item of n tokens."""
    short = F.least(F.greatest(F.floor(n / 4), F.lit(LEAST_WORDS)), F.lit(WINDOW), n).cast("int")
    return F.array_distinct(F.array(short, F.least(F.lit(WINDOW), n)))


def benchmark_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """The indexed windows: item_id, item_words, exact, bk, item_at, item_next, bh, item_v, item_t, item_s, opens, closes."""
    base = _tokens(items.select(F.col(key).alias("item_id"), plain(F.col(text)).alias("p")))
    base = base.withColumn("item_words", F.size("w")).withColumn("n", F.size("t"))
    none = F.array().cast("array<int>")

    def of_length(k: int) -> Column:
        used = (F.col("item_words") >= LEAST_WORDS) & (F.col("n") >= k) & F.array_contains(_lengths(F.col("n")), k)
        starts = F.when(used, F.sequence(F.lit(0), F.col("n") - k)).otherwise(none)
        return F.transform(starts, lambda i: _indexed(i, _window(i, k), F.slice("t", i + 1, k), F.slice("s", i + 1, k), F.col("n"), False))

    def of_exact_length(k: int) -> Column:
        n = F.col("item_words")
        used = F.col("dense") & (n >= k) & F.array_contains(_lengths(n), k)
        starts = F.when(used, F.sequence(F.lit(0), n - k)).otherwise(none)
        return F.transform(starts, lambda i: _indexed(i, _exact_window(i, k), F.slice("c", i + 1, k), F.sequence(i, i + (k - 1)), n, True))

    literal = lambda o: 2 * F.size(F.filter(o["t"], lambda x: ~x.isin(NAME, NUMBER, UNIT))) >= o["x"]["k"]
    base = base.withColumn("all", F.concat(*map(of_length, range(SHORTEST, WINDOW + 1))))
    # columns rather than filters of rows, which would be pushed down with all they are made from
    base = base.withColumn("dense", (F.size("all") == 0) | F.exists("all", lambda o: ~literal(o)))
    windows = base.select("item_id", "item_words", F.inline(F.concat(F.filter("all", literal), *map(of_exact_length, range(1, WINDOW + 1)))))
    return windows.select(
        "item_id",
        "item_words",
        "exact",
        F.col("x.k").alias("bk"),
        F.col("x.at").alias("item_at"),
        F.col("x.next").alias("item_next"),
        F.col("x.h").alias("bh"),
        F.col("x.v").alias("item_v"),
        F.col("t").alias("item_t"),
        F.col("s").alias("item_s"),
        "opens",
        "closes",
    )


def _indexed(i: Column, window: Column, t: Column, s: Column, n: Column, exact: bool) -> Column:
    return F.struct(window.alias("x"), t.alias("t"), s.alias("s"), (i == 0).alias("opens"), (i + window["k"] == n).alias("closes"), F.lit(exact).alias("exact"))


def _prefix(lengths: list[tuple[bool, int]], exact: bool) -> int:
    """How many tokens the first bitmap looks at: windows by words are few, so two tell enough."""
    return min(2 if exact else SHORTEST, *(k for e, k in lengths if e == exact))


def _document_windows(docs: DataFrame, lengths: list[tuple[bool, int]], keep) -> DataFrame:
    """The windows of the documents (rid, doc_id, p) that ``keep``, two tests of a hash (of the prefix and of the whole),
    lets pass. ``lengths``: whether exact, and of how many tokens. Only documents with such windows pay for their values."""
    none = F.array().cast("array<int>")
    base = docs.withColumn("tc", template(F.col("p")))
    base = base.select("*", _words(_collapsed(F.col("tc"))).alias("t"), _words(F.lower("p")).alias("l"))

    def places_of(exact: bool, words: str) -> Column:
        least = min(k for e, k in lengths if e == exact)
        at = F.when(F.size(words) >= least, F.sequence(F.lit(0), F.size(words) - least)).otherwise(none)
        return F.filter(at, lambda i: keep[0](_hash(F.col(words), i, _prefix(lengths, exact), exact)))

    sides = [(e, words, places) for e, words, places in ((False, "t", "places"), (True, "l", "exact_places")) if any(x == e for x, _ in lengths)]
    for exact, words, places in sides:
        base = base.withColumn(places, places_of(exact, words))

    def of_length(exact: bool, k: int) -> Column:
        words, places = next((w, p) for e, w, p in sides if e == exact)
        window = lambda i: F.struct(F.lit(exact).alias("exact"), F.lit(k).alias("k"), i.alias("i"), _hash(F.col(words), i, k, exact).alias("h"))
        return F.transform(F.filter(places, lambda i: i <= F.size(words) - k), window)

    found = base.withColumn("found", F.filter(F.concat(*(of_length(e, k) for e, k in lengths)), lambda x: keep[1](x["h"])))
    found = found.drop(*(p for _, _, p in sides), "t")
    # columns that are null rather than a filter of rows, which would be pushed down with all it is made from
    some = lambda c: F.when(F.size("found") > 0, c)
    full = found.select("rid", "doc_id", "l", "found", some(_words(F.col("p"))).alias("w"), some(_words(F.col("tc"))).alias("c")).withColumn("s", some(_starts()))
    shown = F.transform(
        "found",
        lambda x: F.struct(
            x["k"].alias("k"),
            F.when(x["exact"], x["i"]).otherwise(F.get("s", x["i"])).alias("at"),
            F.when(x["exact"], x["i"] + 1).otherwise(F.get("s", x["i"] + 1)).alias("next"),
            x["h"].alias("h"),
            F.when(x["exact"], F.slice("l", x["i"] + 1, x["k"])).otherwise(_values(x["i"], x["k"])).alias("v"),
        ),
    )
    return full.select("rid", "doc_id", F.inline(some(shown)))


def _seen() -> Column:
    """For each word of the item in a matched window: its place x, template token t and the values i and d in item and document.

    Names in a row of unequal number are one value. Where the item begins or ends with names, the document's may go on
    beyond it; what belongs to the item is then known only where the values are the same, else d is null.
    """

    def word(j):
        i, d, at, t = F.get("item_v", j), F.get("v", j), F.get("item_s", j), F.get("item_t", j)
        iw, dw = F.split(i, " "), F.split(d, " ")
        more = F.size(dw) > F.size(iw)
        opens, closes = F.col("opens") & (j == 0), F.col("closes") & (j == F.col("k") - 1)
        same = (opens & d.endswith(F.concat(F.lit(" "), i))) | (closes & d.startswith(F.concat(i, F.lit(" "))))
        single = F.size(iw) == F.size(dw)
        return F.transform(
            iw,
            lambda w, m: F.struct(
                (at + m).alias("x"),
                t.alias("t"),
                F.when(single | same, w).otherwise(i).alias("i"),
                F.when(single, F.get(dw, m)).when(same, w).when(more & (opens | closes), F.lit(None).cast("string")).otherwise(d).alias("d"),
            ),
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), F.col("k") - 1), word))


def _slots(seen: Column) -> Column:
    """The distinct pairs of values in slots."""
    return F.array_distinct(F.transform(F.filter(seen, lambda o: o["t"].isin(NAME, NUMBER, UNIT) & o["d"].isNotNull()), lambda o: F.struct(o["i"].alias("i"), o["d"].alias("d"))))


def _places(seen: Column) -> Column:
    return F.array_distinct(F.transform(seen, lambda o: o["x"]))


def _stretches(places: Column) -> Column:
    """Of sorted places, those in stretches of a whole window."""
    starts = F.filter(places, lambda x, i: F.get(places, i + (WINDOW - 1)) == x + (WINDOW - 1))
    return F.array_distinct(F.flatten(F.transform(starts, lambda x: F.sequence(x, x + (WINDOW - 1)))))


def _named(seen: Column) -> Column:
    return F.array_distinct(F.filter(seen, lambda o: (o["t"] == NAME) & o["d"].isNotNull()))


def _consistent(bands: DataFrame) -> Column:
    """Whether most places of names agree with a mapping one to one: of pairs that contradict, the more frequent one
    holds, then the one of equal values, then the first."""

    def pair(o):
        here = F.filter("named", lambda p: (p["i"] == o["i"]) & (p["d"] == o["d"]))
        return F.struct(o["i"].alias("i"), o["d"].alias("d"), F.struct(F.size(here).alias("n"), (o["i"] == o["d"]).alias("same"), (-F.array_min(_places(here))).alias("x")).alias("weight"))

    pairs = F.array_distinct(F.transform("named", pair))
    beaten = lambda o: F.exists(pairs, lambda p: ((p["i"] == o["i"]) != (p["d"] == o["d"])) & (p["weight"] > o["weight"]))
    held = F.filter(pairs, lambda o: ~beaten(o))
    agreeing = F.filter("named", lambda o: F.exists(held, lambda g: (g["i"] == o["i"]) & (g["d"] == o["d"])))
    return F.size(_places(agreeing)) >= CONSISTENT * F.size(_places(F.col("named")))


def _accepted(bands: DataFrame, covered: float) -> Column:
    alike = (F.size("same") >= ALIKE * F.col("covered")) | (F.size(_stretches(F.col("same"))) >= covered * F.col("item_words"))
    return alike | _consistent(bands)


def _met(docs: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """The windows of documents that equal one of the about ``n`` benchmark windows, each with it."""
    lengths = sorted((r[0], r[1]) for r in windows.select("exact", "bk").distinct().collect()) or [(False, WINDOW)]
    slots = min(max(LEAST_SLOTS, 1 << (SLOTS * n).bit_length()), MOST_SLOTS)
    prefix = F.lit(None).cast("long")
    for exact, words in ((False, "item_t"), (True, "item_v")):
        if any(e == exact for e, _ in lengths):
            prefix = F.when(F.col("exact") == exact, _hash(F.col(words), F.lit(0), _prefix(lengths, exact), exact)).otherwise(prefix)
    here = _document_windows(docs, lengths, [_bitmap(windows.select(h), slots, shifts) for h, shifts in ((prefix, PREFIX_SHIFTS), ("bh", WHOLE_SHIFTS))])
    same = (F.col("h") == F.col("bh")) & (F.col("k") == F.col("bk"))
    hashed = windows.drop("exact")
    if n <= BROADCAST_ROWS:
        return here.join(F.broadcast(hashed), same)
    salted = hashed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return here.withColumn("own", F.pmod(F.xxhash64("rid", "at"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("own") == F.col("salt"))).drop("own", "salt")


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", covered: float = COVERED) -> DataFrame:
    """doc_id, item_id, where the item starts (in words), words covered, words of the item, slots, whether word for word."""
    windows = materialize(benchmark_windows(items, item_key, item_text), "benchmark-windows")
    n = windows.count()
    blocks = max(1, -(-n * SLOTS // MOST_SLOTS))
    words = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("doc_id"), plain(F.col(text)).alias("p"))
    parts = [_met(words, windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k), n // blocks) for k in range(blocks)]
    met = reduce(DataFrame.unionByName, parts)
    # a first token of names may be longer or shorter than the item's: what follows it tells the diagonal
    start = F.when(F.get("item_t", F.lit(0)) == NAME, F.col("next") - F.col("item_next")).otherwise(F.col("at") - F.col("item_at"))
    ids = ["rid", "doc_id", "item_id", "item_words"]
    runs = met.groupBy(*ids, start.alias("start")).agg(F.array_distinct(F.flatten(F.collect_list(_seen()))).alias("seen"))
    # each run goes to two bands, so that any runs less than a width apart meet in one
    width = F.lit(WINDOW) + F.floor(F.col("item_words") / 4)
    band = F.floor(F.col("start") / width)
    runs = runs.withColumn("main", F.struct(F.size(_places(F.col("seen"))).alias("covered"), (-F.col("start")).alias("before"), _slots(F.col("seen")).alias("pairs")))
    bands = runs.withColumn("band", F.explode(F.array(band - 1, band))).groupBy(*ids, "band").agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.max("main").alias("main"))
    same = F.filter("seen", lambda o: o["i"] == o["d"])
    bands = bands.withColumn("covered", F.size(_places(F.col("seen")))).where(F.col("covered") >= covered * F.col("item_words")).withColumn("same", F.array_sort(_places(same)))
    run = F.struct("covered", F.col("main.before").alias("before"), (F.size("same") == F.col("covered")).alias("verbatim"), F.size("main.pairs").alias("slots"))
    bands = bands.withColumn("named", _named(F.col("seen")))
    best = bands.where(_accepted(bands, covered)).groupBy(*ids).agg(F.max(run).alias("run"))
    return best.select("doc_id", "item_id", (-F.col("run.before")).cast("int").alias("start"), "run.covered", "item_words", "run.slots", "run.verbatim")
