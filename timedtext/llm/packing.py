"""Packing token sequences by cutting-stock column generation.

A document's ids, with an end id after them, are cut every ``capacity`` ids; full pieces are sequences by themselves.
The last pieces are counted by length class (a class spans ``capacity / classes`` lengths). A linear program over
patterns - multisets of classes that fit one sequence - covers the histogram with the fewest sequences; columns are
generated by pricing: an unbounded knapsack over the duals, solved by dynamic programming. The solution is rounded down
and what remains is filled first-fit by decreasing class. Pieces are ranked within their class and take the slots of the
patterns in order of rank, so the program's size depends on the classes alone, and each row finds its own slot.

Defined results: a null or empty text is the end id alone. Repeated rows each get their pieces. An empty table gives an
empty result. Extra columns are ignored.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timedtext.llm.common import materialize, number_within, small_batches, tidy
from timedtext.llm.tokens import encoder

CAPACITY = 1024
CLASSES = 128
END = 0


def price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: item k (from 1) has size k and value duals[k - 1]."""
    value = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, int)
    for w in range(1, capacity + 1):
        options = value[w - 1 :: -1][: len(duals)] + duals[: w if w < len(duals) else len(duals)]
        k = int(options.argmax())
        if options[k] > value[w - 1] + 1e-12:
            value[w], took[w] = options[k], k + 1
        else:
            value[w] = value[w - 1]
    pattern, w = np.zeros(len(duals), int), capacity
    while w > 0:
        if took[w]:
            pattern[took[w] - 1] += 1
            w -= took[w]
        else:
            w -= 1
    return float(value[capacity]), pattern


def generate(demand: np.ndarray, capacity: int, most: int = 3_000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used in the linear program's solution."""
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    if not m:
        return []
    need = demand[sizes - 1].astype(float)
    basis = np.diag(np.maximum(capacity // sizes, 1)).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    # products are written element by element: the matrices are small, and a threaded linear algebra library was seen to hang beside the JVM
    times = lambda v: (inverse * v).sum(axis=1)
    for _ in range(most):
        duals = inverse.sum(axis=0)
        full = np.zeros(capacity)
        full[sizes - 1] = np.maximum(duals, 0)
        worth, pattern = price(full, capacity)
        if worth <= 1 + 1e-9:
            break
        column = pattern[sizes - 1].astype(float)
        d, x = times(column), times(need)
        up = d > 1e-9
        if not up.any():
            break
        ratios = np.where(up, x / np.where(up, d, 1), np.inf)
        out = int(ratios.argmin())
        basis[:, out] = column
        pivot = inverse[out] / d[out]
        inverse = inverse - d[:, None] * pivot
        inverse[out] = pivot
    used = times(need)
    made = []
    for k in range(m):
        pattern = np.zeros(capacity, int)
        pattern[sizes - 1] = basis[:, k].round().astype(int)
        made.append((pattern, float(max(used[k], 0))))
    return made


def plan(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns and their numbers of sequences that together hold exactly ``demand`` (item k has size k + 1)."""
    left = demand.astype(int).copy()
    out: list[tuple[np.ndarray, int]] = []
    for pattern, x in sorted(generate(demand, capacity), key=lambda p: -p[1]):
        here = pattern > 0
        times = min(int(x + 1e-9), int((left[here] // pattern[here]).min()) if here.any() else 0)
        if times > 0:
            out.append((pattern, times))
            left -= pattern * times
    while left.any():
        pattern, room = np.zeros(len(left), int), capacity
        for k in range(min(room, len(left)), 0, -1):
            n = min(int(left[k - 1]), room // k)
            pattern[k - 1], room = n, room - n * k
        here = pattern > 0
        times = int((left[here] // pattern[here]).min())
        out.append((pattern, times))
        left -= pattern * times
    return out


def slots(planned: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, rank after the last, items of the class in a sequence, first sequence, first slot)."""
    rows, seen, sequence = [], {}, 0
    for pattern, times in planned:
        slot = 0
        for k in np.flatnonzero(pattern)[::-1]:
            c, per = int(k) + 1, int(pattern[k])
            lo = seen.get(c, 0)
            seen[c] = lo + per * times
            rows.append((c, lo, seen[c], per, sequence, slot))
            slot += per
        sequence += times
    return rows


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        for pdf in batches:
            ids_of, rows = [], []
            for doc_id, t in zip(pdf["doc_id"], pdf["text"]):
                ids = np.append(encode(t), np.uint32(END)).astype("<u4")
                n = len(ids)
                rows += [(a, min(capacity, n - a), zlib.crc32(ids[a : a + capacity].tobytes()), n) for a in range(0, n, capacity)]
                ids_of += [None if doc_id is None else int(doc_id)] * (len(rows) - len(ids_of))
            out = pd.DataFrame(rows, columns=["start", "length", "ids_crc32", "doc_tokens"])
            out.insert(0, "doc_id", pd.array(ids_of, dtype="Int64"))
            yield out

    small_batches(docs.sparkSession)
    # ids as text: pandas would turn a column of integers with nulls into floats
    return docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(tidy(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, classes: int = CLASSES, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """The pieces of every document with the sequence each goes to and its offset there."""
    spark = docs.sparkSession
    width = capacity // classes
    made = materialize(pieces(docs, key, text, capacity, vocabulary).withColumn("class", F.ceil(F.col("length") / width).cast("int")), "pieces")
    demand = np.zeros(classes, int)
    for r in made.where(F.col("length") < capacity).groupBy("class").count().collect():
        demand[r[0] - 1] = r[1]
    planned = plan(demand, classes)
    # at most a row for each class of each pattern, and there are few more patterns than classes: broadcast below
    table = spark.createDataFrame(slots(planned), "class int, lo long, hi long, per long, sequence long, slot long")
    order = ["doc_id", "start", "ids_crc32"]
    ranked = number_within(made.where(F.col("length") < capacity), ["class"], order, "rank")
    placed = ranked.join(F.broadcast(table), (ranked["class"] == table["class"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        *order,
        "length",
        "doc_tokens",
        (F.col("sequence") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("slot") + (F.col("rank") - F.col("lo")) % F.col("per")).alias("slot"),
    )
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    packed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    first = sum(times for _, times in planned)
    full = number_within(made.where(F.col("length") == capacity), [], order, "rank")
    alone = full.select(*order, "length", "doc_tokens", (F.col("rank") + first).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return packed.select(*columns).unionByName(alone.select(*columns))
