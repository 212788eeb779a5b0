"""Packed token-id matrices by best-fit-decreasing.

Documents are taken in blocks of rows of one input partition, so no row moves. Overlong documents are cut into pieces
of the capacity and a rest, without loss. The pieces of a block, longest first, go into the open row with the least
room that suffices; a segment tree over capacities finds it. Each row of the result is one matrix row: its ids as
little-endian integers, padded to the capacity, the cumulative lengths of its segments, where positions restart, and
the document and start of every segment, from which the texts' ids can be put together again.

Defined results: a null or empty text is the end id alone. Repeated rows each get their segments. An empty table gives
an empty result. Extra columns are ignored. Row ids are unique; they follow the input partitions.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedtext.llm.common import tidy
from timedtext.llm.tokens import encoder

CAPACITY = 1024
END = 0
#: Ids that a block may hold before it is packed.
BLOCK = 2_000_000
SCHEMA = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, starts array<long>"


class Room:
    """Open rows by the room they have left, in a segment tree of counts over 0..capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``least``."""
        k = least + self.size
        if not self.count[k]:
            # up to the first right sibling that holds a row, then down its left side
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.size
        row = self.rows[room].pop()
        self._add(room, -1)
        return room, row

    def _add(self, room: int, n: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += n
            k >>= 1


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items of each row, longest items placed first, each where the least room suffices."""
    rows: list[list[int]] = []
    room = Room(capacity)
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[k]
        found = room.take(n)
        if found is None:
            rows.append([k])
            left, row = capacity - n, len(rows) - 1
        else:
            left, row = found[0] - n, found[1]
            rows[row].append(k)
        if left:
            room.put(left, row)
    return rows


def write_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", dtype: str = "<u2") -> DataFrame:
    """One row for each packed sequence. ``dtype`` holds the ids; one that does not fit is an error, never another id."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, base, made = encoder(vocabulary), TaskContext.get().partitionId() << 33, 0
        owners, starts, parts, held = [], [], [], 0
        most = np.iinfo(dtype).max

        def block():
            nonlocal made, owners, starts, parts, held
            rows = best_fit([len(p) for p in parts], capacity)
            ids, cuts = [], []
            for r in rows:
                out = np.zeros(capacity, dtype)
                at = [0]
                for k in r:
                    out[at[-1] : at[-1] + len(parts[k])] = parts[k]
                    at.append(at[-1] + len(parts[k]))
                ids.append(out.tobytes())
                cuts.append(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(base + made, base + made + len(rows)), pa.int64()),
                    pa.array([c[-1] for c in cuts], pa.int32()),
                    pa.array(ids, pa.binary()),
                    pa.array(cuts, pa.list_(pa.int32())),
                    pa.array([c[:-1] for c in cuts], pa.list_(pa.int32())),
                    pa.array([[owners[k] for k in r] for r in rows], pa.list_(pa.int64())),
                    pa.array([[starts[k] for k in r] for r in rows], pa.list_(pa.int64())),
                ],
                ["sequence_id", "n_tokens", "ids", "cu_seqlens", "resets", "doc_ids", "starts"],
            )
            made += len(rows)
            owners, starts, parts, held = [], [], [], 0

        for batch in batches:
            for doc_id, t in zip(batch.column(0), batch.column(1)):
                got = np.append(encode(t.as_py()), END)
                if got.max() > most:
                    raise ValueError(f"the vocabulary {vocabulary} has the id {got.max()}, which {dtype} does not hold")
                got = got.astype(dtype)
                for a in range(0, len(got), capacity):
                    owners.append(doc_id.as_py())
                    starts.append(a)
                    parts.append(got[a : a + capacity])
                held += len(got)
                if held >= BLOCK:
                    yield from block()
        if parts:
            yield from block()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(packed), SCHEMA)


def unpack(rows: list, dtype: str = "<u2") -> dict:
    """doc_id -> ids, from collected rows; for tests and readers of small results."""
    found: dict = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype)
        cuts = r["cu_seqlens"]
        for k, (doc, start) in enumerate(zip(r["doc_ids"], r["starts"])):
            found.setdefault(doc, []).append((start, ids[cuts[k] : cuts[k + 1]]))
    return {d: np.concatenate([x for _, x in sorted(v, key=lambda y: y[0])]) for d, v in found.items()}
