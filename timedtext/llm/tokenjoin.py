"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct five-word shingles (a shorter text: its whole word sequence). Two documents link
when their sets' Jaccard similarity reaches the threshold; the result has the components of the links.

How links are found, all of them:

1. ``profile`` reads the texts once: the key of each word sequence, the size of its set, and the shingles that repeat
   within a block of documents. Shingles in more than 1/2000 of all documents are *hot*; at most 2000 times the mean set
   size can be, so they are broadcast. Equal texts share a key and go on as one document.
2. ``deal`` reads the texts again and sends the other shingles, packed, to ranges of their hash. There, in ``shared``, each
   shingle's document frequency is known; shingles of one document only - nearly all - end there. The rest goes back to
   its document.
3. In ``index`` a global order of shingles is known: rare first, ties by hash. A set can only link if enough of it is shared, so most
   documents drop out without being compared. The others index prefixes: single shingles of the rare class; of the
   frequent class, whose lists are long, combinations of two within each of several sub-classes, with the prefix extended
   so that two linked sets share at least one signature: a prefix with n1 rare shingles and n(c) of sub-class c holds
   ``n1 + sum(n(c) - 1) > size - overlap``, so the shingles missing from the other set can break neither all
   singles nor all combinations. The number of sub-classes follows the size of the set; as linked sets differ in size by
   at most a quarter, a document indexes its own size band and the next.
4. Candidates are verified on the shared shingles, which hold every common one. First each document against one
   document of its fullest signature lists; components of the links found leave few lists with several components. There
   only documents of different components are compared: beside a large component in blocks, the others in pairs that
   can still share enough from the shingle where they meet. Pairs within a component are never formed.

Defined results: a null text or one without words has size 0 and links with nothing. Repeated rows have equal results.
A component's id is its smallest id. An empty table gives an empty result. Extra columns are ignored. Shingles are compared by
48 bits and keys by 64 bits of fixed hashes: within a pair of sets of 20 000 a chance agreement of one shingle has probability 1e-6.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedtext.llm.common import SPACES, Scratch, fixed_uint64, materialize, mixed, release, small_batches, tidy

WORDS = 5
#: Shingles a task gathers before it hands them on, and documents.
BLOCK_SHINGLES, BLOCK_DOCS = 600_000, 60_000
#: A hot shingle is in more than 1/HOT of the documents.
HOT = 2_000
#: Document frequency above which a shingle is of the frequent class.
FREQUENT = 64
#: Documents of one component in a list from which its members are compared in blocks, and documents on a block's side.
BIG, BLOCK_SIDE = 16, 512
#: Shingles in a range of hashes, about.
RANGE = 1_500_000
#: Tasks of a stage that takes ranges; more ranges than that are taken in turn, so memory stays that of one range.
MAX_TASKS = 20_000
#: Ranges that shingles are dealt to at once. Where there are more, they go to groups of ranges first, and tasks that gather
#: ``REGROUP`` shingles of a group deal those to its ranges, so that rows stay long.
COARSE, REGROUP = 2_000, 4_000_000
#: Documents of a list from which they are compared in blocks, whatever their components, and salts of a component's members.
LONG_LIST, SALTS = 64, 32
LOW48 = np.uint64((1 << 48) - 1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
_BYTE = fixed_uint64(256, 1)
_PLACE = fixed_uint64(4096, 2)
_CHAIN = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in bytes that end with a space."""
    space = _SPACE[data]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & before)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lengths = np.flatnonzero(space & ~before) - starts
    at = np.flatnonzero(~space)
    first = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    place = at - np.repeat(starts, lengths)
    value = _BYTE[_LOWER[data[at]]] * _PLACE[place & 4095]
    if lengths.max() > 4096:
        value *= np.uint64(1) + np.uint64(2) * (place >> 12).astype(np.uint64)
    return starts, mixed(np.add.reduceat(value, first) + lengths.astype(np.uint64) * _CHAIN)


def _order(n: int) -> np.ndarray:
    return fixed_uint64(n, 3)


def sets_of(texts: list[bytes]) -> Iterator[tuple[int | None, np.ndarray]]:
    """(key, distinct shingles) of each text; no key without words."""
    k = 0
    while k < len(texts):
        group, held = [], 0
        while k < len(texts) and (not group or held + len(texts[k]) < 300_000):
            group.append(texts[k])
            held += len(texts[k])
            k += 1
        starts, hashes = word_hashes(np.frombuffer(b"\n".join(group) + b"\n", np.uint8))
        ends = np.cumsum([len(t) + 1 for t in group])
        cut = np.searchsorted(starts, np.concatenate([[0], ends]))
        chain = hashes[: max(len(hashes) - WORDS + 1, 0)]
        for i in range(1, WORDS):
            chain = mixed(chain * _CHAIN + hashes[i : len(hashes) - WORDS + 1 + i])
        for a, b in zip(cut[:-1], cut[1:]):
            n = int(b - a)
            if n == 0:
                yield None, np.zeros(0, np.uint64)
                continue
            words = hashes[a:b]
            key = int(mixed(np.array([(words * _order(n)).sum() + np.uint64(n)], np.uint64)).view(np.int64)[0])
            if n >= WORDS:
                yield key, np.unique(chain[a : b - WORDS + 1] & LOW48)
            else:
                whole = np.array([n], np.uint64)
                for w in words:
                    whole = mixed(whole * _CHAIN + w)
                yield key, whole & LOW48


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Blocks of documents new to this task: lists of keys and sets; and each row's (id, key, size)."""
    seen: set[int] = set()
    keys, sets, held = [], [], 0
    for batch in batches:
        # a few rows at a time become Python objects
        for at in range(0, batch.num_rows, 256):
            rows = []
            ids, texts = (batch.column(i).slice(at, 256).to_pylist() for i in (0, 1))
            for doc_id, (key, found) in zip(ids, sets_of([(t or "").encode("utf-8", "replace") for t in texts])):
                rows.append((doc_id, key, len(found)))
                if key is not None and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(found)
                    held += len(found)
                    if held >= BLOCK_SHINGLES or len(keys) >= BLOCK_DOCS:
                        yield rows, keys, sets
                        rows, keys, sets, held = [], [], [], 0
            yield rows, None, None
    yield [], keys, sets


def profile(docs: DataFrame) -> DataFrame:
    """Rows of kind 0: doc_id, key, size; of kind 1: a shingle that repeats in a block, and how often."""
    columns = ["kind", "doc_id", "key", "size"]

    def run(batches):
        for rows, keys, sets in _blocks(batches):
            if rows:
                ids, names, sizes = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(0, pa.int32()), len(ids)), pa.array(ids, pa.int64()), pa.array(names, pa.int64()), pa.array(sizes, pa.int64())], columns)
            if keys:
                found, counts = np.unique(np.concatenate(sets), return_counts=True)
                often = counts >= max(4, len(keys) // HOT)
                found, counts = found[often].astype(np.int64), counts[often]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(1, pa.int32()), len(found)), pa.nulls(len(found), pa.int64()), pa.array(found), pa.array(counts, pa.int64())], columns)

    return docs.mapInArrow(tidy(run), "kind int, doc_id long, key long, size long")


def _pack(part, tokens, counts, docs, keys, sizes) -> tuple:
    """One packed row: shingles, their frequencies (0 where unknown), documents by number in the row's own table."""
    own, at = np.unique(docs, return_inverse=True)
    small = np.uint16 if len(own) <= 65535 else np.uint32
    gaps = np.diff(tokens, prepend=np.uint64(0))
    narrow = len(gaps) > 1 and gaps[1:].max() < 1 << 32
    body = tokens[:1].tobytes() + gaps[1:].astype("<u4").tobytes() if narrow else tokens.astype("<u8").tobytes()
    return part, len(tokens), body, counts.astype("<u4").tobytes() if counts is not None else b"", at.astype(small).tobytes(), keys[own].tobytes(), sizes[own].astype("<u4").tobytes()


PACKED = "part int, n int, tokens binary, counts binary, docs binary, keys binary, sizes binary"
_COLUMNS = ["part", "n", "tokens", "counts", "docs", "keys", "sizes"]


def _unpack(pdf: pd.DataFrame):
    """Shingles, frequencies, keys and sizes of all packed rows, one entry for each posting."""
    tokens, counts, keys, sizes = [], [], [], []
    for r in pdf.itertuples():
        own = np.frombuffer(r.keys, np.int64)
        if len(r.tokens) == 8 * r.n:
            tokens.append(np.frombuffer(r.tokens, "<u8"))
        else:
            gaps = np.frombuffer(r.tokens[8:], "<u4").astype(np.uint64)
            tokens.append(np.cumsum(np.concatenate([np.frombuffer(r.tokens[:8], "<u8"), gaps]), dtype=np.uint64))
        at = np.frombuffer(r.docs, np.uint16 if len(own) <= 65535 else np.uint32)
        keys.append(own[at])
        sizes.append(np.frombuffer(r.sizes, "<u4")[at])
        counts.append(np.frombuffer(r.counts, "<u4") if r.counts else np.zeros(r.n, np.uint32))
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.concatenate(tokens), np.concatenate(counts), np.concatenate(keys), np.concatenate(sizes)


def _spread(packed: DataFrame, parts: int) -> DataFrame:
    """Each part's rows side by side in one task; beyond MAX_TASKS parts a task takes several, one after the other."""
    tasks = min(parts, MAX_TASKS)
    out = packed.repartitionById(tasks, F.col("part") % tasks)
    return out.sortWithinPartitions("part") if parts > tasks else out


def _by_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one part at a time."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        for part, rows in pdf.groupby("part", sort=False):
            if held and held[0]["part"].iloc[0] != part:
                yield pd.concat(held)
                held = []
            held.append(rows)
    if held:
        yield pd.concat(held)


def bounds_of(parts: int, groups: int) -> np.ndarray:
    """The first hash of each group of ranges but the first one."""
    return np.array([(-(-g * parts // groups) << 48) // parts for g in range(1, groups)], np.uint64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each document."""
    return (mixed(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def regroup(packed: DataFrame, parts: int, by_key: bool) -> DataFrame:
    """Rows of groups of parts as rows of the parts. A group's rows may go to several tasks, so none is too long."""
    groups = min(parts, COARSE)
    if groups == parts:
        return packed
    bounds = bounds_of(parts, parts) if not by_key else None
    salts = -(-parts // (64 * groups))
    tasks = min(groups * salts, MAX_TASKS)

    def run(batches):
        held, n = {}, 0
        for pdf in batches:
            for part, rows in pdf.groupby("part", sort=False):
                held.setdefault(part, []).append(rows)
                n += int(rows["n"].sum())
            if n >= REGROUP:
                yield from flush(held)
                held, n = {}, 0
        yield from flush(held)

    def flush(held):
        for rows in held.values():
            rows = pd.concat(rows)
            for counted in (True, False):
                some = rows[(rows["counts"].map(len) > 0) == counted]
                t, c, k, s = _unpack(some)
                if not len(t):
                    continue
                to = part_of(k, parts) if by_key or counted else np.searchsorted(bounds, t, "right")
                order = np.lexsort((t, to))
                t, c, k, s, to = t[order], c[order], k[order], s[order], to[order]
                out = []
                for a, b in _runs(to):
                    own, first, at = np.unique(k[a:b], return_index=True, return_inverse=True)
                    out.append(_pack(int(to[a]), t[a:b], c[a:b] if counted else None, at, own, s[a:b][first]))
                    if len(out) >= 256:
                        yield pd.DataFrame(out, columns=_COLUMNS)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=_COLUMNS)

    to = F.pmod(F.xxhash64("part", F.pmod(F.xxhash64("keys"), F.lit(salts))), F.lit(tasks)).cast("int")
    return packed.repartitionById(tasks, to).mapInPandas(tidy(run), PACKED)


def deal(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], parts: int) -> DataFrame:
    """Packed postings by range of the shingle's hash, or by group of ranges where there are many; hot shingles carry
    their frequency already."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)
    groups = min(parts, COARSE)
    bounds = bounds_of(parts, groups)

    def run(batches):
        names, freqs = sent.value
        for _, keys, sets in _blocks(batches):
            if not keys:
                continue
            sizes = np.array([len(x) for x in sets], np.uint32)
            tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            keys = np.array(keys, np.int64)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            counts = np.zeros(len(tokens), np.uint32)
            if len(names):
                at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
                is_hot = names[at] == tokens
                counts[is_hot] = freqs[at[is_hot]]
            else:
                is_hot = np.zeros(len(tokens), bool)
            rows = []
            # hot shingles need no counting: they ride along with their document, to a part chosen by its key
            if is_hot.any():
                t, c, o = tokens[is_hot], counts[is_hot], owner[is_hot]
                to = part_of(keys, parts)[o] * groups // parts
                by = np.lexsort((t, to))
                t, c, o, to = t[by], c[by], o[by], to[by]
                for a, b in _runs(to):
                    rows.append(_pack(int(to[a]), t[a:b], c[a:b], o[a:b], keys, sizes))
            t, o = tokens[~is_hot], owner[~is_hot]
            cut = np.concatenate([[0], np.searchsorted(t, bounds), [len(t)]])
            rows += [_pack(p, t[a:b], None, o[a:b], keys, sizes) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=_COLUMNS).astype({"part": "int32", "n": "int32"}), preserve_index=False)

    return docs.mapInArrow(tidy(run), PACKED)


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    cut = np.concatenate([[0], edge, [len(sorted_values)]])
    return [(int(a), int(b)) for a, b in zip(cut[:-1], cut[1:]) if b > a]


def shared(dealt: DataFrame, parts: int) -> DataFrame:
    """Packed postings of shingles that two documents or more hold, with their frequency, by part of the document's key, or
    by group of parts where there are many."""
    groups = min(parts, COARSE)

    def run(batches):
        for pdf in _by_part(batches):
            yield from one(pdf)

    def one(pdf):
        known = pdf["counts"].map(len) > 0
        ht, hc, hk, hs = _unpack(pdf[known])
        t, _, k, s = _unpack(pdf[~known])
        del pdf
        order = np.argsort(t, kind="stable")
        t, k, s = t[order], k[order], s[order]
        if len(t):
            same = t[1:] == t[:-1]
            more = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            t, k, s = t[more], k[more], s[more]
        if len(t):
            order = np.lexsort((k, t))
            t, k, s = t[order], k[order], s[order]
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
            t, k, s = t[new], k[new], s[new]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            n = np.diff(np.concatenate([first, [len(t)]]))
            c = np.repeat(n, n).astype(np.uint32)
            t, k, s, c = t[c > 1], k[c > 1], s[c > 1], c[c > 1]
        else:
            c = np.zeros(0, np.uint32)
        t, k, s, c = np.concatenate([t, ht]), np.concatenate([k, hk]), np.concatenate([s, hs]), np.concatenate([c, hc])
        if not len(t):
            return
        to = part_of(k, parts) * groups // parts
        order = np.lexsort((t, to))
        t, k, s, c, to = t[order], k[order], s[order], c[order], to[order]
        rows = []
        for a, b in _runs(to):
            own, first, at = np.unique(k[a:b], return_index=True, return_inverse=True)
            rows.append(_pack(int(to[a]), t[a:b], c[a:b], at, own, s[a:b][first]))
            if len(rows) >= 64:
                yield pd.DataFrame(rows, columns=_COLUMNS)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return _spread(dealt, parts).mapInPandas(tidy(run), PACKED)


def band(n: int, percent: int) -> int:
    """The band of a size: linked sizes lie in one band or in neighbours."""
    return int(np.floor(np.log(max(n, 1)) / np.log(100 / percent) + 1e-9))


def signatures(tokens: np.ndarray, counts: np.ndarray, size: int, percent: int, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of one set, and for each the most shingles a set that first meets it there can share.

    tokens: its shared shingles; the other size - len(tokens) come first in the order and are in no other set.
    """
    spare = size - -(-size * percent // 100)  # shingles that may be missing from a linked set
    own = size - len(tokens)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if own > spare:
        return none
    if size == 1:
        return mixed(tokens ^ np.uint64(0xA5A5)), np.ones(1, np.int64)
    order = np.lexsort((tokens, counts))
    t, c = tokens[order], counts[order]
    need = spare + 1 - own
    rare = int((c <= frequent).sum())
    single = min(rare, need)
    # a single's place bounds what follows it; nothing bounds where in its sub-class a combination begins
    sigs, room = [mixed(t[:single] ^ np.uint64(0xA5A5))], [len(tokens) - np.arange(single)]
    if rare < need:
        f = t[rare:]
        b = band(size, percent)
        for at in (b, b + 1):
            groups = max(1, int((100 / percent) ** at) // 8)
            cls = (mixed(f) % np.uint64(groups)).astype(np.int64)
            # the first of each sub-class adds nothing to the sum, every other one adds one
            first = np.zeros(len(f), bool)
            first[np.unique(cls, return_index=True)[1]] = True
            end = min(int(np.searchsorted(np.cumsum(~first), need - rare)) + 1, len(f))
            g, x = cls[:end], f[:end]
            by = np.argsort(g, kind="stable")
            g, x = g[by], x[by]
            for lo, hi in _runs(g):
                i, j = np.triu_indices(hi - lo, 1)
                y, z = x[lo:hi][i], x[lo:hi][j]
                sigs.append(mixed(mixed(np.minimum(y, z)) * _CHAIN + np.maximum(y, z) + np.uint64(at)))
                room.append(np.full(len(y), len(tokens)))
    found, first = np.unique(np.concatenate(sigs), return_index=True)
    return found, np.concatenate(room)[first]


INDEX = "kind int, key long, size long, tokens binary, sig long, room long, own int"


def index(packed: DataFrame, parts: int, percent: int, frequent: int = FREQUENT) -> DataFrame:
    """Of documents that can link: kind 0, key, size and shared shingles; kind 1, signature, key, size, room, and the
    part of the set (in thousandths) that no other set holds."""

    def run(batches):
        for pdf in _by_part(batches):
            yield from one(pdf)

    def one(pdf):
        t, c, k, s = _unpack(pdf)
        del pdf
        order = np.lexsort((t, k))
        t, c, k, s = t[order], c[order], k[order], s[order]
        if not len(t):
            return
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
        t, c, k, s = t[new], c[new], k[new], s[new]
        live, sigs, held = [], [], 0
        for a, b in _runs(k):
            size = int(s[a])
            found, room = signatures(t[a:b], c[a:b], size, percent, frequent)
            if len(found):
                live.append((int(k[a]), size, t[a:b].astype("<u8").tobytes()))
                sigs.append((found.view(np.int64), room, int(k[a]), size, (size - (b - a)) * 1000 // size))
                held += len(found)
            if held > 300_000:
                yield from _indexed(live, sigs)
                live, sigs, held = [], [], 0
        yield from _indexed(live, sigs)

    return _spread(packed, parts).mapInPandas(tidy(run), INDEX)


def _indexed(live, sigs):
    if live:
        yield pd.DataFrame({"kind": 0, "key": [x[0] for x in live], "size": [x[1] for x in live], "tokens": [x[2] for x in live], "sig": 0, "room": 0, "own": 0})
        n = [len(x[0]) for x in sigs]
        each = lambda i: np.repeat([x[i] for x in sigs], n)
        flat = lambda i: np.concatenate([x[i] for x in sigs])
        yield pd.DataFrame({"kind": 1, "key": each(2), "size": each(3), "tokens": [None] * sum(n), "sig": flat(0), "room": flat(1), "own": each(4)})


def verify(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches):
        for pdf in batches:
            keep = []
            for x, y, n, m in zip(pdf["x"], pdf["y"], pdf["n"], pdf["m"]):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(100 * common >= percent * (n + m - common))
            yield pdf.loc[keep, ["a", "b"]]

    left = live.select(F.col("key").alias("a"), F.col("size").alias("n"), F.col("tokens").alias("x"))
    right = live.select(F.col("key").alias("b"), F.col("size").alias("m"), F.col("tokens").alias("y"))
    both = pairs.join(left, "a").join(right, "b").where((100 * F.col("n") >= percent * F.col("m")) & (100 * F.col("m") >= percent * F.col("n")))
    return both.select("a", "b", "n", "m", "x", "y").mapInPandas(tidy(run), "a long, b long")


def verify_blocks(members: DataFrame, loose: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the documents ``loose`` (key, main) with each other and with the members (key, main) of the
    component they have met. Both sides are cut into blocks, every pair of blocks is one task's work, and no pair becomes
    a row."""
    members = members.unionByName(loose)
    count = lambda df: df.groupBy("main").agg(F.ceil(F.count("*") / BLOCK_SIDE).cast("int").alias("n"))
    cuts = count(members).withColumnRenamed("n", "nm").join(count(loose).withColumnRenamed("n", "nl"), "main")
    block = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # a component may hold a third of all documents: its members are joined with its numbers salt by salt
    cuts = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(SALTS)).cast("int")).join(cuts, ["main", "salt"])
    one = salted(members).select("main", "key", F.lit(True).alias("member"), block("nm").alias("i"), every("nl").alias("j"))
    two = salted(loose).select("main", "key", F.lit(False).alias("member"), every("nm").alias("i"), block("nl").alias("j"))
    rows = one.unionByName(two).join(live, "key")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        inside = pdf[pdf["member"]]
        sets = [np.frombuffer(x, "<u8") for x in inside["tokens"]]
        sizes, names = inside["size"].to_numpy(), inside["key"].to_numpy()
        if not len(sets):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        a, b = [], []
        outside = pdf[~pdf["member"]]
        for key, size, raw in zip(outside["key"], outside["size"], outside["tokens"]):
            mine = np.frombuffer(raw, "<u8")
            lo, hi = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(sets))
            hit = np.flatnonzero((100 * common >= percent * (size + sizes - common)) & (names != key))
            a += [key] * len(hit)
            b += list(names[hit])
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return rows.select("main", "i", "j", "member", "key", "size", "tokens").groupBy("main", "i", "j").applyInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(key, comp) of every key of the edges (a, b): the smallest key it reaches, by alternating large and small stars."""
    pair = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(pair, "edges")
    while True:
        # done when every key has one parent and no parent has a parent
        roles = now.select("u", F.lit(1).alias("child")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("child"))).groupBy("u").agg(F.sum("child").alias("n"), F.min("child").alias("least"))
        if not roles.where("n > 1 or (n = 1 and least = 0)").limit(1).count():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        then = materialize(small, "edges")
        release(now)
        now = then
    return now.select(F.col("u").alias("key"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("key"), F.col("v").alias("comp")).distinct())


def roots(forest: DataFrame) -> DataFrame:
    """(key, comp): the root above each key of a forest of (a parent, b child), one parent each, by pointer jumping. Roots
    themselves have no row."""
    now, jumped = forest.select(F.col("b").alias("key"), F.col("a").alias("comp")), None
    while True:
        above = now.select(F.col("key").alias("comp"), F.col("comp").alias("next"))
        before, jumped = jumped, materialize(now.join(above, "comp", "left").select("key", F.coalesce("next", "comp").alias("comp"), F.col("next").isNotNull().alias("moved")), "roots")
        if before is not None:
            release(before)
        now = jumped.select("key", "comp")
        if not jumped.where("moved").limit(1).count():
            return now


def linked_keys(docs: DataFrame, seen: DataFrame, percent: int, frequent: int, scratch: Scratch) -> DataFrame:
    """(key, comp) of the documents that link with another."""
    spark = docs.sparkSession
    sums = seen.where("kind = 0").agg(F.count("*").alias("docs"), F.sum("size").alias("shingles")).first()
    least = max(8, (sums["docs"] or 0) / HOT)
    # at most HOT times the mean set size pass this bound
    hot = seen.where("kind = 1").groupBy("key").agg(F.sum("size").alias("n")).where(F.col("n") >= least).orderBy("key").collect()
    hot = np.array([r[0] for r in hot], np.uint64), np.array([min(r[1], 2**32 - 1) for r in hot], np.uint32)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sums["shingles"] or 0) // RANGE))
    dealt = regroup(deal(docs, hot, parts), parts, by_key=False)
    back = regroup(shared(dealt, parts), parts, by_key=True)
    table = scratch.table(index(back, parts, percent, frequent), "join-index")
    live = table.where("kind = 0").select("key", "size", "tokens")
    sigs = table.where("kind = 1").select("sig", "key", F.col("size").alias("n"), "room", "own")
    # the head of a list is the document with the smallest part of its own: near the middle of a group of copies
    lists = sigs.groupBy("sig").agg(F.min(F.struct("own", "key"))["key"].alias("first"), F.count("*").alias("docs")).where("docs > 1")
    met = scratch.table(sigs.join(lists.select("sig", "first"), "sig"), "join-lists")
    # one partner each: the head of most of its lists
    heads = met.where("key <> first").groupBy("key", "first").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("first", F.struct("n", F.col("first"))).alias("first"))
    one = scratch.table(verify(heads.select(F.col("first").alias("a"), F.col("key").alias("b")), live, percent), "links")
    comps = scratch.table(roots(one), "roots")  # the head of a list comes before its members by (own, key), so heads form a forest
    labelled = met.drop("first", "own").join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    counted = labelled.groupBy("sig", "comp").agg(F.count("*").alias("docs"))
    split = counted.groupBy("sig").agg(F.max(F.struct("docs", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("docs").alias("all")).where("comps > 1")
    big = (F.col("top.docs") >= BIG) | (F.col("all") >= LONG_LIST)
    rest = scratch.table(labelled.join(split.select("sig", F.col("top.comp").alias("main"), big.alias("big")), "sig"), "join-mixed")
    # long lists and those with a large component: its members against the others and those with each other, in blocks
    loose = rest.where("big and comp <> main").select("key", "main").distinct()
    members = rest.where("big and comp = main").select("key", "main").distinct()
    blocks = verify_blocks(members, loose, live, percent)
    # the short lists: pairs of different components that can share enough from where they meet
    left = rest.where("not big").select("sig", F.col("key").alias("p"), F.col("comp").alias("pc"), F.col("n").alias("pn"), F.col("room").alias("pr"))
    right = left.withColumnsRenamed({"p": "q", "pc": "qc", "pn": "qn", "pr": "qr"})
    enough = (100 + percent) * F.least("pr", "qr") >= percent * (F.col("pn") + F.col("qn"))
    across = left.join(right, "sig").where((F.col("p") < F.col("q")) & (F.col("pc") != F.col("qc")) & enough)
    pairs = across.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()
    more = scratch.table(verify(pairs, live, percent).unionByName(blocks), "links")
    of = lambda c: comps.select(F.col("key").alias(c), F.col("comp").alias(f"{c}c"))
    joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
    merged = scratch.table(components(joined), "components").select(F.col("key").alias("comp"), F.col("comp").alias("whole"))
    every = comps.unionByName(merged.select(F.col("comp").alias("key"), "comp")).unionByName(comps.select(F.col("comp").alias("key"), "comp")).distinct()
    return every.join(merged, "comp", "left").select("key", F.coalesce("whole", "comp").alias("comp"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    given = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    small_batches(docs.sparkSession)
    scratch = Scratch()
    seen = scratch.table(profile(given), "join-profile")
    members = seen.where("kind = 0").select("doc_id", "key", F.col("size").alias("n_shingles"))
    comps = linked_keys(given, seen, percent, frequent, scratch)
    per_key = members.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("low"))
    grouped = per_key.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    lows = grouped.groupBy("comp").agg(F.min("low").alias("component_id"))
    ids = grouped.join(lows, "comp").select("key", "component_id")
    out = members.join(ids, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return scratch.result(out, "join-result")
