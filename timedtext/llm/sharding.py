"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly. Tokens are estimated by the words of a
text (white space and one), which costs no tokenizer; they grow with the real number.

Rows of equal text form a group and stay together, except that a group over 1/64 of a shard in bytes, tokens or rows
is split by a hash of the row id, because one group may hold a third of all rows. Small groups share cells by a hash of
the text. Cells and parts of large groups number at most a fixed multiple of the shards, whatever the input, so they
are placed one after the other on the driver, largest first, each into the shard where its vector has the highest dot
product with the capacity that is left. The rows then look up their shard.

Defined results: a null text counts no bytes and groups with the empty text. Repeated rows each get a slot. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedtext.llm.common import SPACES, materialize, number_within

#: What a row takes beside its text.
ROW_BYTES = 16
#: A group is large above this part of a shard.
LARGE = 64
#: Cells of small groups for each shard.
CELLS = 256


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, size, token estimate, checksum and text hash of each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        (F.length(t) - F.length(F.translate(t, SPACES, "")) + 1).cast("long").alias("tokens"),
        F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        F.xxhash64(t).alias("group"),
    )


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """items: rows of (bytes, tokens, rows), each a share of the total. Gives the shard of each item."""
    load = np.zeros((shards, items.shape[1]))
    weights = np.array([4.0, 1.0, 1.0])[: items.shape[1]]
    at = np.zeros(len(items), int)
    for k in np.argsort(-items.max(axis=1), kind="stable"):
        left = 1 / shards - load
        dots = (left * items[k] * weights).sum(axis=1)
        at[k] = best = int(dots.argmax())
        load[best] += items[k]
    return at


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    rows = materialize(measured(docs, key, text), "shard-rows")
    total = rows.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    if not total["rows"]:
        return _result(rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}))
    part = {k: total[k] / shards / LARGE for k in ("size", "tokens", "rows")}
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    share = F.greatest(*(F.col(k) / F.lit(float(part[k])) for k in part))
    # at most 3 * shards * LARGE groups can be above the limit, so they may be collected and broadcast
    large = groups.where((share > 1) & (F.col("rows") > 1)).select("group", F.ceil(share).cast("int").alias("pieces"))
    large = spark.createDataFrame([(r[0], r[1]) for r in large.collect()], "group long, pieces int")
    # a large group's hash is unlike any cell number's: the cell is the hash of a small group modulo the cells
    keyed = rows.join(F.broadcast(large), "group", "left").withColumns(
        {
            "cell": F.when(F.col("pieces").isNull(), F.pmod("group", F.lit(shards * CELLS))).otherwise(F.col("group")),
            "piece": F.when(F.col("pieces").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", "size"), F.col("pieces")).cast("int")),
        }
    )
    items = keyed.groupBy("cell", "piece").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("cell", "piece").collect()
    vectors = np.array([[r["size"] / total["size"], r["tokens"] / total["tokens"], r["rows"] / total["rows"]] for r in items])
    placed = place(vectors, shards)
    # a row for each cell and piece: at most shards * CELLS, and twice the parts of large groups
    where = spark.createDataFrame([(r["cell"], r["piece"], int(s)) for r, s in zip(items, placed)], "cell long, piece int, shard int")
    put = materialize(keyed.join(F.broadcast(where), ["cell", "piece"]).select("doc_id", "size", "text_crc32", "shard"), "shard-put")
    return _result(number_within(put, ["shard"], ["doc_id", "size", "text_crc32"], "slot"))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
