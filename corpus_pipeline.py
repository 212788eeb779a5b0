"""A corpus pipeline of five stages: language, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.

Defined results: a null or empty text has no language, so it goes in the first stage, and so does a document without a
letter. Of groups of near duplicates the smallest id stays; a document without an id is the last of its group. Equal rows
(id and text) are one document; of rows with one id and several texts each text stands for itself in the stages that look
at texts, and all of an id stay in the second stage when one of them does. Very long texts are read whole. Further columns
pass through to the last stage, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm import decontam, langid, packing, secrets, tokenjoin
from timedtext.llm.common import materialize, release, table

#: No single SQL statement covers a trained model and tokenization; tests compare with a brute-force version.
ORACLE_SQL = None

#: A language is recognised from this score on.
LEAST_SCORE = 0.5


def _without(docs: DataFrame, found) -> DataFrame:
    """The rows of docs that ``found`` (rows with the id in column doc_id) does not name; ids and texts identify rows."""
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.xxhash64("text"))
    keyed = docs.withColumn("__row", row)
    # written first: its size is then known, and a small table is sent to the rows rather than the rows to it
    gone = materialize(found(keyed).select(F.col("doc_id").alias("__row")).distinct(), "gone")
    return keyed.join(gone, "__row", "left_anti").drop("__row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: some letters, and one language ahead by ``LEAST_SCORE``."""
    model = langid.fit(docs)
    found = langid.predict(docs, model, out="__lang", score="__score")
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE)).drop("__lang", "__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates; of equal rows one.

    Only ids travel: the few rows that go are taken out by an anti-join, and only rows that come twice are compared."""
    joined = tokenjoin.join(docs)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = materialize(joined.groupBy(F.col("doc_id").alias("__id")).agg(F.max(stays).alias("stays")).where("not stays").select("__id"), "gone")
    one = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]), "left_anti")
    text = F.xxhash64("text")
    times = docs.groupBy("doc_id", text.alias("__text")).agg(F.count("*").alias("__n")).where("__n > 1")
    twice = materialize(times.select(F.col("doc_id").alias("__id"), "__text"), "twice")
    keyed = one.withColumn("__hash", text)
    same = keyed["doc_id"].eqNullSafe(twice["__id"]) & (keyed["__hash"] == twice["__text"])
    single = keyed.join(twice, same, "left_anti").drop("__hash")
    return single.unionByName(keyed.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]).drop("__hash"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = table(spark, sf_dir, "benchmark")
    return _without(docs, lambda d: decontam.find(d, items, key="__row"))


def credentials(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no secret."""
    return _without(docs, lambda d: secrets.scan(d, key="__row").where("spans <> ''"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("credentials", credentials),
    ("sequences", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return docs
