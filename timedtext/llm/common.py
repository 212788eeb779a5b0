"""What the operators of this subpackage share: scratch tables, numbering, fixed hashes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import pickle
import sys
import tempfile
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters that separate words wherever a contract says ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Where that is unset, one of our own if everything
    runs in this one process; on a cluster no folder of this machine would do, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set, and on {master} intermediate tables need a folder that the driver and all executors share")
        root = _own_root()
    return root


@functools.cache
def _own_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="timedtext-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/timedtext/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    give_back()
    return back


def release(df: DataFrame) -> None:
    """Delete the files of a frame made by ``materialize`` that nothing will read again."""
    if path := getattr(df, "_scratch_path", None):
        drop_path(df.sparkSession, path)


class Scratch:
    """The intermediate tables of one operator, deleted as soon as its result is written."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def table(self, df: DataFrame, label: str) -> DataFrame:
        self.made.append(materialize(df, label))
        return self.made[-1]

    def result(self, df: DataFrame, label: str) -> DataFrame:
        """The result as a table of its own; nothing reads the others after that."""
        out = materialize(df, label)
        for t in self.made:
            release(t)
        self.made.clear()
        return out


def sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows at most, drawn by a hash of the key; all of them where there are no more."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 48)) < int((1 << 48) * most / n))


def number_within(df: DataFrame, keys: list[str], order: list[str], out: str, rows_per_bucket: int = 20_000) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... without gathering a key in one task.

    Rows are spread over hash buckets of ``order``; each bucket is numbered by itself and shifted by the
    sizes of the buckets before it. ``df`` is read twice, so it should be a written table.
    """
    n = df.count()
    buckets = max(1, -(-n // rows_per_bucket))
    b = "__bucket"
    spread = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = spread.groupBy(*keys, b).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)) - 1
    numbered = spread.withColumn("__at", within)
    return numbered.join(starts, [*keys, b]).withColumn(out, (F.col("__start") + F.col("__at")).cast("long")).drop(b, "__at", "__start")


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(doc_id).cast("string"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijective mixer of uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fixed_uint64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd uint64 values."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


#: Rows that go to a Python worker at once.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long rows: let no more than ``BATCH_ROWS`` of them go to a Python worker at once. This is a setting of
    the session, which keeps a lower one."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def send(spark: SparkSession, value):
    """Broadcast a bounded value whose class the workers may not know."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent):
    return pickle.loads(sent.value)


def give_back() -> None:
    """Return freed memory of this process to the machine; reused workers and the driver otherwise keep their peak."""
    gc.collect()
    if pa := sys.modules.get("pyarrow"):
        pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """A function over batches that gives memory back at the end of each task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
