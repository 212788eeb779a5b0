"""Comments derived from the ``events`` table: the same rows by Spark and by DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXT = """concat(event_type, case when k % 3 = 0 then '!!!' when k % 3 = 1 then '~' else '' end, case when k % 7 = 0 then ' x' else '' end) as text"""
_TYPE = "cast(case event_id % 8 when 5 then 4 when 6 then 5 when 7 then 7 else 1 end as int) as type, cast((event_id * 7919) % 16777216 as int) as color"

DUCK = f"""select event_id as cid, concat('s', cast(user_id % 4 as varchar)) as source,
 floor((epoch_us(ts) - 1704067200000000) // 100000) / 1000.0::double as time, {_TYPE}, {_TEXT}
 from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)"""


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cid, source, time (seconds, thirty days in a hundredth), type, color, text."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    micros = F.expr("unix_micros(cast(ts as timestamp))")
    return events.select(
        F.col("event_id").alias("cid"),
        F.concat(F.lit("s"), F.expr("cast(user_id % 4 as string)")).alias("source"),
        (F.floor((micros - 1704067200000000) / 100000) / 1000.0).alias("time"),
        *(F.expr(x) for x in (_TYPE.split(", cast((")[0], "cast((" + _TYPE.split(", cast((")[1])),
        F.expr(_TEXT),
    )


def flow(spark: SparkSession, sf_dir: str, segments: list[tuple[float, float]], rules: list[str], threshold: float = 5) -> DataFrame:
    """Derive, shift, filter by rule, merge equal texts: the shortest whole path from comments to merged rows."""
    from timedtext.operators import merging, timeline

    segs = F.array(*(F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("delay")) for a, b in segments))
    rows = comments(spark, sf_dir).where("type between 1 and 5")
    moved = rows.withColumn("time", F.col("time") + timeline.delay_at(segs, F.col("time")))
    return merging.tolerance_merge(timeline.drop_ruled(moved, rules), threshold)
