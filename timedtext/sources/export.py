"""Writing comments as XML: raw, filtered and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedtext.functions.text import escape_xml, plain_number
from timedtext.sources.payloads import STAGE_PREFIX

HEADER = '<?xml version="1.0" encoding="UTF-8"?><i>'
MODES = ("raw", "filtered", "merged")


def mode_of(value: str | None) -> str:
    """filtered and merged in any case; anything else is raw."""
    v = (value or "raw").lower()
    return v if v in MODES else "raw"


def xml_line(time: Column, kind: Column, size: Column, colour: Column, text: Column) -> Column:
    n = lambda c, d: F.coalesce(c, F.lit(d)).cast("string")
    p = F.concat_ws(",", plain_number(time), n(kind, 1), n(size, 25), n(colour, 16777215))
    return F.concat(F.lit('<d p="'), p, F.lit('">'), escape_xml(F.coalesce(text, F.lit(""))), F.lit("</d>"))


def xml_lines(comments: DataFrame, by_time: bool = True) -> DataFrame:
    """cid and line of each comment; with ``by_time`` sorted by (time, cid)."""
    line = xml_line(F.col("time"), F.col("type"), F.col("size") if "size" in comments.columns else F.lit(25), F.col("color"), F.col("text"))
    return (comments.orderBy("time", "cid") if by_time else comments).select("cid", line.alias("line"))


def history_document(rows: DataFrame, key: str) -> DataFrame:
    """One JSON document from the rows of a history, an object by ``key``; histories are small, and the writer keeps one file."""
    value = F.struct(*(c for c in rows.columns if c != key))
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))))
    return rows.agg(F.to_json(F.map_from_entries(entries)).alias("document"))


def write_history(rows: DataFrame, key: str, path: str) -> None:
    history_document(rows, key).coalesce(1).write.mode("overwrite").text(path)


def write_xml(comments: DataFrame, path: str, mode: str = "raw", overwrite: bool = False) -> None:
    """One text file: header, stage comment unless raw, the lines in order of time, closing tag. An existing path is left
    alone unless ``overwrite``. One file means one writer; use ``xml_lines`` for large exports."""
    mode = mode_of(mode)
    spark = comments.sparkSession
    head = [HEADER] + ([f"<!-- {STAGE_PREFIX}{mode} -->"] if mode != "raw" else [])
    edges = spark.createDataFrame([(0, i, h) for i, h in enumerate(head)] + [(2, 0, "</i>")], "part int, ord long, line string")
    line = xml_line(F.col("time"), F.col("type"), F.col("size") if "size" in comments.columns else F.lit(25), F.col("color"), F.col("text"))
    body = comments.select(F.lit(1).alias("part"), "time", "cid", line.alias("line"))
    rows = body.unionByName(edges.select("part", F.col("ord").cast("double").alias("time"), F.col("ord").alias("cid"), "line"))
    rows.coalesce(1).sortWithinPartitions("part", "time", "cid").select("line").write.mode("overwrite" if overwrite else "ignore").text(path)
