"""Compressed payload files: zip, gzip and zlib, told apart by their first bytes."""

from __future__ import annotations

import gzip
import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def inflated(content: bytes) -> list[tuple[str, bytes]]:
    """(name, bytes) of each member; content that is not compressed comes back as it is. Checksums are verified."""
    if content[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [(n, z.read(n)) for n in z.namelist() if not n.endswith("/")]
    if content[:2] == b"\x1f\x8b":
        return [("", gzip.decompress(content))]
    if content[:1] == b"\x78":
        try:
            return [("", zlib.decompress(content))]
        except zlib.error:
            pass
    return [("", content)]


def members(files: DataFrame) -> DataFrame:
    """path, member, payload of each file of (path, content); a damaged file gives no rows but is not silent: its error
    stands in ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, name, body.decode("utf-8", "replace"), None) for name, body in inflated(bytes(content))]
                except (zipfile.BadZipFile, OSError, zlib.error, EOFError) as e:
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "member", "payload", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, payload string, error string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return members(spark.read.format("binaryFile").load(path))
