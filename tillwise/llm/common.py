"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"  # words of the contracts: runs of anything but ASCII white space
SPACES = " \t\n\x0b\x0c\r"
NULL_ID = -(2**63)  # stands for a null id inside an operator, so that null sorts before every id


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: str = "text"):
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def byte_rows(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the named string or binary column holds about ``limit`` bytes in each part.

    Rows stay whole, so one very long text makes a part of its own.
    """
    sizes = pc.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0).to_pylist()
    begin = total = 0
    for row, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(begin, row - begin)
            begin, total = row, 0
        total += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """Number of partitions that keeps each near ``per_part`` rows."""
    return max(least, -(-rows // per_part))
