"""Row numbers 1..n in a total order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tillwise.functions.text import col
from tillwise.sources.staging import stage

# monotonically_increasing_id holds the partition above these bits and the position below.
POSITION_BITS = 33


def number_rows(frame: DataFrame, order: list[str], name: str = "row_number", written: bool = False) -> DataFrame:
    """Add a 1-based bigint column that numbers the rows by ``order``, then by all other columns.

    The rows are range-sorted over many tasks and written with their place inside the partition.
    A partition's first number is the row count of the partitions before it, so only one small row per
    partition has to be added up. The place in the written input is the last sort key: equal rows, even a
    third of the table, are split over several partitions, and a task that is run again sees the same keys.
    ``written`` says that the frame only selects from a written table, so that its places hold without another copy.
    """
    keys = order + [column for column in frame.columns if column not in order]
    tie, place, part = "input place", "sorted place", "partition"
    source = frame if written else stage(frame, "unordered")
    source = source.withColumn(tie, F.monotonically_increasing_id())
    ordered = source.orderBy(*[col(key) for key in keys], col(tie)).drop(tie)
    placed = stage(ordered.withColumn(place, F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn(part, F.shiftright(col(place), POSITION_BITS))

    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part)
        .agg(F.count("*").alias("rows"))
        .select(part, F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    )
    within = col(place).bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    # Broadcast of one row of two numbers per partition of the sort, whatever the data.
    return placed.join(F.broadcast(offsets), part).select(
        (F.col("offset") + within + 1).alias(name), *[col(column) for column in frame.columns]
    )
