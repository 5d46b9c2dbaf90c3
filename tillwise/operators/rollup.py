"""Sums of the sales lines that all analyses share, from one pass over the lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tillwise.fixed_values import DRIVER_DIMENSIONS
from tillwise.functions.periods import month_start
from tillwise.functions.text import col
from tillwise.sources.staging import stage

MEASURES = ["Revenue", "Profit"]


@dataclass
class RollUp:
    """Staged rows ``(dimension, member, Date, Revenue, Profit)``.

    ``dimension`` is null for sums per day; else ``Date`` is the first day of the member's month. Only measures
    of the lines are there. Sums are null where no line has a value, as for lines of their own.
    """

    rows: DataFrame
    columns: list[str]

    def days(self) -> DataFrame:
        """Sums per day, to be used as lines."""
        kept = [name for name in ("Date", *MEASURES) if name in self.columns]
        return self.rows.where("dimension is null").select(*kept)

    def months(self, name: str) -> DataFrame:
        """Sums per month and value of a dimension, to be used as lines; sums per day if the lines lack it."""
        if name not in self.columns:
            return self.days()
        kept = [other for other in ("Date", *MEASURES) if other in self.columns]
        return self.rows.where(F.col("dimension") == name).select(F.col("member").alias(name), *kept)

    def members(self) -> DataFrame:
        """Sums per month and member of all dimensions."""
        return self.rows.where("dimension is not null")


def roll_up(sales: DataFrame) -> RollUp:
    """Sums per day, and per month and category, product and customer, in one scan and one shuffle.

    Tasks combine their lines before the shuffle, so a member with a third of all lines is one row per task
    and month. No lines give no rows; lines without a date have a null one; a null member is a member.
    """
    dimensions = [name for name in DRIVER_DIMENSIONS if name in sales.columns]
    measures = [name for name in MEASURES if name in sales.columns]
    date = F.col("Date") if "Date" in sales.columns else F.lit(None).cast("date")
    keyed = sales.select(date.alias("day"), month_start(date).alias("month"), *dimensions, *measures)
    grouped = keyed.groupingSets([["day"], *[["month", name] for name in dimensions]], "day", "month", *dimensions).agg(
        F.grouping("day").alias("without day"),
        *[F.grouping(name).alias(f"without {name}") for name in dimensions],
        *[F.sum(name).alias(f"sum {name}") for name in measures],
    )
    dimension, member = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in dimensions:
        here = col(f"without {name}") == 0
        dimension = F.when(here, F.lit(name)).otherwise(dimension)
        member = F.when(here, F.col(name).cast("string")).otherwise(member)
    rows = grouped.select(
        dimension.alias("dimension"),
        member.alias("member"),
        F.when(col("without day") == 0, F.col("day")).otherwise(F.col("month")).cast("date").alias("Date"),
        *[col(f"sum {name}").alias(name) for name in measures],
    )
    return RollUp(stage(rows, "roll-up"), sales.columns)
