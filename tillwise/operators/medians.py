"""Exact medians of several columns without sorting or moving the rows.

Each round counts the values of the bracket that holds the median in a few thousand equal
slices and keeps the slice with the middle rank. Tasks send one row per slice to the shuffle, however
many rows they read, so neither the row count nor a value shared by a third of all rows matters. A
round narrows the bracket by the slice count; two or three rounds settle money amounts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SLICES = 4096


def approximate_medians(
    frame: DataFrame, columns: dict[str, Column], accuracy: int = 10_000
) -> dict[str, float | None]:
    """A value of each named expression whose rank is off the middle by at most rows / ``accuracy``, from one pass."""
    if not columns:
        return {}
    found = frame.agg(*[F.percentile_approx(value, 0.5, accuracy) for value in columns.values()]).first()
    return dict(zip(columns, found))


@dataclass
class Bracket:
    """The values between low and high; ``below`` rows are smaller than all of them."""

    rows: int
    low: float
    high: float
    below: int = 0
    median: float | None = None


def exact_medians(
    frame: DataFrame, columns: dict[str, Column], bounds: dict[str, tuple[int, float, float]] | None = None
) -> dict[str, float | None]:
    """Interpolated median of each named double expression; None where there is no value.

    ``bounds`` gives (count, min, max) per name when the caller has them from another pass.
    """
    if bounds is None:
        bounds = value_bounds(frame, columns)
    found: dict[str, float | None] = {name: None for name in columns}
    open_brackets = {
        name: Bracket(rows, low, high) for name, (rows, low, high) in bounds.items() if name in columns and rows
    }
    while open_brackets:
        for name, bracket in list(open_brackets.items()):
            if bracket.low == bracket.high:
                bracket.median = bracket.low
            if bracket.median is not None:
                found[name] = bracket.median
                del open_brackets[name]
        if open_brackets:
            _narrow(frame, columns, open_brackets)
    return found


def bounds_columns(columns: dict[str, Column]) -> list[Column]:
    """Aggregates (count, min, max) to add to any pass over the same rows."""
    return [F.struct(F.count(value), F.min(value), F.max(value)).alias(f"bounds of {name}")
            for name, value in columns.items()]


def value_bounds(frame: DataFrame, columns: dict[str, Column]) -> dict[str, tuple[int, float, float]]:
    row = frame.agg(*bounds_columns(columns)).first()
    return {name: tuple(row[f"bounds of {name}"]) for name in columns}


def _narrow(frame: DataFrame, columns: dict[str, Column], brackets: dict[str, Bracket]) -> None:
    """One pass over the rows: replace each bracket by the slice that holds its middle rank."""
    cells = []
    for name, bracket in brackets.items():
        value = columns[name]
        # Halved before subtracting, so that the width cannot overflow.
        low, width = bracket.low / 2, bracket.high / 2 - bracket.low / 2
        place = F.floor((value / 2 - F.lit(low)) / F.lit(width) * F.lit(SLICES))
        inside = value.between(bracket.low, bracket.high)
        cells.append(
            F.struct(F.lit(name).alias("name"), F.when(inside, place).alias("slice"), value.alias("value"))
        )
    slices = (
        frame.select(F.inline(F.array(*cells)))
        .where(F.col("slice").isNotNull())
        .groupBy("name", "slice")
        .agg(F.count("*").alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"))
        .collect()  # at most (SLICES + 1) rows per column, whatever the data
    )
    slices.sort(key=lambda part: (part["name"], part["slice"]))
    for name, bracket in brackets.items():
        lower, upper = (bracket.rows - 1) // 2, bracket.rows // 2
        below = bracket.below
        lower_end = None
        for part in (part for part in slices if part["name"] == name):
            if lower_end is not None:  # the two middle ranks lie in different slices
                bracket.median = (lower_end + part["low"]) / 2
                break
            if lower < below + part["rows"]:
                if upper < below + part["rows"]:
                    bracket.low, bracket.high, bracket.below = part["low"], part["high"], below
                    break
                lower_end = part["high"]
            below += part["rows"]
