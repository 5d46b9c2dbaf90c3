"""Calendar periods. Rows are grouped by the month's first day, labels are made afterwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, StringType


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def month_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def quarter_label(date: Column) -> Column:
    return F.concat(F.date_format(date, "yyyy"), F.lit("Q"), F.quarter(date))


def year_label(date: Column) -> Column:
    return F.date_format(date, "yyyy")


def parse_date(value: Column, kind: DataType, formats: tuple[str, ...]) -> Column:
    """A date from a raw cell: the first format that fits, null when none does.

    Dates and timestamps are cut to the day. Numbers are read as text. A format is only tried on cells that hold all the
    marks it cannot do without, because a failed try costs far more than a look for them.
    """
    if kind.typeName() in ("date", "timestamp", "timestamp_ntz"):
        return value.cast("date")
    text = value if isinstance(kind, StringType) else value.cast("string")

    def tried(form: str) -> Column:
        date = F.try_to_timestamp(text, F.lit(form)).cast("date")
        marks = [F.contains(text, F.lit(mark)) for mark in needed_marks(form)]
        return F.when(reduce(Column.__and__, marks), date) if marks else date

    return F.coalesce(*[tried(form) for form in formats])


def needed_marks(form: str) -> list[str]:
    """The marks between the fields of a format that every text of it holds: those outside of ``[]`` and of quotes."""
    marks, optional, quoted = [], 0, False
    for letter in form:
        if letter == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif letter in "[]":
            optional += 1 if letter == "[" else -1
        elif not optional and letter in "-/:.,":
            marks.append(letter)
    return sorted(set(marks))
