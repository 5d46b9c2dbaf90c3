"""Number expressions: lenient parsing, safe ratios, growth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from tillwise.fixed_values import CURRENCY_MARKS, NUMBER_PATTERN
from tillwise.functions.text import col, strip


def add_numbers(frame: DataFrame, cells: dict[str, str]) -> DataFrame:
    """Add double columns (name -> raw column); null when the cell is no finite decimal number.

    ``$ 1,234.5`` is accepted. The pattern guard is needed because a Spark cast also takes
    Java spellings such as ``1.5d``. The work is split into projections, so that a text that
    is used several times is made once per row.
    """
    kinds = {name: frame.schema[raw].dataType for name, raw in cells.items()}
    texts = [name for name, kind in kinds.items() if isinstance(kind, StringType)]
    step = {name: f"text for {name}" for name in texts}
    names = frame.columns
    frame = frame.withColumns({step[name]: strip(col(cells[name])) for name in texts})
    # Few cells hold a mark: only their texts are made anew.
    unmarked = {name: strip(F.translate(col(step[name]), CURRENCY_MARKS, "")) for name in texts}
    frame = frame.withColumns({step[name]: F.when(marked(col(step[name])), text).otherwise(col(step[name])) for name, text in unmarked.items()})
    numbers = {}
    for name, raw in cells.items():
        if name in texts:
            text = col(step[name])
            numbers[name] = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
        elif isinstance(kinds[name], NumericType):
            numbers[name] = col(raw).cast("double")
        else:
            numbers[name] = F.lit(None).cast("double")
    frame = frame.withColumns(numbers)
    finite = {name: F.when(F.abs(col(name)) < float("inf"), col(name)) for name in cells}
    return frame.withColumns(finite).select(*[col(name) for name in [*names, *cells]])


def marked(text: Column) -> Column:
    """Whether a text holds a currency mark."""
    return reduce(Column.__or__, [F.contains(text, F.lit(mark)) for mark in CURRENCY_MARKS])


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient in double, null when the divisor is zero or null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent(top: Column, bottom: Column) -> Column:
    return ratio(top, bottom) * 100


def growth_percent(now: Column, before: Column) -> Column:
    """Relative change in percent; null without a base."""
    return ratio(now.cast("double") - before.cast("double"), before) * 100


def total(value: Column) -> Column:
    """Sum that is 0, not null, when there is nothing to add."""
    return F.coalesce(F.sum(value), F.lit(0))
