"""Text expressions: trimming, known ids, money and percent wording."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from tillwise.fixed_values import UNKNOWN, WHITESPACE


def col(name: str) -> Column:
    """Column by its literal name, also when the name holds dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(value: Column) -> Column:
    """Remove whitespace of any kind from both ends (Spark's plain trim only removes spaces).

    The regular expression only runs for cells whose first or last character is no plain
    printable one; all other cells are passed on as they are.
    """
    clean = F.ascii(value).between(33, 126) & F.ascii(F.right(value, F.lit(1))).between(33, 126)
    trimmed = F.regexp_replace(value, rf"^{WHITESPACE}+|{WHITESPACE}+\z", "")
    return F.when(clean, value).otherwise(trimmed)


def blank_to_null(value: Column) -> Column:
    stripped = strip(value)
    return F.when(stripped != "", stripped)


def known(stripped: Column) -> Column:
    """A trimmed id, or null when it is missing or some spelling of 'unknown'."""
    unknown = (F.length(stripped) == len(UNKNOWN)) & (F.lower(stripped) == UNKNOWN.lower())
    return F.when(~unknown, stripped)


def amount(value: Column, digits: int = 2) -> Column:
    """``1234.5`` -> ``1,234.50``."""
    return F.format_number(value.cast("double"), digits)


def format_currency(value: Column) -> Column:
    """``$1,234.50``, or ``N/A`` for null and NaN."""
    return F.coalesce(F.concat(F.lit("$"), amount(_no_nan(value))), F.lit("N/A"))


def format_percent(value: Column) -> Column:
    """``12.34%``, or ``N/A`` for null and NaN."""
    return F.coalesce(F.concat(amount(_no_nan(value)), F.lit("%")), F.lit("N/A"))


def _no_nan(value: Column) -> Column:
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def fill(template: str, **values: Column) -> Column:
    """Insert columns into a ``{name}`` template. Null when any inserted value is null."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [
        values[part].cast("string") if place % 2 else F.lit(part)
        for place, part in enumerate(parts)
        if part or place % 2
    ]
    return F.concat(*pieces)
