"""What the cells of text columns mean: a type per column, and a date order per file.

Both are one aggregate whose state merges: a task reduces its rows to one small record per column or file.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, IntegralType, NumericType, StringType

from tillwise.fixed_values import BOOLEAN_TEXTS, DATE_FORMATS, DATE_RIVALS, NUMBER_PATTERN, WHOLE_PATTERN
from tillwise.functions.periods import parse_date
from tillwise.functions.text import col, strip
from tillwise.sources.staging import compiled_methods, stage

# Kinds of cells, as bits of a set: the type of a column follows from the set of its kinds, in whatever order they were met.
BOOL, INT, FLOAT, DATE, TEXT = 1, 2, 4, 8, 16
KIND_NAMES = {BOOL: "bool", INT: "int", FLOAT: "float", DATE: "date", TEXT: "text"}
LONGEST_DATE = 40  # characters; longer cells are not tried as dates


def type_of(kinds: int) -> str:
    """The narrowest type that holds all kinds: whole numbers widen to fractions, any other mix is text."""
    if kinds & ~(INT | FLOAT) == 0 and kinds:
        return "float" if kinds & FLOAT else "int"
    return "void" if kinds == 0 else KIND_NAMES.get(kinds, "text")


@dataclass
class ColumnType:
    column: str
    type: str
    kinds: list[str]
    cells: int
    missing: int
    widest: int  # characters of the longest cell


def _kind(cell: Column, kind: DataType, formats: tuple[str, ...]) -> Column:
    """The bit of a cell, a text without blanks around it; null for a missing one."""
    if not isinstance(kind, StringType):
        known = [(BooleanType, BOOL), (IntegralType, INT), (NumericType, FLOAT), (DateType, DATE)]
        bit = next((bit for family, bit in known if isinstance(kind, family)), TEXT)
        return F.when(cell.isNotNull(), F.lit(bit))
    # What has no digit and is no truth value needs no pattern.
    number = F.when(cell.rlike(WHOLE_PATTERN), F.when(cell.try_cast("long").isNotNull(), INT).otherwise(FLOAT)).when(
        cell.rlike(NUMBER_PATTERN), FLOAT
    )
    date = F.when(F.length(cell) <= LONGEST_DATE, F.when(parse_date(cell, kind, formats).isNotNull(), DATE))
    other = F.when(cell.isin(BOOLEAN_TEXTS), BOOL).otherwise(TEXT)
    return F.when(cell.isNotNull(), F.when(cell.rlike(r"\d"), F.coalesce(number, date, F.lit(TEXT))).otherwise(other))


def infer_types(frame: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> list[ColumnType]:
    """The type of every column, from all cells, in one aggregate (one row to the driver)."""
    # In projections of their own, so that a text that is used several times is made once per row.
    cells = [
        (strip(col(field.name)) if isinstance(field.dataType, StringType) else col(field.name)).alias(f"cell{place}")
        for place, field in enumerate(frame.schema)
    ]
    width = [F.length(col(name).cast("string")).alias(f"width{place}") for place, name in enumerate(frame.columns)]
    rows = frame.select(*cells, *width)
    kinds = [_kind(F.col(f"cell{place}"), field.dataType, tuple(formats)).alias(f"kind{place}") for place, field in enumerate(frame.schema)]
    rows = rows.select(*kinds, *[f"width{place}" for place in range(len(kinds))])
    facts = []
    for place in range(len(kinds)):
        facts += [
            F.coalesce(F.bit_or(f"kind{place}"), F.lit(0)).alias(f"kinds {place}"),
            F.count(f"kind{place}").alias(f"cells {place}"),
            F.count_if(F.col(f"kind{place}").isNull()).alias(f"missing {place}"),
            F.coalesce(F.max(f"width{place}"), F.lit(0)).alias(f"widest {place}"),
        ]
    with compiled_methods(frame.sparkSession):
        row = rows.agg(*facts).first()
    found = []
    for place, name in enumerate(frame.columns):
        kinds, *counts = (row[f"{fact} {place}"] for fact in ("kinds", "cells", "missing", "widest"))
        found.append(ColumnType(name, type_of(kinds), [text for bit, text in KIND_NAMES.items() if kinds & bit], *counts))
    return found


def inferred_types(frame: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """(column, type, kinds, cells, missing, widest): one row per column."""
    rows = [(t.column, t.type, ",".join(t.kinds), t.cells, t.missing, t.widest) for t in infer_types(frame, formats)]
    kinds = "column string, type string, kinds string, cells long, missing long, widest int"
    return frame.sparkSession.createDataFrame(rows, kinds)


def by_inferred_value(frame: DataFrame, types: Sequence[ColumnType], keep: Sequence[str] = ()) -> DataFrame:
    """Text cells spelled by their value where the whole column is of one type: ``7``, ``+7`` and ``007`` are one whole number,
    ``7`` and ``7.0`` one fraction, ``TRUE`` and ``True`` one truth value. Dates and texts stay as they are, and so do columns in ``keep``.
    """
    casts = {"bool": "boolean", "int": "long", "float": "double"}
    spelled = {}
    for known in types:
        if known.type in casts and known.column not in keep and isinstance(frame.schema[known.column].dataType, StringType):
            value = strip(col(known.column)).try_cast(casts[known.type])
            # -0.0 and 0.0 are one value; adding 0.0 leaves only the latter.
            spelled[known.column] = (value + 0.0 if known.type == "float" else value).cast("string")
    return frame.select(*[spelled.get(name, col(name)).alias(name) for name in frame.columns])


# --- date order per file ----------------------------------------------------------


def date_format_votes(
    frame: DataFrame, file_column: str, date_column: str = "Date", rivals: Sequence[str] = DATE_RIVALS, row_order: Column | None = None
) -> DataFrame:
    """(file, format, parsed, first_row, chosen): how many cells of a file each rival format parses, and the one that wins.

    The format that parses most cells wins; then the one that parses the earlier row (by ``row_order``, else by the order of reading); then
    the first in the list. A file without such cells takes the first. Every rival's record is a count and a minimum, so
    records of parts of a file merge, and a file of any size is combined before the shuffle.
    """
    order = (F.monotonically_increasing_id() if row_order is None else row_order).cast("long")
    kind = frame.schema[date_column].dataType
    rows = frame.select(col(file_column).alias("file"), col(date_column).alias("cell"), order.alias("row"))
    cell = strip(F.col("cell")) if isinstance(kind, StringType) else F.col("cell")
    records = []
    for place, form in enumerate(rivals):
        fits = parse_date(cell, kind, (form,)).isNotNull()
        records += [F.count_if(fits).alias(f"parsed{place}"), F.min(F.when(fits, F.col("row"))).alias(f"first{place}")]
    files = rows.groupBy("file").agg(*records)
    last = F.lit(2**63 - 1)
    record = lambda place: F.struct(
        (-F.col(f"parsed{place}")).alias("votes"), F.coalesce(f"first{place}", last).alias("first"), F.lit(place).alias("place")
    )
    files = files.withColumn("best", F.array_min(F.array(*[record(place) for place in range(len(rivals))]))["place"])
    entries = [
        F.struct(
            F.lit(form).alias("format"), F.col(f"parsed{place}").alias("parsed"), F.col(f"first{place}").alias("first_row"),
            (F.col("best") == place).alias("chosen"),
        )
        for place, form in enumerate(rivals)
    ]
    return files.select("file", F.inline(F.array(*entries)))


def with_date_format(
    frame: DataFrame, file_column: str, name: str, date_column: str = "Date", rivals: Sequence[str] = DATE_RIVALS
) -> DataFrame:
    """The rows with the winning format of their file in a column ``name``, which takes the place of the file column.

    The winners are written, one short row per file, so that the join is planned by their true size.
    """
    votes = date_format_votes(frame, file_column, date_column, rivals).where("chosen").select("file", "format")
    winners = stage(votes, "date-formats").toDF("file of format", name)
    same = col(file_column).eqNullSafe(F.col("file of format"))
    return frame.join(winners, same, "left").drop("file of format", file_column)


def parse_voted(value: Column, kind: DataType, formats: Sequence[str], voted: str, rivals: Sequence[str] = DATE_RIVALS) -> Column:
    """A date by the formats that have no rival, else by the format in the column ``voted``."""
    plain = tuple(form for form in formats if form not in rivals)
    by_vote = [F.when(F.col(f"`{voted}`") == form, parse_date(value, kind, (form,))) for form in rivals]
    return F.coalesce(*([parse_date(value, kind, plain)] if plain else []), *by_vote)
