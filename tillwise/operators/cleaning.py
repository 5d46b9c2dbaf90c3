"""Cleaning of raw sales rows, with a summary, a column report and a log of what was changed.

Raw rows are written with a fingerprint. Only fingerprints are shuffled: rows are compared as a whole where a fingerprint
repeats. Distinct rows are staged with every cell parsed once and a copy counter. All counters, the medians and the
cleaned rows are then narrow passes over that table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.types import DataType, StringType

from tillwise.fixed_values import (
    ACTION_TEXTS,
    DATE_FORMATS,
    EMPTY_INPUT,
    NUMERIC_COLUMNS,
    PREVIEW_ROWS,
    SALES_COLUMNS,
    TEXT_COLUMNS,
    UNKNOWN,
    UNSIGNED_COLUMNS,
)
from tillwise.functions.numbers import add_numbers, marked
from tillwise.functions.periods import parse_date
from tillwise.functions.text import col, strip
from tillwise.operators.inference import ColumnType, by_inferred_value, infer_types, parse_voted, with_date_format
from tillwise.operators.medians import approximate_medians, bounds_columns, exact_medians
from tillwise.operators.profile import build_column_report, distinct_rows, nan_to_null, with_fingerprint
from tillwise.sources.staging import compiled_methods, stage

COPIES = "copies of row"
ROW_GROUP = 8 << 20  # bytes: raw rows may come from few tasks, but are parsed by many
REGULAR_NUMBER = r"^(?!-0(\.0*)?$)-?(0|[1-9]\d*)(\.\d+)?$"
FORMAT = "date format"
PARSED, TRIMMED, SPELLING, NO_CELL, HAS_DATE_TEXT = "parsed ", "trimmed ", "spelling of ", "no cell of ", "has date text"
SUMMARY_TYPE = (
    "rows_before long, rows_after long, columns long, duplicate_rows_removed long, invalid_dates_found long, "
    "missing_values_before long, missing_values_after long, quality_score_before double, "
    "quality_score_after double, missing_expected_columns array<string>"
)
ACTION_TYPE = "step long, column string, rows long, value double, message string"


@dataclass
class CleanResult:
    """Cleaned rows (unordered; see ``in_date_order``) and the reports about them.

    The counters are known from the start. Medians are computed when the rows or the log are first asked for.
    """

    rows: DataFrame  # distinct typed rows, with those that are dropped
    names: list[str]
    first: Row  # counters of the rows as they came
    counters: Row  # counters of the distinct rows
    distinct_raw: DataFrame  # raw rows as staged, with their copies
    approximate: bool = False
    sketched_medians: bool = False
    types: list[ColumnType] | None = None  # as inferred of the cells, if asked for

    @property
    def _derived(self) -> bool:
        return {"Revenue", "Cost", "Profit"} <= set(self.names)

    @property
    def _duplicates(self) -> int:
        return self.first["rows"] - self.counters["distinct"]

    @property
    def _nulls_before(self) -> dict[str, int]:
        return {name: self.first[f"nulls {place}"] for place, name in enumerate(self.names)}

    @cached_property
    def fills(self) -> dict[str, float]:
        """The value that fills the gaps of a column; 0 where the column has no value at all."""
        values = _median_values(self.names)
        gaps = {name: value for name, value in values.items() if self.counters[f"missing {name}"]}
        if self.sketched_medians:
            medians = approximate_medians(self.rows, gaps)
        else:
            bounds = {name: tuple(self.counters[f"bounds of {name}"]) for name in gaps}
            medians = exact_medians(self.rows, gaps, bounds)
        return {name: 0.0 if median is None else float(median) for name, median in medians.items()}

    @cached_property
    def cleaned(self) -> DataFrame:
        return _cleaned_rows(self.rows.where(_kept(self.names)), self.names, self.fills, self._derived)

    @cached_property
    def summary(self) -> DataFrame:
        nulls_before = sum(self._nulls_before.values())
        row = _summary(self.first, self.counters, nulls_before, self._duplicates, self.names)
        return self.rows.sparkSession.createDataFrame([row], SUMMARY_TYPE)

    @cached_property
    def actions(self) -> DataFrame:
        log = _actions(self.counters, self._duplicates, self.names, self.fills, self._derived)
        return self.rows.sparkSession.createDataFrame(log, ACTION_TYPE)

    @cached_property
    def column_report(self) -> DataFrame:
        return build_column_report(
            self.distinct_raw, self.cleaned, self.approximate, weight=COPIES, nulls_before=self._nulls_before, types=self.types
        )


def standardize_column_names(frame: DataFrame) -> DataFrame:
    """Map any spelling of an expected column (case, spaces, punctuation) to its standard name."""

    def key(name: str) -> str:
        return re.sub(r"[^a-z0-9]", "", name.strip().lower())

    expected = {key(name): name for name in SALES_COLUMNS}
    names = [expected.get(key(name), name.strip()) for name in frame.columns]
    twice = sorted({name for name in names if names.count(name) > 1})
    if twice:
        raise ValueError("Several input columns have the same standard name: " + ", ".join(twice))
    return frame.toDF(*names)


def in_date_order(frame: DataFrame) -> DataFrame:
    """Order by date; the other columns break ties, so the order is the same in every run."""
    return frame.orderBy(*[col(name) for name in order_keys(frame)])


def preview(frame: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in date order."""
    return in_date_order(frame).limit(rows)


def order_keys(frame: DataFrame) -> list[str]:
    first = [name for name in SALES_COLUMNS if name in frame.columns]
    return first + [name for name in frame.columns if name not in first]


def clean_sales_data(
    raw: DataFrame,
    date_formats: Sequence[str] = DATE_FORMATS,
    approximate: bool = False,
    sketched_medians: bool = False,
    by_type: bool = False,
    file_column: str | None = None,
) -> CleanResult:
    """Clean raw rows.

    ``approximate`` replaces the exact distinct counts of the column report by sketches, and ``sketched_medians`` the
    exact medians that fill gaps (see ``approximate_medians`` for their error).

    ``by_type`` infers the type of every column first, and compares and returns cells by their value: in a column of
    numbers ``7`` and ``7.0`` are equal, also where it holds ids. ``file_column`` names a column that tells the files of the rows
    apart; it is dropped, and each file has its own order of day and month (see ``date_format_votes``).
    """
    formats = tuple(date_formats)
    if file_column and file_column not in raw.columns:
        raise ValueError(f"There is no column {file_column}.")
    renamed = nan_to_null(standardize_column_names(raw))
    names = [name for name in renamed.columns if name != file_column]
    types = infer_types(renamed.select(*map(col, names)), formats) if by_type else None
    if types:
        renamed = by_inferred_value(renamed, types, keep=["Date"])
    if file_column:
        renamed = with_date_format(renamed, file_column, FORMAT) if "Date" in names else renamed.drop(file_column)
    keys = renamed.columns
    written = stage(with_fingerprint(renamed), "rows", row_group=ROW_GROUP)
    staged = _stage_parsed(distinct_rows(written, keys, COPIES), formats, "distinct")
    renamed = renamed.select(*map(col, names))
    rows = _typed_rows(staged, names)
    with compiled_methods(raw.sparkSession):
        first = counters = rows.agg(*_raw_counters(renamed), *_clean_counters(rows, names)).first()
    if not first["rows"]:
        raise ValueError(EMPTY_INPUT)

    # A column of plain numbers is compared by value: 1 and 1.0 are the same cell. Typed numbers have one spelling only.
    typed = {known.column for known in types or () if known.type in ("int", "float")}
    plain = [name for name in _text_numbers(renamed) if name not in typed and _has_spellings(first, name)]
    if plain:
        by_value = staged.withColumns({name: col(PARSED + name) for name in plain})
        by_value = by_value.groupBy(*[col(name) for name in keys]).agg(F.sum(COPIES).alias(COPIES))
        rows = _typed_rows(_stage_parsed(by_value, formats, "distinct-by-value"), names)
        with compiled_methods(raw.sparkSession):
            counters = rows.agg(*_clean_counters(rows, names)).first()

    return CleanResult(
        rows=rows,
        names=names,
        first=first,
        counters=counters,
        distinct_raw=staged.select(*[col(name) for name in names], COPIES),
        approximate=approximate,
        sketched_medians=sketched_medians,
        types=types,
    )


def clean_data(raw: DataFrame, date_formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """The cleaned rows only."""
    return clean_sales_data(raw, date_formats).cleaned


# --- staged rows and counters -----------------------------------------------------


def _text_numbers(frame: DataFrame) -> list[str]:
    return [
        name for name in NUMERIC_COLUMNS
        if name in frame.columns and isinstance(frame.schema[name].dataType, StringType)
    ]


def _stage_parsed(distinct: DataFrame, formats: tuple[str, ...], name: str) -> DataFrame:
    """Write distinct rows together with their parsed dates and numbers.

    Every cell is parsed once here; the passes that follow read the typed values.
    """
    names = [name for name in distinct.columns if name != COPIES]
    numbers = {PARSED + column: column for column in NUMERIC_COLUMNS if column in names}
    parsed = add_numbers(distinct, numbers)
    parsed = parsed.withColumns({SPELLING + name: _spelling(col(name), col(PARSED + name)) for name in _text_numbers(distinct)})
    texts = [name for name in names if name not in ("Date", FORMAT) and PARSED + name not in numbers]
    texts = [name for name in texts if isinstance(distinct.schema[name].dataType, StringType)]
    # Only texts that trimming changes are written once more; most cells stay null here and take no room.
    parsed = parsed.withColumns({TRIMMED + name: strip(col(name)) for name in texts})
    parsed = parsed.withColumns({TRIMMED + name: F.when(col(TRIMMED + name) != col(name), col(TRIMMED + name)) for name in texts})
    if "Date" in names:
        kind = distinct.schema["Date"].dataType
        date, text = "date cell", col("Date")
        if isinstance(kind, StringType):
            parsed, text = parsed.withColumn(date, strip(text)), F.when(col(date) != "", col(date))
        parsed = (
            parsed.withColumn(date, text)
            .withColumns({PARSED + "Date": _date(col(date), kind, formats, FORMAT in names), HAS_DATE_TEXT: col(date).isNotNull()})
            .drop(date)
        )
    return stage(parsed, name)


def _date(cell: Column, kind: DataType, formats: tuple[str, ...], voted: bool) -> Column:
    return parse_voted(cell, kind, formats, FORMAT) if voted else parse_date(cell, kind, formats)


def _typed_rows(staged: DataFrame, names: list[str]) -> DataFrame:
    """Staged rows with typed columns; ``NO_CELL`` + name says that the cell was null as it came."""
    typed, helpers = [], [name for name in (COPIES, HAS_DATE_TEXT) if name in staged.columns]
    for name in (name for name in staged.columns if name in names):
        cell = col(name)
        if PARSED + name in staged.columns:
            cell = col(PARSED + name)
        elif TRIMMED + name in staged.columns:
            cell = F.coalesce(col(TRIMMED + name), cell)
            cell = F.when(cell != "", cell)
        typed += [cell.alias(name), col(name).isNull().alias(NO_CELL + name)]
        if SPELLING + name in staged.columns:
            helpers.append(SPELLING + name)
    return staged.select(*typed, *map(col, helpers))


def _spelling(cell: Column, number: Column) -> Column:
    """How a text cell spells its number, in one small whole number; null for a missing cell.

    Its digits after the point, or -1 for spellings such as 007, +7, 7., 7e0 or -0, plus one and times 4; plus 2 for a plain
    number, one without currency marks; plus 1 for a last digit of 0 after the point.
    """
    plain = number.isNotNull() & ~marked(cell)
    fraction = F.when(F.contains(cell, F.lit(".")), F.length(F.substring_index(cell, ".", -1))).otherwise(0)
    digits = F.when(cell.rlike(REGULAR_NUMBER), fraction).otherwise(-1)
    zeros = (digits > 0) & cell.endswith("0")
    return F.when(cell.isNotNull(), (digits + 1) * 4 + plain.cast("int") * 2 + zeros.cast("int"))


def _kept(names: list[str]) -> Column:
    return F.col("Date").isNotNull() if "Date" in names else F.lit(True)


def _median_values(names: list[str]) -> dict[str, Column]:
    """The numbers whose gaps are filled by their median, taken from the rows that are kept."""
    derived = {"Revenue", "Cost", "Profit"} <= set(names)
    kept = _kept(names)
    return {
        name: F.when(kept, F.abs(col(name)) if name in UNSIGNED_COLUMNS else col(name))
        for name in NUMERIC_COLUMNS
        if name in names and not (derived and name == "Profit")
    }


def _raw_counters(renamed: DataFrame) -> list[Column]:
    """Counters of the rows as they came, from distinct rows and their copies."""
    copies = F.col(COPIES)
    counters = [F.coalesce(F.sum(copies), F.lit(0)).alias("rows")]
    for place, name in enumerate(renamed.columns):
        nulls = F.sum(F.when(col(NO_CELL + name), copies))
        counters.append(F.coalesce(nulls, F.lit(0)).alias(f"nulls {place}"))
    for name in _text_numbers(renamed):
        spelling = col(SPELLING + name)
        digits = F.floor(spelling / 4) - 1
        counters.append(F.coalesce(F.every(spelling.bitwiseAND(2) > 0), F.every(spelling.isNull())).alias(f"plain {name}"))
        counters.append(F.min(digits).alias(f"fewest digits {name}"))
        counters.append(F.max(digits).alias(f"most digits {name}"))
        counters.append(F.some(spelling.bitwiseAND(1) > 0).alias(f"trailing zeros {name}"))
    return counters


def _has_spellings(first: Row, name: str) -> bool:
    """Whether a column of plain numbers can hold one value in several spellings.

    It cannot when all cells have the same number of decimals, or none ends in a needless zero.
    """
    fewest, most = first[f"fewest digits {name}"], first[f"most digits {name}"]
    if not first[f"plain {name}"] or fewest is None:
        return False
    return fewest < 0 or (fewest < most and first[f"trailing zeros {name}"])


def _clean_counters(rows: DataFrame, names: list[str]) -> list[Column]:
    """Counters of the distinct rows; together with the raw counters one pass."""
    kept = _kept(names)
    counters = [F.count("*").alias("distinct"), F.count_if(kept).alias("kept")]
    if HAS_DATE_TEXT in rows.columns:
        counters.append(F.count_if(F.col(HAS_DATE_TEXT) & ~kept).alias("bad dates"))
    for name in names:
        if name in UNSIGNED_COLUMNS:
            counters.append(F.count_if(kept & (col(name) < 0)).alias(f"negative {name}"))
        if name != "Date":
            counters.append(F.count_if(kept & col(name).isNull()).alias(f"missing {name}"))
    return counters + bounds_columns(_median_values(names))


# --- results ----------------------------------------------------------------------


def _cleaned_rows(rows: DataFrame, names: list[str], fills: dict[str, float], derived: bool) -> DataFrame:
    def filled(name: str) -> Column:
        value = col(name)
        if name in UNSIGNED_COLUMNS:
            value = F.abs(value)
        if name in fills:
            value = F.coalesce(value, F.lit(fills[name]))
        return value

    columns = []
    for name in names:
        if name == "Profit" and derived:
            cell = F.coalesce(col(name), filled("Revenue") - filled("Cost"))
        elif name in NUMERIC_COLUMNS:
            cell = filled(name)
        elif name in TEXT_COLUMNS:
            cell = F.coalesce(col(name).cast("string"), F.lit(UNKNOWN))
        else:
            cell = col(name)
        columns.append(cell.alias(name))
    return rows.select(*columns)


def _summary(first: Row, counters: Row, nulls_before: int, duplicates: int, names: list[str]) -> tuple:
    # Every expected column is complete after cleaning; only extra columns can have gaps.
    nulls_after = sum(counters[f"missing {name}"] for name in names if name not in SALES_COLUMNS)

    def score(rows: int, nulls: int) -> float:
        cells = rows * len(names)
        return round((cells - nulls) / cells * 100, 1) if cells else 0.0

    return (
        first["rows"],
        counters["kept"],
        len(names),
        duplicates,
        counters["bad dates"] if "Date" in names else 0,
        nulls_before,
        nulls_after,
        score(first["rows"], nulls_before),
        score(counters["kept"], nulls_after),
        _absent(names),
    )


def _absent(names: list[str]) -> list[str]:
    return [name for name in SALES_COLUMNS if name not in names]


def _actions(counters: Row, duplicates: int, names: list[str], fills: dict[str, float], derived: bool) -> list[tuple]:
    """Log entries (step, column, rows, value, message) for every rule that changed something."""
    log: list[tuple] = []

    def add(kind: str, column: str | None = None, rows: int | None = None, value: float | None = None, **words) -> None:
        text = ACTION_TEXTS[kind].format(
            rows=rows, column=column, value=None if value is None else f"{value:,.2f}", **words
        )
        log.append((len(log) + 1, column, rows, value, text))

    if duplicates:
        add("duplicates", rows=duplicates)
    if "Date" not in names:
        add("no_date", "Date")
    elif counters["distinct"] > counters["kept"]:
        add("dates", "Date", counters["distinct"] - counters["kept"])
    for name in (name for name in NUMERIC_COLUMNS if name in names):
        missing = counters[f"missing {name}"]
        if name in UNSIGNED_COLUMNS and counters[f"negative {name}"]:
            add("negatives", name, counters[f"negative {name}"])
        if missing and name == "Profit" and derived:
            add("profit", name, missing)
        elif missing:
            add("median", name, missing, fills[name])
    for name in (name for name in TEXT_COLUMNS if name in names):
        if counters[f"missing {name}"]:
            add("text", name, counters[f"missing {name}"])
    if _absent(names):
        add("columns", columns=", ".join(_absent(names)))
    return log
