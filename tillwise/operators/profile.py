"""Quality profile of a raw or cleaned frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    MapType,
    NumericType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from tillwise.fixed_values import DATE_FORMATS
from tillwise.functions.periods import parse_date
from tillwise.functions.text import col
from tillwise.operators.inference import ColumnType
from tillwise.sources.staging import stage


def nan_to_null(frame: DataFrame) -> DataFrame:
    """NaN and null are one concept in all analyses: make them one at the read boundary."""
    fractions = {
        field.name for field in frame.schema if isinstance(field.dataType, (FloatType, DoubleType))
    }
    if not fractions:
        return frame
    return frame.select(
        *[
            F.when(~F.isnan(col(name)), col(name)).alias(name) if name in fractions else col(name)
            for name in frame.columns
        ]
    )


def group_copies(frame: DataFrame, counter: str = "copies") -> DataFrame:
    """Distinct rows with their number of copies (nulls are equal).

    Tasks combine their own copies first, so a row that fills a third of the table is cheap.
    """
    return frame.groupBy(*[col(name) for name in frame.columns]).agg(F.count("*").alias(counter))


DECIMAL_LONG = 18  # digits of a decimal that is kept in 64 bits

PRINTS = ["row print 1", "row print 2"]
REPEATS = 1_000_000  # repeated fingerprints that are broadcast: two longs each


def with_fingerprint(frame: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Add 128 bits that equal rows have in common, in two columns ``PRINTS``."""
    names = frame.columns if keys is None else keys
    # Hashes skip nulls: their places are hashed as truth values of their own.
    nulls = [col(name).isNull() for name in names]
    return frame.withColumns({name: F.xxhash64(F.lit(seed), *nulls, *map(col, names)) for seed, name in enumerate(PRINTS)})


def distinct_rows(written: DataFrame, keys: list[str], counter: str = "copies", repeats: int = REPEATS) -> DataFrame:
    """Distinct rows by ``keys`` of a written table with fingerprints, with their number of copies (nulls are equal).

    Only fingerprints are shuffled, combined in every task first. A row whose fingerprint is alone has no copy and stays where it is;
    rows whose fingerprints repeat are compared as a whole, so two rows that only share a fingerprint stay two. The
    other columns must follow from the keys. Beyond ``repeats`` repeated fingerprints, too many to broadcast, all rows are grouped.
    """
    others = [name for name in written.columns if name not in [*keys, *PRINTS]]

    def grouped(rows: DataFrame) -> DataFrame:
        kept = [F.any_value(col(name)).alias(name) for name in others]
        one = rows.groupBy(*map(col, keys)).agg(F.count("*").alias(counter), *kept)
        return stage(one.select(*map(col, [*keys, *others, counter])), "copies")

    prints = written.groupBy(*map(col, PRINTS)).agg(F.count("*").alias("rows")).where("rows > 1").select(*map(col, PRINTS))
    repeated = stage(prints, "repeated-rows")
    many = repeated.limit(repeats + 1).count()
    alone = [*map(col, [*keys, *others]), F.lit(1).cast("long").alias(counter)]
    if many == 0:
        return written.select(*alone)
    if many > repeats:
        return grouped(written)
    once = written.join(F.broadcast(repeated), PRINTS, "left_anti").select(*alone)
    return once.unionByName(grouped(written.join(F.broadcast(repeated), PRINTS, "left_semi")))


def check_missing_values(frame: DataFrame) -> DataFrame:
    """(column, missing): null cells per column."""
    frame = nan_to_null(frame)
    names = frame.columns
    counts = frame.agg(*[F.count_if(col(name).isNull()).alias(f"m{i}") for i, name in enumerate(names)])
    rows = [F.struct(F.lit(name).alias("column"), F.col(f"m{i}").alias("missing")) for i, name in enumerate(names)]
    return counts.select(F.inline(F.array(*rows)))


def check_duplicates(frame: DataFrame) -> DataFrame:
    """(duplicate_rows): rows beyond the first of each set of equal rows."""
    frame = nan_to_null(frame)
    return _extra_copies(stage(with_fingerprint(frame), "rows"), frame.columns).withColumnRenamed("extra", "duplicate_rows")


def _extra_copies(written: DataFrame, keys: list[str]) -> DataFrame:
    """(extra): rows beyond the first of each set of equal rows, of a written table with fingerprints.

    A task keeps two longs a row, not the row; only rows whose fingerprint repeats are grouped as a whole.
    """
    prints = written.groupBy(*map(col, PRINTS)).agg(F.count("*").alias("rows")).where("rows > 1").select(*map(col, PRINTS))
    suspects = written.join(stage(prints, "repeated-rows"), PRINTS, "left_semi").select(*map(col, keys))
    copies = group_copies(suspects, "copies of row")
    return copies.agg(F.coalesce(F.sum(F.col("copies of row") - 1), F.lit(0)).alias("extra"))


def validate_dates(frame: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """(invalid_dates): rows without a usable date, missing ones included; 0 without a Date column."""
    return frame.agg(_invalid_dates(frame, formats, F.lit(1)).alias("invalid_dates"))


def _invalid_dates(frame: DataFrame, formats: Sequence[str], weight: Column) -> Column:
    if "Date" not in frame.columns:
        return F.max(F.lit(0)).cast("long")
    parsed = parse_date(col("Date"), frame.schema["Date"].dataType, tuple(formats))
    return F.coalesce(F.sum(F.when(parsed.isNull(), weight)), F.lit(0)).cast("long")


def generate_quality_report(frame: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """(item, column, value): row count, nulls per column, duplicates and invalid dates.

    The rows are written once, with a fingerprint that finds duplicates; all else are plain counts.
    """
    frame = nan_to_null(frame)
    names = frame.columns
    written = stage(with_fingerprint(frame), "rows")
    facts = written.agg(
        F.count("*").alias("rows"),
        _invalid_dates(frame, formats, F.lit(1)).alias("dates"),
        *[F.count_if(col(name).isNull()).alias(f"m{i}") for i, name in enumerate(names)],
    ).crossJoin(_extra_copies(written, names))

    def entry(item: str, column: str | None, value: str) -> Column:
        return F.struct(
            F.lit(item).alias("item"), F.lit(column).cast("string").alias("column"), F.col(value).alias("value")
        )

    rows = [entry("Total Rows", None, "rows")]
    rows += [entry("Missing Values", name, f"m{i}") for i, name in enumerate(names)]
    rows += [entry("Duplicate Rows", None, "extra"), entry("Invalid Dates", None, "dates")]
    return facts.select(F.inline(F.array(*rows)))


def quality_score(frame: DataFrame) -> DataFrame:
    """(quality_score): populated share of all cells in percent, one decimal; 0 for an empty frame."""
    frame = nan_to_null(frame)
    populated = sum((F.count(col(name)) for name in frame.columns), F.lit(0))
    share = F.try_divide(populated * 100.0, F.count("*") * len(frame.columns))
    return frame.agg(F.round(F.coalesce(share, F.lit(0.0)), 1).alias("quality_score"))


def count_cells(frame: DataFrame) -> DataFrame:
    """(Column, Missing After, Unique Values After): null cells and exact distinct values of every column, from one pass.

    Cells are counted by column and value in every task, so that only its distinct values are shuffled, each with nothing of the other
    columns beside it. A number or date is sent as its 64-bit hash, which tells any two values of at most 64 bits
    apart (each step of the hash can be undone); all else is sent and compared in full, so there are no false matches.
    """

    def cell(place: int, name: str) -> Column:
        value, kind = col(name), frame.schema[name].dataType
        number, text = F.lit(None).cast("long"), F.lit(None).cast("string")
        if isinstance(kind, NumericType | DateType | TimestampType | TimestampNTZType | BooleanType) and not (
            isinstance(kind, DecimalType) and kind.precision > DECIMAL_LONG
        ):
            number = F.when(value.isNotNull(), F.xxhash64(value))
        elif isinstance(kind, ArrayType | MapType | StructType):
            text = F.to_json(F.struct(value), {"ignoreNullFields": "false"})
            text = F.when(value.isNotNull(), text)
        else:
            text = F.hex(value) if isinstance(kind, BinaryType) else value.cast("string")
        fields = {"place": F.lit(place), "number": number, "text": text}
        return F.struct(*[field.alias(name) for name, field in fields.items()])

    cells = frame.select(F.inline(F.array(*[cell(place, name) for place, name in enumerate(frame.columns)])))
    values = cells.groupBy("place", "number", "text").agg(F.count("*").alias("rows"))
    missing = F.col("number").isNull() & F.col("text").isNull()
    counts = values.groupBy("place").agg(
        F.coalesce(F.sum(F.when(missing, F.col("rows"))), F.lit(0)).alias("Missing After"),
        F.count_if(~missing).alias("Unique Values After"),
    )
    return counts.select(
        F.element_at(F.array(*map(F.lit, frame.columns)), F.col("place") + 1).alias("Column"),
        "Missing After",
        "Unique Values After",
    )


def _sketched_cells(frame: DataFrame) -> DataFrame:
    """The columns of ``count_cells``, with distinct counts from sketches."""
    facts = frame.agg(
        *[F.count_if(col(n).isNull()).alias(f"m{i}") for i, n in enumerate(frame.columns)],
        *[F.approx_count_distinct(col(n)).alias(f"d{i}") for i, n in enumerate(frame.columns)],
    )
    rows = [[F.lit(n), F.col(f"m{i}"), F.col(f"d{i}")] for i, n in enumerate(frame.columns)]
    return facts.select(F.inline(_entries(rows, ["Column", "Missing After", "Unique Values After"])))


def _entries(cells: list[list[Column]], fields: list[str]) -> Column:
    return F.array(*[F.struct(*[c.alias(f) for c, f in zip(cell, fields)]) for cell in cells])


def build_column_report(
    before: DataFrame,
    after: DataFrame,
    approximate: bool = False,
    weight: str | None = None,
    nulls_before: dict[str, int] | None = None,
    types: Sequence[ColumnType] | None = None,
) -> DataFrame:
    """One row per column of either frame: type, nulls before and after, distinct values after.

    ``weight`` names a column of ``before`` that counts the copies of each row. With ``nulls_before``, the null counts of
    its columns by name, ``before`` is not read. With ``types``, those inferred of its cells stand in one more column.
    """
    before, after = nan_to_null(before), nan_to_null(after)
    times = F.col(weight) if weight else F.lit(1)
    old = [name for name in before.columns if name != weight]
    names = list(dict.fromkeys([*old, *after.columns]))

    if nulls_before is None:
        nulls = before.agg(
            *[F.coalesce(F.sum(F.when(col(n).isNull(), times)), F.lit(0)).alias(f"m{i}") for i, n in enumerate(old)]
        )
        nulls = nulls.select(
            F.inline(_entries([[F.lit(n), F.col(f"m{i}")] for i, n in enumerate(old)], ["Column", "Missing Before"]))
        )
    else:
        known = [(name, nulls_before[name]) for name in old]
        nulls = after.sparkSession.createDataFrame(known, "Column string, `Missing Before` long")
    kinds = after.sparkSession.createDataFrame(
        [(field.name, field.dataType.simpleString()) for field in after.schema], "Column string, `Data Type After Cleaning` string"
    )
    facts = kinds.join(_sketched_cells(after) if approximate else count_cells(after), "Column", "left")
    place = F.array_position(F.array(*[F.lit(name) for name in names]), F.col("Column"))
    inferred = []
    if types:
        known = F.create_map(*[F.lit(text) for t in types for text in (t.column, t.type)])
        inferred = [F.coalesce(F.try_element_at(known, F.col("Column")), F.lit("void")).alias("Inferred Type Before")]
    return (
        nulls.join(facts, "Column", "full")
        .orderBy(place)
        .select(
            "Column",
            F.coalesce("Data Type After Cleaning", F.lit("void")).alias("Data Type After Cleaning"),
            *[
                F.coalesce(name, F.lit(0)).cast("long").alias(name)
                for name in ("Missing Before", "Missing After", "Unique Values After")
            ],
            *inferred,
        )
    )
