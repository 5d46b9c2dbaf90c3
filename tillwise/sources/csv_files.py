"""CSV files in and out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillwise.fixed_values import NULL_TOKENS
from tillwise.functions.text import col
from tillwise.operators.cleaning import standardize_column_names
from tillwise.sources.staging import stage

LINE, FILE = "line that does not fit", "file of line"
BAD_LINE = "A CSV line has more cells than the header, or a broken quote: "
BAD_HEADER = "A CSV file has another header than the others of its path: "
OPEN_QUOTE = "A quoted CSV cell is never closed in: "
BLOCK_BITS = 15  # lines of a block: 2 ** 15
SHOWN = 200  # characters of a bad line
OPTIONS = {"header": True, "escape": '"', "encoding": "UTF-8"}


def load_data(
    spark: SparkSession, path: str | list[str], line_breaks_in_cells: bool | None = None, file_column: str | None = None
) -> DataFrame:
    """Raw sales rows from files or folders with a header row.

    Cells stay text; texts that mean "no value" are null. Large files are split over many tasks, also those with line
    breaks in quoted cells. Whether a file has such breaks is found by one scan that looks for lines with an open
    quote; True takes them as given for all files, False promises that there are none (a break then stops the job).

    Every path of a list is read by its own header, and the columns are put together by standard name. Files of one
    folder must have one header; another one stops the job. So does a line with more cells than the header, or a
    quote that is never closed. A line with fewer cells has nulls at its end. Blank lines are skipped. ``file_column`` adds a
    column with the path of the file of each row.
    """
    parts = [_read(spark, one, line_breaks_in_cells, file_column) for one in ([path] if isinstance(path, str) else path)]
    if any(part.columns != parts[0].columns for part in parts):
        parts = [standardize_column_names(part) for part in parts]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


def _read(spark: SparkSession, path: str, line_breaks_in_cells: bool | None, file_column: str | None) -> DataFrame:
    # The header may hold a line break too; in either way only the first record is parsed here.
    begins = _lines(spark, path).where((F.col("start") == 0) & (F.trim("value") != "")).select(_open(F.col("value")).alias("open"))
    header = spark.read.csv(path, multiLine=bool((begins.first() or {"open": False})["open"]), **OPTIONS)
    files = len(header.inputFiles())
    # Files are told apart by their paths as Spark lists them; filters on the path prune files before they are opened.
    place, broken = F.col("_metadata.file_path"), None
    if line_breaks_in_cells is None:
        found = _lines(spark, path).where(_open(F.col("value")) | _breaks_inside(F.col("value"))).select("file").distinct().collect()
        broken = [row["file"] for row in found]
    names, kinds = header.columns, StructType([*header.schema.fields, StructField(LINE, StringType())])
    parts = []
    if not line_breaks_in_cells and (broken is None or len(broken) < max(files, 1)):
        # With pruned columns the parser would not see the surplus cells.
        plain = spark.read.option("columnPruning", "false").csv(
            path, schema=kinds, columnNameOfCorruptRecord=LINE, enforceSchema=files == 1, **OPTIONS
        )
        plain = plain.where(~place.isin(broken)) if broken else plain
        parts.append(plain.select(*map(col, plain.columns), *([place.alias(FILE)] if file_column else [])))
    if line_breaks_in_cells or broken:
        lines = _lines(spark, path)
        parsed = _parsed(_records(lines.where(F.col("file").isin(broken)) if broken else lines), names)
        parts.append(parsed if file_column else parsed.drop(FILE))
    raw = reduce(DataFrame.unionByName, parts)
    # The message names a cell as well, because Spark refuses to read nothing but the line.
    shown = F.concat(F.lit(BAD_LINE), F.left(F.col(LINE), F.lit(SHOWN)), F.left(F.coalesce(col(names[0]), F.lit("")), F.lit(0)))
    bad = _does_not_fit(len(names), unchecked=line_breaks_in_cells is False)
    fits = raw.where(F.when(bad, F.raise_error(shown).cast("boolean")).otherwise(F.lit(True)))
    cells = [F.when(~col(name).isin(NULL_TOKENS), col(name)).alias(name) for name in names]
    return fits.select(*cells, *([col(FILE).alias(file_column)] if file_column else []))


# --- quotes -----------------------------------------------------------------------


def _unquoted(text: Column) -> Column:
    """The text without its closed quoted cells; no repeated group, which would overflow the stack on long cells.

    Doubled quotes go first. What starts a cell with a quote afterwards was never closed; a quote inside an unquoted cell is a
    character like any other.
    """
    return F.regexp_replace(F.replace(text, F.lit('""'), F.lit("")), r'(^|,)"[^"]*"', "$1")


def _open(text: Column) -> Column:
    """Whether a quoted cell is open at the end of a text that starts outside of one."""
    return F.when(F.contains(text, F.lit('"')), _unquoted(text).rlike('(^|,)"')).otherwise(F.lit(False))


def _breaks_inside(line: Column) -> Column:
    """Whether a quoted cell of the line holds a carriage return, which the plain reader takes for a line end."""
    returns = lambda text: F.length(text) - F.length(F.translate(text, "\r", ""))
    return F.when(F.contains(line, F.lit("\r")) & F.contains(line, F.lit('"')), returns(line) > returns(_unquoted(line))).otherwise(False)


def _does_not_fit(columns: int, unchecked: bool) -> Column:
    """Whether the line kept by the reader is too long or has an open quote; lines that are only short are fine.

    Where no scan has looked for open quotes, any quote left on a short line is taken for the end of one.
    """
    left = _unquoted(F.col(LINE))
    cells = F.length(left) - F.length(F.translate(left, ",", "")) + 1
    quote = F.contains(left, F.lit('"')) if unchecked else left.rlike('(^|,)"')
    return F.col(LINE).isNotNull() & ((cells > columns) | quote)


# A line turns "inside a quoted cell" (1) or "outside" (0) before it into the state after it. Four such changes exist.
KEEPS, SWAPS, ENDS_OUTSIDE, ENDS_INSIDE = 0, 1, 2, 3


def _state_change(line: Column) -> Column:
    outside, inside = _open(line), _open(F.concat(F.lit('"'), line))  # the state after the line, by the state before it
    kind = F.when(outside, F.when(inside, ENDS_INSIDE).otherwise(SWAPS)).otherwise(F.when(inside, KEEPS).otherwise(ENDS_OUTSIDE))
    return F.when(F.contains(line, F.lit('"')), kind).otherwise(F.lit(KEEPS))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, at, value``: physical lines with the split they were read in and their order in it."""
    text = spark.read.option("lineSep", "\n").text(path)
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return text.select(*split, F.monotonically_increasing_id().alias("at"), "value")


def _records(lines: DataFrame) -> DataFrame:
    """``file, header, record``: whole records, which may span lines and splits; ``header`` marks the first of a file.

    Each line is a change of the state "inside a quoted cell". Changes are composed within each split, for both states that it
    may start in, and written once with the lines. Splits are then composed within each file (one row per split), which tells
    the state before every line. Lines that are whole records pass on as they are; only lines of longer records are
    grouped. Lines stay with their split, so no task holds more than a split and one record.
    """
    # A long split is composed of blocks of lines, as a file is of splits: no window holds more than one block.
    lines = lines.withColumn("start", F.struct("start", F.shiftright("at", BLOCK_BITS).alias("block")))
    own = Window.partitionBy("file", "start").orderBy("at")
    upto, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    change = _state_change(F.col("value"))
    lines = lines.withColumn("change", change).withColumn("swaps", (F.sum((F.col("change") == SWAPS).cast("int")).over(upto) % 2).cast("int"))
    # A fixed state, made relative to the swaps so far, holds until the next fixed one.
    fixed = F.when(F.col("change") >= ENDS_OUTSIDE, (F.col("change") - ENDS_OUTSIDE).bitwiseXOR(F.col("swaps")))
    lines = lines.withColumn("fixed", fixed)
    states = {}
    for begin in (0, 1):
        reached = F.coalesce(F.last("fixed", ignorenulls=True).over(before), F.lit(begin))
        states[f"before{begin}"] = reached.bitwiseXOR(F.coalesce(F.lag("swaps").over(own), F.lit(0)))
        reached = F.coalesce(F.last("fixed", ignorenulls=True).over(upto), F.lit(begin))
        states[f"after{begin}"] = reached.bitwiseXOR(F.col("swaps"))
    lines = lines.withColumns(states)
    # A record is known by the line it starts in; 0 are the lines of a split that end a record of an earlier split.
    lines = lines.withColumns({f"number{begin}": F.sum(1 - F.col(f"before{begin}")).over(upto) for begin in (0, 1)})
    lines = stage(lines.drop("change", "swaps", "fixed"), "csv-lines")
    splits = stage(_splits(lines), "csv-splits")
    unclosed = splits.groupBy("file").agg(F.max_by("end", "start").alias("end")).where("end = 1").select("file").limit(1).collect()
    if unclosed:  # known before any record is put together: it would reach to the end of its file
        raise ValueError(OPEN_QUOTE + unclosed[0]["file"])

    # Broadcast of one short row per block of lines.
    lines = lines.join(F.broadcast(splits.select("file", "start", "begin", "header_at")), ["file", "start"])
    by_begin = lambda name: F.when(F.col("begin") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1")).alias(name)
    header = F.coalesce(F.col("at") == F.col("header_at"), F.lit(False)).alias("header")
    lines = lines.select("file", "start", "at", "value", header, *map(by_begin, ("before", "after", "number")))
    whole = lines.where("before = 0 and after = 0").select("file", "header", F.col("value").alias("record"))

    def text(order: str, value: str) -> Column:
        parts = F.sort_array(F.collect_list(F.struct(order, value)))
        return F.array_join(F.transform(parts, lambda part: part[value]), "\n").alias("record")

    rest = lines.where("before = 1 or after = 1")
    pieces = rest.groupBy("file", "start", "number").agg(text("at", "value"), F.some("header").alias("header"))
    # Lines at the start of a split go to the record that the nearest earlier split with a start of one left open.
    ends = rest.groupBy("file", "start").agg(F.max("number").alias("number"), F.min("number").alias("least"))
    ends = ends.select("file", "start", F.explode(F.array_distinct(F.array("least", "number"))).alias("number"))
    latest = Window.partitionBy("file").orderBy("start", "number").rowsBetween(Window.unboundedPreceding, 0)
    origin = F.last(F.when(F.col("number") > 0, F.struct("start", "number")), ignorenulls=True).over(latest)
    heads = ends.withColumn("origin", origin).where("number = 0")
    pieces = pieces.join(heads, ["file", "start", "number"], "left").withColumn("origin", F.coalesce("origin", F.struct("start", "number")))
    joined = pieces.groupBy("file", "origin").agg(text("start", "record"), F.some("header").alias("header"))
    return whole.unionByName(joined.select("file", "header", "record"))


def _splits(lines: DataFrame) -> DataFrame:
    """``file, start, begin, end, header_at``: the state each split begins and ends in, and the line its file's header starts in."""
    blank = F.trim(F.regexp_replace("value", r"\r\z", "")) == ""
    splits = lines.groupBy("file", "start").agg(
        F.max_by("after0", "at").alias("after0"), F.max_by("after1", "at").alias("after1"), F.min(F.when(~blank, F.col("at"))).alias("first")
    )
    along = Window.partitionBy("file").orderBy("start")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    swaps = F.sum(F.expr("cast(after0 = 1 and after1 = 0 as int)")).over(upto) % 2
    splits = splits.withColumn("swaps", swaps.cast("int"))
    fixed = F.when(F.col("after0") == F.col("after1"), F.col("after0").bitwiseXOR(F.col("swaps")))
    reached = F.coalesce(F.last(fixed, ignorenulls=True).over(upto), F.lit(0))
    splits = splits.withColumn("end", reached.bitwiseXOR(F.col("swaps")))
    earlier = F.count("first").over(along.rowsBetween(Window.unboundedPreceding, -1))
    return splits.select(
        "file", "start", F.coalesce(F.lag("end").over(along), F.lit(0)).alias("begin"), "end", F.when(earlier == 0, F.col("first")).alias("header_at")
    )


def _parsed(records: DataFrame, names: list[str]) -> DataFrame:
    """The cells of records; the first record of each file must be the header."""
    record = F.regexp_replace("record", r"\r\z", "")  # the rest of a line end of two characters
    records = records.select("file", "header", record.alias("record")).where(F.trim(F.col("record")) != "")
    places = [f"c{place}" for place in range(len(names))]
    kinds = ", ".join(f"{place} string" for place in [*places, "unfit"])
    options = {"escape": '"', "columnNameOfCorruptRecord": "unfit", "mode": "PERMISSIVE"}
    # Out of a generator, so that no filter or column makes the parser run again.
    cells = F.explode(F.array(F.from_csv("record", kinds, options))).alias("cells")
    # Names that the reader made up: for an empty one, and for one that stands twice.
    same = [
        F.coalesce(F.col(f"cells.c{k}").isin(name) | (F.concat(f"cells.c{k}", F.lit(str(k))) == name), F.lit(name == f"_c{k}"))
        for k, name in enumerate(names)
    ]
    other = ~(reduce(Column.__and__, same) & F.col("cells.unfit").isNull())
    wrong = records.where("header").select("file", cells).where(other).select("file").limit(1).collect()
    if wrong:
        raise ValueError(BAD_HEADER + wrong[0]["file"])
    rows = records.where("not header").select("file", cells)
    own = [F.col(f"cells.{place}").alias(name) for place, name in zip(places, names)]
    return rows.select(*own, F.col("cells.unfit").alias(LINE), F.col("file").alias(FILE))


def write_csv(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write UTF-8 files with a header; dates as ``YYYY-MM-DD``, missing values as empty cells."""
    writer = frame.write.mode(mode).option("header", True).option("escape", '"').option("encoding", "UTF-8")
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)  # cells as they are
    writer.option("dateFormat", "yyyy-MM-dd").option("timestampFormat", "yyyy-MM-dd").option(
        "timestampNTZFormat", "yyyy-MM-dd"
    ).option("emptyValue", "").csv(path)
