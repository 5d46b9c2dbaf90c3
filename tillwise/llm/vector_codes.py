"""Product codes of vectors, with exact integer assignments pruned by pivots (LAESA).

Method
    Vectors become whole numbers, ``floor(scale * x)``, and are cut into equal consecutive parts. Every part position has a
    codebook. A few of its first entries, spread far apart, are the fixed pivots of that position; the distance of every part to
    every pivot is computed once and written beside the part. In each round the distances of the entries to the pivots
    are computed; by the triangle inequality the distance of a part and an entry is at least the largest difference of
    their pivot distances. Entries are tried in the order of these lower bounds, nearest first, with exact whole-number
    distances, until the next bound exceeds the best distance found. Ties go to the lower index, so an entry whose bound equals
    the best is still tried. Assignments are exact, whatever the pivots.

Scale
    One narrow pass per round: tasks assign their parts and add up their own sums and counts per entry, so the shuffle has at
    most one row per task, part position and used entry. The driver and the broadcast hold the codebooks: ``entries`` times the
    length of a vector, a bound set by parameters. The first codebook is a top-``entries`` by id, no sort of the table.
    Error totals of a label are joined by broadcast while there are at most ``LABELS`` of them; beyond that the join is salted, so a
    label with a third of all rows is spread over ``SALTS`` tasks.

Defined results: vectors that are null or hold a null or non-finite component are dropped, and so are those whose whole
numbers have a squared length of 2**60 or more (errors need not fit a long) and those that do not have the commonest
length among lengths that can be cut into equal parts (empty vectors cannot; ties go to the longer). Every other row has a result row,
repeated rows and ids too; a null id counts as the largest, and rows of one id are ordered by their vectors. With fewer
rows than entries the codebook has one entry per row. Null labels are one label. An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tillwise.sources.staging import stage

PIVOTS = 8
LABELS = 20_000  # totals that are broadcast; a row each
SALTS = 64
ROWS = 512  # parts that are assigned together: their bounds take ROWS * entries * 8 bytes


def whole_numbers(vectors: DataFrame, scale: int, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """``vec_id, label, v``: rows with a usable vector, as whole numbers."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    square = lambda x: F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double")
    length = F.aggregate("v", F.lit(0.0), lambda total, x: total + square(x))
    rows = vectors.select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"),
        F.col(f"`{label_column}`").alias("label"),
        F.col(f"`{vector_column}`").cast("array<double>").alias("v"),
    )
    fits = F.when(F.coalesce(finite, F.lit(False)), length < 2.0**60).otherwise(False)
    return rows.where(fits).withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))


# --- one part position ------------------------------------------------------------


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances row by row, in whole numbers."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every point to every pivot: the root of a whole number, rounded once."""
    return np.stack([np.sqrt(squares(points, pivot[None, :]).astype(np.float64)) for pivot in pivots], axis=1)


def choose_pivots(book: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Entries far from each other: each next one is the farthest from those before, the lowest index on ties."""
    chosen = [0]
    gap = distances(book, book[:1])[:, 0]
    while len(chosen) < min(count, len(book)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(book, book[chosen[-1:]])[:, 0])
    return book[chosen]


def assign(
    parts: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, book_to_pivots: np.ndarray, tried: list | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower one on ties) and its squared distance, for every part.

    ``tried`` is given the number of exact distances that were computed.
    """
    bound = np.zeros((len(parts), len(book)))
    gap = np.empty_like(bound)
    for pivot in range(to_pivots.shape[1]):
        np.subtract(to_pivots[:, pivot, None], book_to_pivots[None, :, pivot], out=gap)
        np.maximum(bound, np.abs(gap, out=gap), out=bound)
    # The roots were rounded: a bound may be too large by a few units in the last place of the distances.
    slack = 1e-14 * (to_pivots.max(axis=1, initial=0.0) + book_to_pivots.max(initial=0.0))
    order = np.argsort(bound, axis=1)  # the result does not depend on the order of equal bounds
    best = np.full(len(parts), np.iinfo(np.int64).max)
    index = np.zeros(len(parts), np.int64)
    rows, begin, width = np.arange(len(parts)), 0, 4
    while begin < len(book) and len(rows):
        cols = order[rows, begin : begin + width]
        row = np.repeat(rows, cols.shape[1])
        col = cols.reshape(-1)
        if begin:  # within the step, only entries that can still win
            near = bound[row, col] <= np.sqrt(best[row].astype(np.float64)) * (1 + 1e-14) + slack[row]
            row, col = row[near], col[near]
        gap = squares(parts[row], book[col])
        if tried is not None:
            tried.append(len(row))
        better = (gap < best[row]) | ((gap == best[row]) & (col < index[row]))
        row, col, gap = row[better], col[better], gap[better]
        if len(row):  # of several better entries of a part the best one, the lower on ties
            pick = np.lexsort((col, gap, row))
            first = np.ones(len(pick), bool)
            first[1:] = row[pick][1:] != row[pick][:-1]
            pick = pick[first]
            best[row[pick]], index[row[pick]] = gap[pick], col[pick]
        begin, width = begin + width, width * 2
        if begin < len(book):
            reach = np.sqrt(best[rows].astype(np.float64)) * (1 + 1e-14) + slack[rows]
            rows = rows[bound[rows, order[rows, begin]] <= reach]
    return index, best


class Books:
    """The codebooks of all part positions, with the fixed pivots and the distances between both."""

    def __init__(self, books: list[np.ndarray], pivots: list[np.ndarray] | None = None):
        self.books = books
        self.pivots = pivots or [choose_pivots(book) for book in books]
        self.to_pivots = [distances(book, pivot) for book, pivot in zip(self.books, self.pivots)]

    def text(self) -> str:
        return ",".join(str(x) for book in self.books for x in book.reshape(-1).tolist())

    def measure(self, parts: list[np.ndarray]) -> np.ndarray:
        """Distances of the parts of each vector to the pivots of their positions, side by side."""
        return np.concatenate([distances(part, pivot) for part, pivot in zip(parts, self.pivots)], axis=1)

    def assign(self, parts: list[np.ndarray], measured: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index and squared distance for every part position."""
        begin = 0
        for part, pivot, book, far in zip(parts, self.pivots, self.books, self.to_pivots):
            own = measured[:, begin : begin + len(pivot)]
            begin += len(pivot)
            done = [assign(part[k : k + ROWS], own[k : k + ROWS], book, far) for k in range(0, len(part), ROWS)]
            yield tuple(np.concatenate(columns) for columns in zip(*done))


def _cut(lists: pa.Array, dim: int, parts: int) -> list[np.ndarray]:
    values = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim)
    return [np.ascontiguousarray(values[:, k : k + dim // parts]) for k in range(0, dim, dim // parts)]


def _lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.reshape(-1))
    )


# --- on Spark ---------------------------------------------------------------------


def _measured(numbers: DataFrame, books: Books, dim: int, parts: int) -> DataFrame:
    """The rows with the distances of their parts to the pivots, written once for all rounds."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = books.measure(_cut(batch.column("v"), dim, parts))
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(far)], [*batch.schema.names, "far"])

    kinds = StructType([*numbers.schema.fields, StructField("far", ArrayType(DoubleType()))])
    return stage(numbers.mapInArrow(measure, kinds), "pivot-distances")


def _next_books(measured: DataFrame, books: Books, dim: int, parts: int) -> Books:
    """One round: every part to its nearest entry, every used entry to the floor of the mean of its parts."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(book), np.int64) for book in books.books]
        total = [np.zeros(book.shape, np.int64) for book in books.books]
        for batch in batches:
            if batch.num_rows:
                cut, far = _cut(batch.column("v"), dim, parts), batch.column("far")
                far = far.flatten().to_numpy().reshape(batch.num_rows, -1)
                for k, (index, _) in enumerate(books.assign(cut, far)):
                    count[k] += np.bincount(index, minlength=len(count[k]))
                    np.add.at(total[k], index, cut[k])
        for k, (n, sums) in enumerate(zip(count, total)):
            used = np.flatnonzero(n)
            if len(used):
                columns = [pa.array(np.full(len(used), k, np.int32)), pa.array(used), pa.array(n[used]), _lists(sums[used])]
                yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "rows", "sums"])

    width = dim // parts
    sums = measured.select("v", "far").mapInArrow(add_up, "part int, entry long, rows long, sums array<long>")
    # Sums of all tasks in decimals: no overflow at any number of rows.
    added = sums.groupBy("part", "entry").agg(
        F.sum("rows").alias("rows"), F.array(*[F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")) for k in range(width)]).alias("sums")
    )
    new = [book.copy() for book in books.books]
    for row in added.collect():  # at most one row per entry
        new[row["part"]][row["entry"]] = [int(x) // row["rows"] for x in row["sums"]]
    return Books(new, books.pivots)


def _coded(measured: DataFrame, books: Books, dim: int, parts: int) -> DataFrame:
    digits = np.array([f"{k:0{_digits(books)}x}" for k in range(max(len(book) for book in books.books))], object)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = batch.column("far").flatten().to_numpy().reshape(batch.num_rows, -1)
                index, gaps = zip(*books.assign(_cut(batch.column("v"), dim, parts), far))
                codes = ["".join(row) for row in zip(*[digits[k] for k in index])]
                columns = [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(sum(gaps))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    label = measured.schema["label"].dataType.simpleString()
    return measured.mapInArrow(code, f"vec_id long, label {label}, code string, error long")


def _digits(books: Books) -> int:
    """Hex digits of an index, two at least."""
    return max(2, len(f"{max(len(book) for book in books.books) - 1:x}"))


def with_label_error(coded: DataFrame, labels: int = LABELS, salts: int = SALTS) -> DataFrame:
    """Add the sum of the errors of all rows with the same label."""
    key = F.coalesce(F.col("label").cast("string"), F.lit(""))
    keyed = coded.withColumns({"label_key": key, "no_label": F.col("label").isNull()})
    totals = keyed.groupBy("label_key", "no_label").agg(F.sum("error").alias("label_error"))
    if totals.limit(labels + 1).count() <= labels:
        return keyed.join(F.broadcast(totals), ["label_key", "no_label"])
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    spread = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, ["label_key", "no_label", "salt"])


def compress(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> tuple[DataFrame, Books]:
    """``vec_id, label, code, error`` of every row as a written table, and the final codebooks."""
    numbers = whole_numbers(vectors, scale, id_column, vector_column, label_column)
    size = F.size("v")
    lengths = numbers.groupBy(size.alias("dim")).agg(F.count("*").alias("rows")).where((F.col("dim") > 0) & (F.col("dim") % parts == 0))
    common = lengths.orderBy(F.desc("rows"), F.desc("dim")).first()
    if common is None:
        label = numbers.schema["label"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id long, label {label}, code string, error long"), Books([])
    dim = common["dim"]
    numbers = numbers.where(size == dim)
    first = numbers.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    start = np.array([row["v"] for row in first], np.int64)
    books = Books([start[:, k : k + dim // parts] for k in range(0, dim, dim // parts)])
    measured = _measured(numbers, books, dim, parts)
    for _ in range(rounds):
        books = _next_books(measured, books, dim, parts)
    return stage(_coded(measured, books, dim, parts), "vector-codes"), books


def digest(books: Books) -> str:
    return sha256(books.text().encode()).hexdigest()
