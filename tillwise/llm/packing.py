"""Packing tokenised documents into sequences by non-negative least squares over length combinations.

Method
    Whole windows  A document of more than ``window`` tokens gives whole windows from its start; what is left is its
                   remainder, shorter than a window.
    Histogram      Only the counts of the remainders' lengths reach the driver: at most ``window`` numbers.
    Combinations   Every multiset of one, two or three lengths that fills a window exactly, of lengths that occur.
    Solve          How often each combination is repeated: non-negative least squares against the histogram, by
                   projected gradient steps with momentum. Counts are rounded down, then dealt out again, largest first,
                   so that no length is used more often than it occurs.
    Residuals      Remainders that no combination took are laid end to end, longest first; each sequence greedily takes
                   what is next, and the remainder at its end is cut. The very last sequence is cut into powers of two, which
                   need no padding.

Scale
    A remainder finds its place from its length and its number among those of equal length, so nothing but the plan (of
    a size bounded by the window) is shared. Numbers are counted inside each written part and shifted by the parts
    before; no length, however frequent, is gathered in one task. Token ids are written once. They meet
    the shifts, a row for each part and length, in a join that Spark broadcasts when these are small and sorts when not.

Defined results: a null or empty text is the single end token; repeated rows are packed each on its own; a null id is carried
along; an empty table gives no rows; other columns are ignored unless kept, and then stand inside ``row``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tillwise.llm.common import slices
from tillwise.sources.staging import stage

WINDOW = 1024
SLICE_BYTES = 1 << 20
END = 0
#: Texts of these characters only are split alike by both tokenizer libraries; the rest goes through the slower one.
ALIKE = re.compile(r"[\t\n\r -~¡-ɏ]*")


@cache
def _encoders(json_path: str, ranks_path: str | None):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    if ranks_path is None:
        return exact, None
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return exact, fast


def token_ids(texts: list[str | None], json_path: str, ranks_path: str | None = None) -> list[np.ndarray]:
    """Ids of each text and the end token, as the ``tokenizers`` file gives them without special tokens.

    With the same vocabulary as a rank file, texts on which both libraries agree by construction (see ``ALIKE``; no
    special token's name inside) are encoded by the faster one.
    """
    exact, fast = _encoders(json_path, ranks_path)
    out: list[np.ndarray | None] = [None] * len(texts)
    slow = []
    for k, text in enumerate(texts):
        if not text:
            out[k] = np.array([END], "<u4")
        elif fast is not None and "<|" not in text and ALIKE.fullmatch(text):
            out[k] = np.array([*fast.encode_ordinary(text), END], "<u4")
        else:
            slow.append(k)
    for k, found in zip(slow, exact.encode_batch([texts[k] for k in slow], add_special_tokens=False) if slow else []):
        out[k] = np.array([*found.ids, END], "<u4")
    return out


# --- the plan ---------------------------------------------------------------------------------------------------------


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none), falling, of those given, that add up to the window."""
    known = np.zeros(window + 1, bool)
    known[lengths] = True
    known[0] = True
    a, b = np.meshgrid(np.arange(window + 1), np.arange(window + 1), indexing="ij")
    c = window - a - b
    fits = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[fits], b[fits], c[fits]
    good = known[a] & known[b] & known[c]
    return np.stack([a[good], b[good], c[good]], axis=1)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative ``x`` that minimises ``|A x - histogram|``; column j of A counts the lengths of combination j."""
    n = len(histogram)

    def lengths_used(x: np.ndarray) -> np.ndarray:
        used = sum(np.bincount(combos[:, k], x, n) for k in range(combos.shape[1]))
        used[0] = 0
        return used

    x = y = np.zeros(len(combos))
    if not len(combos):
        return x
    # The largest eigenvalue of A'A, by power iteration, bounds the step.
    v = np.ones(len(combos))
    for _ in range(20):
        v = sum((u := lengths_used(v))[combos[:, k]] for k in range(combos.shape[1]))
        norm = np.linalg.norm(v)
        v = v / norm
    step, momentum = 0.9 / max(norm, 1.0), 1.0
    for _ in range(steps):
        error = histogram - lengths_used(y)
        error[0] = 0
        moved = np.maximum(0, y + step * sum(error[combos[:, k]] for k in range(combos.shape[1])))
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = moved + (momentum - 1) / following * (moved - x)
        x, momentum = moved, following
    return x


class Plan:
    """Where the k-th remainder of every length goes."""

    def __init__(self, histogram: np.ndarray, window: int):
        self.window = window
        histogram = histogram.astype(np.int64)
        combos = combinations(np.flatnonzero(histogram), window)
        solved = repeat_counts(combos, histogram.astype(float))
        left, repeats = histogram.tolist(), [0] * len(combos)
        parts = [[length for length in combo if length] for combo in combos.tolist()]
        # Rounded counts first, then what is still possible, both from the most used combination down.
        for wanted in (np.floor(solved + 1e-9).astype(np.int64).tolist(), None):
            for j in np.argsort(-solved, kind="stable").tolist():
                if wanted and not wanted[j]:
                    break
                n = min(left[length] // parts[j].count(length) for length in parts[j])
                n = min(n, wanted[j]) if wanted else n
                if n:
                    repeats[j] += n
                    for length in parts[j]:
                        left[length] -= n
        left, repeats = np.array(left, np.int64), np.array(repeats, np.int64)
        self.sequences = int(repeats.sum())
        # Places of a length: its first `run` numbers go to sequences from `sequence` on, at `offset`, and so on.
        begin = np.cumsum(repeats) - repeats
        rows: list[tuple[int, int, int, int]] = []
        for j in np.flatnonzero(repeats):
            offset = 0
            for length in combos[j][combos[j] > 0]:
                rows.append((int(length), int(repeats[j]), int(begin[j]), offset))
                offset += int(length)
        rows.sort(key=lambda row: row[0])
        table = np.array(rows, np.int64).reshape(-1, 4)
        self._run = table[:, 1]
        self._sequence, self._offset = table[:, 2], table[:, 3]
        ends = np.cumsum(self._run)
        self._first = np.searchsorted(table[:, 0], np.arange(window + 2))
        self._starts = ends - self._run
        # Residuals, longest first: the place of the first of each length on the line.
        self.used = histogram - left
        held = (left * np.arange(len(left)))[::-1]
        self._line = (np.cumsum(held) - held)[::-1]
        total = int(held.sum())
        self.tail = total // window * window
        self.cuts = [self.tail]  # ends of the sequences in the last, incomplete window
        for bit in range(window.bit_length(), -1, -1):
            if (total - self.tail) >> bit & 1:
                self.cuts.append(self.cuts[-1] + (1 << bit))
        self.residual_sequences = total // window + len(self.cuts) - 1

    def places(self, length: int, number: int) -> list[tuple[int, int, int, int]]:
        """Pieces ``(begin, length, sequence, offset)`` of the number-th remainder of a length."""
        if number < self.used[length]:
            a = self._first[length]
            base = self._starts[a]
            j = int(np.searchsorted(self._starts[a : self._first[length + 1]], base + number, "right")) - 1 + a
            return [(0, length, int(self._sequence[j] + base + number - self._starts[j]), int(self._offset[j]))]
        at = int(self._line[length] + (number - self.used[length]) * length)
        out, begin = [], 0
        while begin < length:
            where = at + begin
            if where < self.tail:
                sequence, offset = divmod(where, self.window)
                room = self.window - offset
            else:
                k = int(np.searchsorted(self.cuts, where, "right")) - 1
                sequence, offset = self.tail // self.window + k, where - self.cuts[k]
                room = self.cuts[k + 1] - where
            size = min(room, length - begin)
            out.append((begin, size, self.sequences + sequence, offset))
            begin += size
        return out


# --- the job ----------------------------------------------------------------------------------------------------------


def _shift_rows(counts: DataFrame) -> DataFrame:
    """For each part and length: how many such remainders, and how many whole windows, stand in the parts before."""
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    whole = counts.groupBy("part").agg(F.sum("whole").alias("whole"))
    whole = whole.select("part", F.coalesce(F.sum("whole").over(earlier), F.lit(0)).alias("whole_before"))
    rests = counts.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rest_before"))
    return rests.join(whole, "part")


def pack(
    docs: DataFrame,
    keep: list[str],
    json_path: str,
    ranks_path: str | None = None,
    window: int = WINDOW,
    text_column: str = "text",
) -> DataFrame:
    """Pieces of all documents.

    ``row`` (struct of the columns to keep), ``start`` (ids of the document before the piece), ``length``, ``ids``
    (little-endian unsigned 32-bit), ``ids_crc32``, ``doc_tokens`` (all ids of the document with the end token),
    ``sequence_id`` and ``offset``. Every sequence is gapless from offset 0 and has ``window`` ids, but for the last
    few, whose lengths are powers of two.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_column}`").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack_ids = zstandard.ZstdCompressor(level=3).compress
        part, whole_so_far, so_far = TaskContext.get().partitionId(), 0, np.zeros(window, np.int64)
        for batch in batches:
            for some in slices(batch, 1, SLICE_BYTES):
                found = token_ids(some.column(1).to_pylist(), json_path, ranks_path)
                counts = [len(ids) for ids in found]
                whole, number = [], []
                for n in counts:
                    whole.append(whole_so_far)
                    number.append(int(so_far[n % window]))
                    whole_so_far += n // window
                    so_far[n % window] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array(np.full(len(counts), part, np.int32)),
                        pa.array(counts, pa.int64()),
                        pa.array(whole, pa.int64()),
                        pa.array(number, pa.int64()),
                        pa.array([pack_ids(ids.tobytes()) for ids in found], pa.binary()),
                    ],
                    ["row", "part", "n", "whole", "number", "z"],
                )

    names = [("part", T.IntegerType()), ("n", T.LongType()), ("whole", T.LongType()), ("number", T.LongType())]
    kinds = T.StructType([rows.schema["row"], *(T.StructField(*x) for x in names), T.StructField("z", T.BinaryType())])
    tokens = stage(rows.mapInArrow(encode, kinds), "tokens")
    rest = (F.col("n") % window).cast("int")
    counts = tokens.groupBy("part", rest.alias("rest")).agg(
        F.count("*").alias("n"), F.sum(F.floor(F.col("n") / window).cast("long")).alias("whole")
    )
    histogram, whole_all = np.zeros(window + 1, np.int64), 0
    for row in counts.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole")).collect():  # <= window
        histogram[row.rest] += row.n if row.rest else 0
        whole_all += row.whole
    plan = Plan(histogram, window)
    shifts = stage(_shift_rows(counts), "shifts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for some in (part for batch in batches for part in slices(batch, 4, SLICE_BYTES)):
            source, columns = [], [[] for _ in range(7)]
            n, whole, number, z, rest_before, whole_before = (some.column(k).to_pylist() for k in range(1, 7))
            for k in range(some.num_rows):
                ids = unpack(z[k])
                full, rest = divmod(n[k], window)
                pieces = [(j * window, window, whole_before[k] + whole[k] + j, 0) for j in range(full)]
                if rest:
                    for begin, length, sequence, offset in plan.places(rest, rest_before[k] + number[k]):
                        pieces.append((full * window + begin, length, whole_all + sequence, offset))
                for begin, length, sequence, offset in pieces:
                    own = ids[4 * begin : 4 * (begin + length)]
                    source.append(k)
                    for column, value in zip(columns, (begin, length, own, zlib.crc32(own), n[k], sequence, offset)):
                        column.append(value)
            long = pa.int64()
            types = [long, long, pa.binary(), long, long, long, long]
            yield pa.RecordBatch.from_arrays(
                [some.column(0).take(pa.array(source, long)), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["row", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    joined = tokens.withColumn("rest", rest).join(shifts, ["part", "rest"])
    joined = joined.select("row", "n", "whole", "number", "z", "rest_before", "whole_before")
    fields = [joined.schema["row"]] + [
        T.StructField(name, T.BinaryType() if name == "ids" else T.LongType())
        for name in ("start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    ]
    return joined.mapInArrow(cut, T.StructType(fields))
