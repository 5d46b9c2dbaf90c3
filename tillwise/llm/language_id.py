"""Language identification by rank-order n-gram profiles and out-of-place distance.

Method
    A profile is the list of the most frequent character n-grams (1 to ``GRAM`` letters, words padded with a blank) in
    order of falling count. Language profiles are learned from counts over all training documents. A document's own
    profile, from its whole text, is compared with each: the distance is the sum over its n-grams of how far each is
    out of its place in the language profile; an n-gram the language does not have costs the full profile length. The
    language with the smallest distance wins, ties go to the smaller name.

Scale
    Counts are combined in each task before the shuffle (n-grams are far fewer than texts). Only the finished profiles,
    ``PROFILE`` n-grams for each language, reach the driver and travel with the function. Classifying is one pass
    without a shuffle.

Defined results: a null or empty text, or one without a letter, is ``und`` with score 0; if nothing could be learned,
every text is; rows with a null language or a null id are not learned from; repeated rows count as often as they stand;
an empty table gives no rows; further columns are ignored or carried along in ``row``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tillwise.llm.common import slices

GRAM = 3
PROFILE = 400
BITS = 21  # of a code point
UNKNOWN = "und"


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter, and whether it is a letter at all."""
    every = [chr(point) for point in range(sys.maxunicode + 1)]
    lower = [ord(low) if len(low := char.lower()) == 1 else ord(char) for char in every]
    return np.array(lower, np.uint64), np.array([char.isalpha() for char in every])


def grams(text: str | None) -> np.ndarray:
    """Codes of all n-grams of a text, in any order; empty if it has no letter."""
    lower, letter = _letters()
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letter[points]
    if not known.any():
        return np.zeros(0, np.uint64)
    points = np.concatenate([[32], np.where(known, lower[points], 32), [32]]).astype(np.uint64)
    blank = points == 32
    points = points[~(blank & np.concatenate([[False], blank[:-1]]))]
    blank = points == 32
    found = [points[~blank]]
    code = points
    for n in range(2, GRAM + 1):
        code = code[: len(points) - n + 1] | (points[n - 1 :] << np.uint64(BITS * (n - 1)))
        inner = np.zeros(len(code), bool)
        for k in range(1, n - 1):
            inner |= blank[k : k + len(code)]
        found.append(code[~inner])
    return np.concatenate(found)


def profile(codes: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, equal counts by code."""
    distinct, count = np.unique(codes, return_counts=True)
    return distinct[np.lexsort([distinct, -count])[:size]]


class Profiles:
    """Language profiles, ready to be compared with."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.names = sorted(ranked)
        self.grams = np.unique(np.array([g for row in ranked.values() for g in row], np.int64).view(np.uint64))
        self.places = np.full((len(self.grams) + 1, len(self.names)), size, np.int32)
        for k, name in enumerate(self.names):
            own = np.array(ranked[name], np.int64).view(np.uint64)
            self.places[np.searchsorted(self.grams, own), k] = np.arange(len(own))

    def closest(self, text: str | None) -> tuple[str, float]:
        """The language and 1 - distance / largest possible distance."""
        codes = grams(text)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = profile(codes, self.size)
        at = np.searchsorted(self.grams, own)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != own] = len(self.grams)
        places = self.places[at]
        out = np.where(places == self.size, self.size, np.abs(places - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(out.argmin())
        return self.names[best], float(1 - out[best] / (len(own) * self.size))


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(np.concatenate(codes), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], hold: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``lang, gram, n`` of a task's rows; what is held is handed on whenever it passes ``hold`` n-grams."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush() -> pa.RecordBatch:
        names = [name for name, (codes, _) in held.items() for _ in range(len(codes))]
        codes = np.concatenate([np.zeros(0, np.uint64), *(c for c, _ in held.values())])
        counts = np.concatenate([np.zeros(0, np.int64), *(n for _, n in held.values())])
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"]
        )

    for batch in batches:
        for part in slices(batch, 1, 1 << 20):
            by_name: dict[str, list[np.ndarray]] = {}
            for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                by_name.setdefault(name, []).append(grams(text))
            for name, found in by_name.items():
                codes, counts = np.unique(np.concatenate(found), return_counts=True)
                if name in held:
                    codes, counts = _merge([held[name][0], codes], [held[name][1], counts])
                held[name] = codes, counts
            if sum(len(codes) for codes, _ in held.values()) > hold:
                yield flush()
    yield flush()


def learn(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", size: int = PROFILE) -> Profiles:
    """Profiles of all languages named in the table; rows without a language are left out."""
    known = docs.select(F.col(f"`{lang_column}`").alias("lang"), F.col(f"`{text_column}`").alias("text"))
    counted = known.where("lang is not null and text is not null").mapInArrow(_count, "lang string, gram long, n long")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("place", place).where(F.col("place") <= size)
    ranked: dict[str, list[int]] = {}
    for row in sorted(top.collect(), key=lambda row: (row.lang, row.place)):  # languages x size rows
        ranked.setdefault(row.lang, []).append(row.gram)
    return Profiles(ranked, size)


def classify(docs: DataFrame, profiles: Profiles, keep: list[str], text_column: str = "text") -> DataFrame:
    """``row`` (struct of the columns to keep), ``lang_pred`` and ``score`` of every row."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_column}`").alias("text"))

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [profiles.closest(text) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([name for name, _ in found], pa.string()),
                        pa.array([score for _, score in found], pa.float64()),
                    ],
                    ["row", "lang_pred", "score"],
                )

    kinds = [rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(closest, T.StructType(kinds))


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a document is kept from learning: the CRC-32 of its id, as text, is 2 modulo 4."""
    return F.crc32(F.encode(F.col(f"`{id_column}`").cast("string"), "UTF-8")) % 4 == 2
