"""Substring deduplication by relative Lempel-Ziv parsing against an index of all reference blocks.

Every window of ``window`` words that also starts earlier (in an earlier document, or in the same one at an earlier
start) is found and the words it covers are cut out. Documents stand in the order of ``doc_id``, then ``version``.

Method
    Blocks      Of the word grams in a window, the smallest hash is the window's anchor. Consecutive windows with one
                anchor form a block. Equal windows have equal anchors, wherever they stand, so texts are cut at the
                same places and a repeated passage is parsed into the same blocks.
    Index       Blocks are indexed by the hash of their whole content. A block whose content also stands earlier is a
                factor piece: all its windows are repeats. Neighbouring pieces make up a long factor, greedily, as every
                block is matched at its full length.
    Boundaries  At the ends of a factor blocks agree only in part. Blocks that share their anchor with a block of other
                content (and blocks that repeat inside themselves) are checked window by window, on both sides.
    Versions    Rows that share an id differ in the hash of their text. Rows without an id, which nothing else tells apart,
                are numbered in the order of their text and columns; for that they alone are written and sorted.
    Cut         A document's factors and single windows are laid over its words; covered words go.

Scale
    About one block per eight words is shuffled, as five numbers. Inside a slice of documents copies are settled before
    the shuffle, and an anchor with several contents is dealt out by content, with one marker row per slice under
    the anchor itself. A passage that stands in a third of all documents thus adds one row per slice to its group,
    never one per document. Texts are shuffled twice, compressed. Nothing is broadcast or collected.

Defined results: null and empty texts have no words and stay as they are; texts shorter than a window keep all words;
rows that share a ``doc_id`` and the text are one document, so neither repeats the other; those that share only the id
are documents of their own, in the order of their text's hash; so is every row with a null id, which sorts before all
others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tillwise.llm.common import NULL_ID, byte_rows, slices
from tillwise.operators.numbering import number_rows
from tillwise.sources.staging import stage

GRAM = 6
SLICE_BYTES = 8 << 20
LENGTH_BITS = 24  # a place holds a word position and, in the low bits, a number of windows
LONGEST = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
PLAIN, FORCED, MARKER, REPEAT = 0, 1, 2, 3


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit number over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHashes:
    """Hashes of all words of some texts, and of every span of them in constant time."""

    def __init__(self, texts: list[bytes | None]):
        split = [(text or b"").split() for text in texts]  # bytes: ASCII white space only
        self.counts = np.array([len(words) for words in split], np.int64)
        self.ends = np.cumsum(self.counts)
        self.begins = self.ends - self.counts
        self.n = int(self.counts.sum())
        self.words = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split)), np.uint64, self.n)
        self._sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(self.words * _powers(BASE, self.n), out=self._sums[1:])
        self._undo = _powers(pow(BASE, -1, 1 << 64), self.n + 1)

    def span(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        body = (self._sums[end] - self._sums[begin]) * self._undo[begin]
        return _mix(body + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _blocks(texts: WordHashes, window: int) -> dict[str, np.ndarray]:
    """Blocks of some texts: document number, first word, number of windows, anchor, content and self-repeats."""
    n = texts.n - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return {"doc": empty, "start": empty, "length": empty, "anchor": empty, "content": empty, "loops": empty > 0}
    gram = min(GRAM, window)
    at = np.arange(texts.n - gram + 1)
    grams = texts.span(at, at + gram)
    anchor, place = grams[:n].copy(), np.arange(n)
    for k in range(1, window - gram + 1):
        other = grams[k : k + n]
        less = other < anchor
        np.copyto(anchor, other, where=less)
        np.copyto(place, np.arange(k, k + n), where=less)
    doc = np.repeat(np.arange(len(texts.counts)), texts.counts)
    whole = np.flatnonzero(np.arange(n) + window <= texts.ends[doc[:n]])
    if not len(whole):
        whole = np.zeros(0, np.int64)
    new = np.ones(len(whole), bool)
    new[1:] = (
        (whole[1:] != whole[:-1] + 1)
        | (anchor[whole[1:]] != anchor[whole[:-1]])
        | ((whole[1:] - texts.begins[doc[whole[1:]]]) % LONGEST == 0)
    )
    first = np.flatnonzero(new)
    last = whole[np.append(first[1:], len(whole)) - 1] if len(first) else whole[:0]
    first = whole[first]
    return {
        "doc": doc[first],
        "start": first,
        "length": last - first + 1,
        "anchor": anchor[first],
        "content": texts.span(first, last + window),
        "loops": place[first] != place[last],
    }


def _repeats(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, document and start; which rows (in that order) lead a group, and which repeat an earlier one."""
    order = np.lexsort([start, doc, *keys[::-1]])
    lead = np.ones(len(order), bool)
    lead[1:] = False
    for key in keys:
        lead[1:] |= key[order][1:] != key[order][:-1]
    group = np.cumsum(lead) - 1
    heads = order[lead]
    later = (doc[order] != doc[heads][group]) | (start[order] != start[heads][group])
    return order, lead, later


def _pack(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << LENGTH_BITS) | length.astype(np.int64)


def _rows(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    key, content, doc, version, at, tag = (np.concatenate(column) for column in zip(*parts))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key.view(np.int64)),
            pa.array(content.view(np.int64), mask=tag == MARKER),
            pa.array(doc),
            pa.array(version),
            pa.array(at),
            pa.array(tag.astype(np.int32)),
        ],
        ["key", "content", "doc", "version", "at", "tag"],
    )


def _ranks(ids: np.ndarray, versions: np.ndarray) -> np.ndarray:
    """Places of the rows in the order of documents; rows of one document share theirs."""
    order = np.lexsort([versions, ids])
    new = np.zeros(len(order), np.int64)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (versions[order][1:] != versions[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _spread(doc: np.ndarray, version: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys that deal out rows which need no group."""
    return _mix(at.view(np.uint64) ^ _mix(version.view(np.uint64) ^ doc.view(np.uint64)))


def _block_rows(ids: np.ndarray, versions: np.ndarray, texts: list[bytes | None], window: int) -> pa.RecordBatch:
    """The blocks of a slice of documents as rows to be grouped; see the module text."""
    hashes = WordHashes(texts)
    blocks = _blocks(hashes, window)
    doc, version = ids[blocks["doc"]], versions[blocks["doc"]]
    start = blocks["start"] - hashes.begins[blocks["doc"]]
    at = _pack(start, blocks["length"])
    rank = _ranks(ids, versions)[blocks["doc"]]
    order, lead, later = _repeats([blocks["anchor"], blocks["content"]], rank, start)
    anchors, group = np.unique(blocks["anchor"][order[lead]], return_inverse=True)
    several = np.bincount(group, minlength=len(anchors)) > 1
    np.logical_or.at(several, group, blocks["loops"][order[lead]])
    forced = several[group]
    heads = order[lead]
    gone = order[later]
    marked = anchors[several]
    zeros = lambda n: np.zeros(n, np.int64)
    content = blocks["content"]
    return _rows(
        [
            (
                np.where(forced, content[heads], blocks["anchor"][heads]),
                content[heads],
                doc[heads],
                version[heads],
                at[heads],
                np.where(forced, FORCED, PLAIN),
            ),
            (marked, marked, *[zeros(len(marked))] * 3, np.full(len(marked), MARKER)),
            (
                _spread(doc[gone], version[gone], at[gone]),
                content[gone],
                doc[gone],
                version[gone],
                at[gone],
                np.full(len(gone), REPEAT),
            ),
        ]
    )


def _window_rows(
    ids: np.ndarray, versions: np.ndarray, texts: list[bytes | None], places: list[np.ndarray], window: int
) -> pa.RecordBatch:
    """The single windows at the given places, as rows to be grouped by content."""
    hashes = WordHashes(texts)
    length = [p & ((1 << LENGTH_BITS) - 1) for p in places]
    start = [np.repeat(p >> LENGTH_BITS, n) + _within(n) for p, n in zip(places, length)]
    start = [np.unique(s[(s >= 0) & (s + window <= n)]) for s, n in zip(start, hashes.counts)]
    number = np.repeat(np.arange(len(start)), [len(s) for s in start])
    start = np.concatenate([*start, np.zeros(0, np.int64)]).astype(np.int64)
    doc, version, first = ids[number], versions[number], start + hashes.begins[number]
    content = hashes.span(first, first + window)
    order, lead, later = _repeats([content], _ranks(ids, versions)[number], start)
    heads, gone = order[lead], order[later]
    # Repeats that follow each other are given as one place.
    gone = gone[np.lexsort([start[gone], number[gone]])]
    new = np.ones(len(gone), bool)
    new[1:] = (number[gone][1:] != number[gone][:-1]) | (start[gone][1:] != start[gone][:-1] + 1)
    begin = np.flatnonzero(new)
    runs = np.diff(np.append(begin, len(gone)))
    at = _pack(start[gone[begin]], runs)
    gone = gone[begin]
    return _rows(
        [
            (
                content[heads],
                content[heads],
                doc[heads],
                version[heads],
                _pack(start[heads], np.ones(len(heads))),
                np.full(len(heads), FORCED),
            ),
            (
                _spread(doc[gone], version[gone], at),
                content[gone],
                doc[gone],
                version[gone],
                at,
                np.full(len(gone), REPEAT),
            ),
        ]
    )


def _within(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for every n, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _cut(text: bytes, covered: np.ndarray) -> bytes:
    """The text without the covered words; white space before and after a cut stays."""
    space = np.isin(np.frombuffer(text, np.uint8), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    edge = np.diff(np.concatenate([[1], space.astype(np.int8), [1]]))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    turn = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    out, last = [], 0
    for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)):
        out.append(text[last : begin[a]])
        last = end[b - 1]
    return b"".join([*out, text[last:]])


ROWS = "key long, content long, doc long, version long, at long, tag int"
DOC = ["doc", "version"]


def _judge(rows: DataFrame) -> DataFrame:
    """Rows as ``(doc, version, at, repeat)``: repeats, and the first of each content where windows have to be checked."""
    same = Window.partitionBy("key", "content").orderBy(*DOC, "at")
    group = Window.partitionBy("key")
    place = F.struct(*DOC, "at")
    judged = rows.select(
        *DOC,
        "at",
        "tag",
        ((F.col("tag") == REPEAT) | (place > F.first(place).over(same))).alias("repeat"),
        (
            F.max(F.col("tag").isin(FORCED, MARKER)).over(group)
            | (F.min("content").over(group) < F.max("content").over(group))
        ).alias("check"),
    )
    return judged.where((F.col("tag") != MARKER) & (F.col("repeat") | F.col("check"))).select(*DOC, "at", "repeat")


def _keyed(docs: DataFrame, text_column: str) -> DataFrame:
    """``row`` (all other columns), ``doc`` and ``version`` (the key of the document) and ``text``."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_column]).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), others, F.col(f"`{text_column}`").alias("text"))
    named = rows.where("doc is not null").select("row", "doc", F.xxhash64("text").alias("version"), "text")
    bare = rows.where("doc is null").select(F.xxhash64("text").alias("h"), F.xxhash64("row").alias("other"), "row", "text")
    numbered = number_rows(bare, ["h", "other"], "version")
    return named.unionByName(numbered.select("row", F.lit(NULL_ID).alias("doc"), "version", "text"))


def _packed(keyed: DataFrame) -> DataFrame:
    """The documents with ``z`` (the text, compressed for the shuffle) in place of the text."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = [None if text is None else packer.compress(text) for text in byte_rows(batch.column(len(others)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(z, pa.binary())], [*others, "z"])

    others = [c for c in keyed.columns if c != "text"]
    rows = keyed.select(*others, "text")
    kinds = T.StructType([*[rows.schema[c] for c in others], T.StructField("z", T.BinaryType())])
    return rows.mapInArrow(compress, kinds)


def _unpacked(column: pa.Array) -> list[bytes | None]:
    reader = zstandard.ZstdDecompressor()
    return [None if z is None else reader.decompress(z) for z in column.to_pylist()]


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.array(row.as_py() or [], np.int64) for row in column]


def _ids(part: pa.RecordBatch) -> list[np.ndarray]:
    return [part.column(k).to_numpy(zero_copy_only=False) for k in range(len(DOC))]


def repeats(keyed: DataFrame, window: int = 20) -> DataFrame:
    """``(doc, version, at)``: where windows repeat earlier ones; ``at`` holds the first word and the number of windows."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                yield _block_rows(*_ids(part), byte_rows(part.column(2)), window)

    texts = keyed.select(*DOC, "text")
    blocks = stage(_judge(texts.mapInArrow(parse, ROWS)), "blocks")
    # Equal rows of one document give equal places, which are kept once.
    boundary = blocks.where("not repeat").groupBy(*DOC).agg(F.collect_set("at").alias("places"))
    joined = _packed(texts).join(boundary, DOC).select(*DOC, "z", "places")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES // 3):
                yield _window_rows(*_ids(part), _unpacked(part.column(2)), _lists(part.column(3)), window)

    windows = _judge(joined.mapInArrow(check, ROWS)).where("repeat")
    return blocks.where("repeat").select(*DOC, "at").unionByName(windows.select(*DOC, "at"))


def remove_repeats(docs: DataFrame, window: int = 20, text_column: str = "text") -> DataFrame:
    """``row`` (struct of all other columns), ``text`` without repeats, ``n_words`` before, ``n_removed`` of them."""
    keyed = _keyed(docs, text_column)
    spans = repeats(keyed, window).groupBy(*DOC).agg(F.collect_set("at").alias("places"))
    joined = _packed(keyed).join(spans, DOC, "left").select("row", "z", "places")
    kinds = T.StructType(
        [joined.schema["row"], T.StructField("text", T.StringType())]
        + [T.StructField(name, T.LongType()) for name in ("n_words", "n_removed")]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES // 3):
                texts, total, removed = _unpacked(part.column(1)), [], []
                for k, places in enumerate(_lists(part.column(2))):
                    words = len((texts[k] or b"").split())
                    change = np.zeros(words + 1, np.int64)
                    begin = np.minimum(places >> LENGTH_BITS, words)
                    end = np.minimum(begin + (places & ((1 << LENGTH_BITS) - 1)) + window - 1, words)
                    np.add.at(change, begin, 1)
                    np.add.at(change, end, -1)
                    covered = np.cumsum(change)[:words] > 0
                    total.append(words)
                    removed.append(int(covered.sum()))
                    if removed[-1]:
                        texts[k] = _cut(texts[k], covered)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pc.cast(pa.array(texts, pa.binary()), pa.string()),
                        pa.array(total, pa.int64()),
                        pa.array(removed, pa.int64()),
                    ],
                    ["row", "text", "n_words", "n_removed"],
                )

    return joined.mapInArrow(cut, kinds)
