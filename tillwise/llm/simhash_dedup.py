"""SimHash near-duplicates with bit-sliced comparison.

Method
    1. A document's fingerprint is the bitwise majority of the 64-bit hashes of its word shingles.
    2. Equal fingerprints are grouped first, so copies never meet each other again.
    3. Two fingerprints at ``radius`` bits agree in at least ``parts - radius`` of ``parts`` pieces. Every fingerprint
       is therefore placed in one bucket for each choice of ``parts - radius`` pieces; no link can be missed. More
       pieces mean longer bucket keys: the number grows with the table so that chance buckets stay small.
    4. Inside a bucket fingerprints are compared bit-sliced: bit planes are stored vertically, one word holds the same
       bit of 64 fingerprints, and carry-save counters add up the differing bits of 64 pairs at once. Words whose
       lanes have all passed the radius are abandoned. Buckets above ``tile`` rows are cut into tiles, so no
       task gets an unbounded group.
    5. Each task returns a spanning forest of the links it found; components of all links follow from that.

A fingerprint has a bounded number of neighbours within the radius, and only links of distinct fingerprints are
emitted, so what is shuffled is proportional to the distinct fingerprints.

Defined results: a null text or one without words has fingerprint zero and is linked like any other; a text with fewer
words than a shingle is hashed as one shingle; repeated rows have equal fingerprints; a null ``doc_id`` is linked, but
is the smallest reachable id only if no other is reachable; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tillwise.llm.common import byte_rows, parts_for, slices
from tillwise.llm.components import components
from tillwise.sources.staging import stage

BITS = 64
SEED = 42


def text_fingerprint(text: bytes | None, shingle: int) -> int:
    """Majority of the shingle hashes of a UTF-8 text, as an unsigned number."""
    words = (text or b"").lower().split()  # bytes: only A-Z are lowered, only ASCII white space separates
    if not words:
        return 0
    grams = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(gram), SEED) for gram in grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        part = hashes[begin : begin + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp`` of every row; ``fp`` holds the 64 bits as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                fps = np.array([text_fingerprint(t, shingle) for t in byte_rows(part.column(2))], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"]
                )

    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.xxhash64(f"`{text_column}`").alias("text_hash"),
        F.col(f"`{text_column}`").alias("text"),
    )
    return rows.mapInArrow(hashed, "doc_id long, text_hash long, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 to a word (padded with zeros)."""
    padded = np.zeros(-(-len(fps) // 64) * 64, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _lanes(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words with the bits ``begin`` (included) to ``end`` (excluded) set; both are clipped to 0..64."""
    low, high = np.clip(begin, 0, 64), np.clip(end, 0, 64)
    below = lambda n: np.where(n == 64, ~np.uint64(0), (np.uint64(1) << (n % 64).astype(np.uint64)) - np.uint64(1))
    return below(high) & ~below(low)


def bit_sliced_links(fps: np.ndarray, ends: np.ndarray, radius: int, step: int = 4096) -> np.ndarray:
    """Pairs of rows ``(i, j)``, ``i < j < ends[i]``, whose fingerprints differ in at most ``radius`` bits.

    The rows of a bucket stand together; ``ends[i]`` is the first row after the bucket of row i.
    """
    fps = fps.astype("<u8")
    planes, found = _planes(fps), []
    counters = max(1, int(radius + 1).bit_length())
    bias = (1 << counters) - 1 - radius  # a counter runs over exactly when it passes the radius
    rows = np.arange(len(fps))
    rows = rows[rows + 1 < ends]
    for begin in range(0, len(rows), step):
        query = rows[begin : begin + step]
        words, last = (query + 1) // 64, (ends[query] - 1) // 64
        while len(query):
            lanes = _lanes(query + 1 - words * 64, ends[query] - words * 64)
            live, at, own = query, words, fps[query]
            count = [np.full(len(live), ~np.uint64(0) if bias >> k & 1 else 0, np.uint64) for k in range(counters)]
            over = ~lanes
            for bit in range(BITS):
                carry = planes[bit, at] ^ (np.uint64(0) - (own >> np.uint64(bit) & np.uint64(1)))
                for k in range(counters):
                    count[k], carry = count[k] ^ carry, count[k] & carry
                over |= carry
                if bit % 8 == 7:
                    some = over != ~np.uint64(0)  # abandon words in which no lane is left
                    if not some.all():
                        live, at, own, over = live[some], at[some], own[some], over[some]
                        count = [c[some] for c in count]
                    if not len(live):
                        break
            if len(live):
                hits = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, lane = np.nonzero(hits)
                found.append(np.stack([live[row], at[row] * 64 + lane], axis=1))
            more = words < last
            query, words, last = query[more], words[more] + 1, last[more]
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _spanning(pairs: np.ndarray, size: int) -> np.ndarray:
    """A spanning forest of the pairs: the links that join two groups not joined before."""
    above = list(range(size))

    def top(node: int) -> int:
        while above[node] != node:
            above[node] = above[above[node]]
            node = above[node]
        return node

    kept = []
    for a, b in pairs.tolist():
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
            kept.append((a, b))
    return np.array(kept, np.int64).reshape(-1, 2)


def _pieces(parts: int) -> list[int]:
    """Masks of ``parts`` nearly equal pieces of the 64 bits."""
    cuts = [BITS * k // parts for k in range(parts + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def _signed(number: int) -> int:
    return number - (1 << BITS) if number >> (BITS - 1) else number


def near_links(fps: DataFrame, radius: int = 2, tile: int = 4096, per_task: int = 200_000) -> DataFrame:
    """Links ``(u, v)`` that connect all distinct fingerprints ``fp`` within the radius, directly or through others."""
    n = fps.count()
    parts = radius + 1
    while parts < BITS and (parts - radius) * BITS // parts < n.bit_length() + 3:
        parts += 1
    pieces = _pieces(parts)
    keys = [
        F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(sum(chosen)))).alias("bits"))
        for k, chosen in enumerate(combinations(pieces, parts - radius))
    ]
    placed = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.choice", "key.bits")
    sizes = placed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1")
    rows = stage(placed.join(sizes, ["choice", "bits"]), "buckets")
    # A bucket of m tiles holds every row m times: tile pair (a, b) compares the rows of block a with those of block b.
    blocks = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("m")).cast("int")
    tiles = rows.withColumn("m", blocks).withColumn("block", own).select(
        "fp",
        "choice",
        "bits",
        F.explode(
            F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least("block", o).alias("a"), F.greatest("block", o).alias("b")))
        ).alias("t"),
    )
    tasks = parts_for(rows.count(), per_task, 8)
    task = F.pmod(F.xxhash64("choice", "bits", "t"), F.lit(tasks)).cast("int")

    def compare(group: pa.Table) -> pa.Table:
        frame = [group.column(name).to_numpy() for name in ("choice", "bits", "a", "b", "fp")]
        order = np.lexsort(frame[::-1])
        choice, bits, a, b, fp = (column[order] for column in frame)
        new = np.ones(len(fp), bool)
        new[1:] = (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts = np.append(np.flatnonzero(new), len(fp))
        ends = np.repeat(starts[1:], np.diff(starts))
        pairs = bit_sliced_links(fp.view(np.uint64), ends, radius)
        nodes, place = np.unique(fp, return_inverse=True)
        links = nodes[_spanning(place[pairs], len(nodes))]
        return pa.table({"u": links[:, 0], "v": links[:, 1]})

    return (
        tiles.select("choice", "bits", "t.a", "t.b", "fp", task.alias("task"))
        .groupBy("task")
        .applyInArrow(compare, "u long, v long")
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, text_hash, fp, component_id, kept_hash``: one row per document.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` differing bits; ``kept_hash`` is the
    ``text_hash`` of the row with that id, so that (component_id, kept_hash) names the row that stands for the group.
    """
    marked = stage(fingerprints(docs, shingle, id_column, text_column), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    distinct = stage(marked.groupBy("fp").agg(first.alias("first")), "distinct-fingerprints")
    roots = stage(components(near_links(distinct.select("fp"), radius)), "roots")
    member = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = member.groupBy("root").agg(F.min("first").alias("lead"))
    group = member.join(smallest, "root").select("fp", "lead")
    return marked.join(group, "fp").select(
        "doc_id",
        "text_hash",
        "fp",
        F.col("lead.doc_id").alias("component_id"),
        F.col("lead.text_hash").alias("kept_hash"),
    )


def deduplicate(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The documents without near copies: of each group the row with the smallest id stays, once."""
    groups = near_duplicates(docs, shingle, radius)
    stay = groups.select(F.col("component_id").alias("id"), F.col("kept_hash").alias("hash")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("h"))
    match = (rows["h"] == stay["hash"]) & rows["doc_id"].eqNullSafe(stay["id"])
    return rows.join(stay, match, "left_semi").dropDuplicates(["doc_id", "h"]).select("row.*")
