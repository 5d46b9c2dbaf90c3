"""Nearest neighbours by a block matrix join with int8 product tiles.

Method
    Queries and candidates are dealt into groups; every pair of groups is one tile. In a tile all vectors are scaled to
    length 1 and quantised to int8 with one scale each. Products of the codes, times both scales, differ from the cosine by
    at most a bound that follows from the quantisation errors of the two vectors. A pair survives if its upper bound
    reaches the k-th largest lower bound of its query so far. Survivors are computed again in double precision on the
    original vectors and kept in one heap of k per query; the heaps of all tiles are merged per query. The result is
    exact: no pair that could belong to it is dropped.

Scale
    Tiles are of a fixed size, so a task's memory does not depend on the table. A vector is sent to as many tiles as there
    are groups on the other side, which is the least a block join can send; the tile sizes set how many. A tile returns
    at most k rows per query. Codes are whole numbers up to 127, so single-precision products of ``EXACT`` dimensions
    are exact and run at full matrix speed.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows with a
null id; of rows with one id the smallest vector counts; only vectors of equal length are compared; a query's own id
is no candidate; equal scores go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

EXACT = 1024  # 1024 * 127 * 127 < 2**24
BLOCK = 1024


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, scaled by powers of two (which changes no cosine) against over- and underflow."""
    lists = column.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    exponent = np.frexp(np.abs(values).max(axis=1))[1]
    return np.ldexp(values, -exponent[:, None])


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products row by row, added up in the order of the components, so that equal vectors get equal products."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


class Codes:
    """int8 codes of vectors scaled to length 1, with the scale and the length of the quantisation error of each."""

    def __init__(self, matrix: np.ndarray):
        self.norm = np.sqrt(_dots(matrix, matrix))
        unit = matrix / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.error = np.linalg.norm(unit - self.codes * self.scale[:, None], axis=1) + 1e-9

    def bounds(self, other: Codes, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of all own vectors with some of the other's, from codes, and how far off each may be."""
        product = np.zeros((len(self.codes), len(other.codes[rows])))
        for k in range(0, self.codes.shape[1], EXACT):
            a = self.codes[:, k : k + EXACT].astype(np.float32)
            product += a @ other.codes[rows, k : k + EXACT].astype(np.float32).T
        product *= self.scale[:, None]
        product *= other.scale[rows][None, :]
        off = other.error[rows]
        return product, off[None, :] + self.error[:, None] * (1 + off[None, :])


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[list[tuple]]:
    """For each query a heap of its k best ``(score, -id)``."""
    own, other = Codes(queries), Codes(vectors)
    heaps: list[list[tuple]] = [[] for _ in query_ids]
    reached = np.full(len(query_ids), -np.inf)  # every query has k pairs with at least this score
    for begin in range(0, len(ids), BLOCK):
        rows = slice(begin, begin + BLOCK)
        about, off = own.bounds(other, rows)
        same = query_ids[:, None] == ids[rows][None, :]
        lower = np.where(same, -np.inf, about - off)
        if lower.shape[1] >= k:
            reached = np.maximum(reached, np.partition(lower, lower.shape[1] - k, axis=1)[:, -k])
        q, c = np.nonzero((about + off >= reached[:, None]) & ~same)
        for piece in range(0, len(q), 1 << 15):
            a, b = q[piece : piece + (1 << 15)], c[piece : piece + (1 << 15)] + begin
            scores = _dots(queries[a], vectors[b]) / (own.norm[a] * other.norm[b])
            for row, score, number in zip(a.tolist(), scores.tolist(), ids[b].tolist()):
                heap = heaps[row]
                if len(heap) < k:
                    heappush(heap, (score, -number))
                elif heap[0] < (score, -number):
                    heappushpop(heap, (score, -number))
        # A little below the k-th score, as another pair's bounds may be rounded.
        full = [heap[0][0] - 1e-9 if len(heap) == k else -np.inf for heap in heaps]
        reached = np.maximum(reached, full)
    return heaps


def usable(vector: str) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    tile_queries: int = 2048,
    tile_rows: int = 8192,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest cosine for every query row; ``is_query`` reads ``vec_id``."""
    rows = (
        vectors.select(
            F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v")
        )
        .where(F.col("vec_id").isNotNull() & usable("v"))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
        .withColumn("dim", F.size("v"))
    )
    total = rows.agg(F.count("*").alias("rows"), F.count_if(is_query).alias("queries")).first()
    groups = max(1, -(-total["rows"] // tile_rows))
    query_groups = max(1, -(-total["queries"] // tile_queries))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    asked = rows.where(is_query).select("dim", deal(query_groups, 1).alias("q"), spread(groups).alias("c"), "vec_id", "v")
    every = rows.select("dim", spread(query_groups).alias("q"), deal(groups, 2).alias("c"), "vec_id", "v")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ids = left.column("vec_id").to_numpy()
            heaps = tile(ids, _matrix(left.column("v")), right.column("vec_id").to_numpy(), _matrix(right.column("v")), k)
            found = [(number, -negative, score) for number, heap in zip(ids.tolist(), heaps) for score, negative in heap]
        columns = zip(*found) if found else ([], [], [])
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "vec_id", "score"])

    tiles = (
        asked.groupBy("dim", "q", "c")
        .cogroup(every.groupBy("dim", "q", "c"))
        .applyInArrow(compare, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = tiles.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
