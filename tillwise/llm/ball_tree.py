"""Exact top-k inner products by branch and bound over a ball tree per shard.

Method
    Vectors become whole numbers, ``floor(scale * x)``, and are dealt into shards. Each shard is one ball tree: a node
    halves its points along the line through two far points and keeps their centre, radius and smallest id. The inner
    product of a query ``q`` with any point of a node is at most ``q . centre + |q| * radius``. A search takes the node of the
    largest bound first, opens it or, at a leaf, multiplies its points exactly, and ends when no bound reaches the k-th
    score found. That k-th score is shared: shards are searched in rounds of 1, 3, 9 ... shards, and a round begins with
    the k-th score of all rounds before it. Equal scores go to the smaller id, so a node whose bound equals the k-th
    score is opened only if it holds a smaller id.

Scale
    ``build`` is one shuffle; a shard has about ``shard_cells`` vector components, whatever the table. The trees are
    written once, one row per shard, and read by every round. A search task holds one shard and one block of queries, and
    returns only what beats the shared k-th score, at most k rows a query. Many equal vectors end in a ball of radius 0,
    of which a query multiplies its k + 1 smallest ids only.

Exactness
    Products of whole numbers are exact in double precision while ``|a| * |b| < 2**53``; beyond that they are
    made in 64-bit integers. Bounds are rounded upwards.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id, nor
vectors whose whole numbers have a squared length of 2**62 or more (their scores need not fit a long); of rows with one id the smallest vector
counts; only vectors of equal length are compared (empty ones have the score 0); a query's own id is no candidate; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillwise.llm.common import parts_for
from tillwise.sources.staging import stage

LEAF = 64  # points
GROWTH = 3  # a round searches so many times the shards of the one before
EXACT = 2.0**53
TREE = "shard int, dim int, ids array<long>, codes array<long>, balls struct<center: array<double>, radius: array<double>, " \
    "least: array<long>, left: array<int>, begin: array<int>, end: array<int>>"  # fmt: skip
FOUND = "query_id long, vec_id long, score long"


def whole_numbers(
    vectors: DataFrame, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``vec_id, v``: one row per id, with the components as whole numbers; see the defined results."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    length = F.aggregate("v", F.lit(0.0), lambda total, x: total + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))
    rows = vectors.select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v")
    )
    fits = F.when(F.coalesce(finite, F.lit(False)), length < 2.0**62).otherwise(False)
    return (
        rows.where(F.col("vec_id").isNotNull() & fits)
        .select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )


# --- the tree of one shard --------------------------------------------------------


class Tree:
    """Points in leaf order, and balls; the children of an inner node are ``left`` and ``left + 1``, a leaf has ``left`` -1."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, balls: dict[str, np.ndarray]):
        self.ids, self.codes, self.balls = ids, codes, balls
        self.values = codes.astype(np.float64)
        self.norm = float(np.sqrt((self.values**2).sum(axis=1).max(initial=0.0)))

    @classmethod
    def grow(cls, ids: np.ndarray, codes: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.argsort(ids)
        ids, codes = ids[order], codes[order]
        values = codes.astype(np.float64)
        places = np.arange(len(ids))
        center, radius, least, left, begin, end = [], [], [], [], [], []

        def ball(first: int, last: int) -> None:
            points = values[places[first:last]]
            middle = points.mean(axis=0)
            gaps = np.sqrt(((points - middle) ** 2).sum(axis=1))
            # Rounded upwards; equal points have the point itself as their centre.
            same = (points == points[0]).all()
            center.append(points[0] if same else middle)
            radius.append(0.0 if same else float(gaps.max()) * (1 + 1e-9) + 1e-9)
            least.append(int(ids[places[first:last]].min()))
            left.append(-1)
            begin.append(first)
            end.append(last)

        if len(ids):
            ball(0, len(ids))
        node = 0
        while node < len(left):  # breadth first, so no recursion on odd data
            first, last = begin[node], end[node]
            if last - first > leaf and radius[node] > 0:
                part = places[first:last]
                points = values[part]
                a = points[np.argmax(((points - center[node]) ** 2).sum(axis=1))]
                b = points[np.argmax(((points - a) ** 2).sum(axis=1))]
                along = points @ (b - a)
                side = np.argsort(along, kind="stable")  # equal points stay in the order of their ids
                places[first:last] = part[side]
                ranked = along[side]
                half = len(part) // 2
                # Do not part equal points unless they are the whole node.
                low, high = np.searchsorted(ranked, ranked[half]), np.searchsorted(ranked, ranked[half], "right")
                half = int(low if low and (half - low <= high - half or high == len(part)) else high)
                if 0 < half < len(part):
                    left[node] = len(left)
                    ball(first, first + half)
                    ball(first + half, last)
            node += 1
        for node, first in enumerate(begin):  # ids ascend within a leaf
            if left[node] < 0:
                places[first : end[node]] = np.sort(places[first : end[node]])
        shape = (len(center), codes.shape[1])
        balls = {
            "center": np.array(center, np.float64).reshape(shape),
            "radius": np.array(radius, np.float64),
            "least": np.array(least, np.int64),
            "left": np.array(left, np.int32),
            "begin": np.array(begin, np.int32),
            "end": np.array(end, np.int32),
        }
        return cls(ids[places], codes[places], balls)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner products of each query with the points of each ball."""
        center, radius = self.balls["center"], self.balls["radius"]
        norm = np.sqrt((queries**2).sum(axis=1))
        size = np.sqrt((center**2).sum(axis=1)) + radius
        rounding = norm[:, None] * (size * 1e-12 * (queries.shape[1] + 8)) + 1e-6
        return queries @ center.T + norm[:, None] * radius + rounding

    def products(self, query: np.ndarray, exact: bool, first: int, last: int) -> np.ndarray:
        if exact:
            return (self.values[first:last] @ query.astype(np.float64)).astype(np.int64)
        return self.codes[first:last] @ query

    def search(
        self, query_ids: np.ndarray, queries: np.ndarray, shared: list[tuple[int, int] | None], k: int
    ) -> Iterator[tuple[int, int, int]]:
        """``(query_id, vec_id, score)`` of all points of this tree that can be among the k best.

        ``shared`` is, for each query, the k-th best ``(score, vec_id)`` of other shards, or None while they gave fewer than k.
        """
        if not len(self.ids):
            return
        values = queries.astype(np.float64)
        bounds = self.bounds(values)
        exact = np.sqrt((values**2).sum(axis=1)) * self.norm < EXACT
        left, begin, end = (self.balls[name].tolist() for name in ("left", "begin", "end"))
        least, flat = self.balls["least"].tolist(), (self.balls["radius"] == 0).tolist()
        for row, own in enumerate(query_ids.tolist()):
            # Best points so far as (score, -id), the worst first; the shared one stands for k points elsewhere.
            best: list[tuple[int, int]] = []
            floor = None if shared[row] is None else (shared[row][0], -shared[row][1])
            upper = bounds[row].tolist()
            open_nodes = [(-upper[0], 0)]
            while open_nodes:
                bound, node = heappop(open_nodes)
                if floor is not None:
                    if -bound < floor[0]:
                        break
                    if -bound < floor[0] + 1 and -least[node] < floor[1]:
                        continue  # whole scores: at most equal, and no smaller id
                if left[node] >= 0:
                    for child in (left[node], left[node] + 1):
                        if floor is None or upper[child] >= floor[0]:
                            heappush(open_nodes, (-upper[child], child))
                    continue
                last = min(end[node], begin[node] + k + 1) if flat[node] else end[node]
                scores = self.products(queries[row], bool(exact[row]), begin[node], last)
                ids = self.ids[begin[node] : last]
                if len(ids) > k + 1:  # the k best of the leaf, its own id aside; ids ascend, so ties go to the smaller
                    top = np.argsort(-scores, kind="stable")[: k + 1]
                    scores, ids = scores[top], ids[top]
                for score, number in zip(scores.tolist(), ids.tolist()):
                    if number != own and (floor is None or (score, -number) > floor):
                        if len(best) == k:
                            heappop(best)
                        heappush(best, (score, -number))
                        if len(best) == k and (floor is None or best[0] > floor):
                            floor = best[0]
            for score, negative in best:
                yield own, -negative, score


def _matrix(lists: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), dim)


def _as_list(array: np.ndarray) -> pa.ListArray:
    """All numbers of an array as one list."""
    return pa.ListArray.from_arrays(pa.array([0, array.size], pa.int32()), pa.array(array.reshape(-1)))


# --- on Spark ---------------------------------------------------------------------


def build(numbers: DataFrame, shard_cells: int = 1 << 19) -> tuple[DataFrame, int]:
    """Ball trees as a written table, one row per shard and length of vectors, and the number of shards."""
    cells = numbers.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    shards = parts_for(cells, shard_cells)

    def grow(key: tuple, points: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        tree = Tree.grow(points.column("vec_id").to_numpy(), _matrix(points.column("v"), dim))
        flat = {name: _as_list(array) for name, array in tree.balls.items()}
        balls = pa.StructArray.from_arrays(list(flat.values()), list(flat))
        shard, length = (pa.array([value.as_py()], pa.int32()) for value in key)
        columns = [shard, length, _as_list(tree.ids), _as_list(tree.codes), balls]
        return pa.table(columns, ["shard", "dim", "ids", "codes", "balls"])

    dealt = numbers.select(
        F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), "vec_id", "v"
    )
    return stage(dealt.groupBy("shard", "dim").applyInArrow(grow, TREE), "ball-trees"), shards


def search(trees: DataFrame, shards: int, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """``query_id, vec_id, score``: the k best points of the trees for every row ``vec_id, v`` of the queries."""

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int]] = []
        if left.num_rows:
            dim = left.column("dim")[0].as_py()
            asked, ids = _matrix(left.column("v"), dim), left.column("vec_id").to_numpy()
            scores, numbers = left.column("score").to_pylist(), left.column("last").to_pylist()
            shared = [None if score is None else (score, number) for score, number in zip(scores, numbers)]
            for row in range(right.num_rows):
                balls = {f.name: a for f, a in zip(right.schema.field("balls").type, right.column("balls").combine_chunks()[row : row + 1].flatten())}
                balls = {name: array.flatten().to_numpy(zero_copy_only=False) for name, array in balls.items()}
                balls["center"] = balls["center"].reshape(-1, dim) if dim else np.zeros((len(balls["radius"]), 0))
                points = right.column("ids")[row].values.to_numpy()
                codes = right.column("codes")[row].values.to_numpy().reshape(len(points), dim)
                rows += Tree(points, codes, balls).search(ids, asked, shared, k)
        columns = zip(*rows) if rows else ([], [], [])
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    spark = trees.sparkSession
    blocks = parts_for(queries.count(), block)
    asked = queries.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit(12)), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = spark.createDataFrame([], FOUND)
    first, many = 0, 1
    while first < shards:
        last = min(shards, first + many)
        kth = best.withColumn("n", F.row_number().over(order)).where(F.col("n") == k)
        kth = kth.select(F.col("query_id").alias("vec_id"), "score", F.col("vec_id").alias("last"))
        shared = asked.join(kth, "vec_id", "left") if first else asked.withColumns({"score": F.lit(None).cast("long"), "last": F.lit(None).cast("long")})
        turn = F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("shard")
        sent = shared.select("dim", "block", turn, "vec_id", "v", "score", "last")
        held = trees.where(F.col("shard").between(first, last - 1))
        held = held.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", "ids", "codes", "balls")
        found = sent.groupBy("dim", "block", "shard").cogroup(held.groupBy("dim", "block", "shard")).applyInArrow(look, FOUND)
        ranked = best.unionByName(found).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
        best = stage(ranked, "best-products")
        first, many = last, many * GROWTH
    return best


def top_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    shard_cells: int = 1 << 19,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products for every query row; ``is_query`` reads ``vec_id``."""
    numbers = stage(whole_numbers(vectors, scale, id_column, vector_column), "whole-numbers")
    trees, shards = build(numbers, shard_cells)
    best = search(trees, shards, numbers.where(is_query), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
