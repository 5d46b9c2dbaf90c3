import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.llm import ball_tree as B

SCHEMA = "vec_id long, embedding array<float>, label int, v string, dim string, shard int, block int, score string, n int"


def vectors(dim=9):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, dim)).astype(np.float32)
    base[100:220] = base[50]  # a third of all rows are equal
    base[230:240] = -base[50]
    rows = [(k, base[k].tolist()) for k in range(300)]
    odd = [None, [float("nan")] * dim, [float("-inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1e30] * dim]
    rows += [(1000 + 10 * k, v) for k, v in enumerate(odd)]
    rows += [(2000, [0.0] * dim), (None, base[0].tolist()), rows[50], rows[0]]
    rows += [(3000, []), (3010, []), (4000, [1.5, 2.0]), (4010, [-2.0, 1e-9]), (4020, [9e5, -9e5]), (4030, [9e5, 9e5])]
    return [(*row, 1, "v", "d", 2, 3, "s", 4) for row in rows]


def expected(rows, every, k):
    known = {}
    for number, v, *_ in rows:
        if number is not None and v is not None and None not in v and all(map(math.isfinite, v)):
            whole = [math.floor(1024 * float(np.float32(x))) for x in v]
            if sum(x * x for x in whole) < 2**62:
                known[number] = whole
    out = set()
    for q, a in known.items():
        if q % every == 0:
            scores = [(-sum(map(int.__mul__, a, b)), n) for n, b in known.items() if n != q and len(a) == len(b)]
            out |= {(q, rank, n, -score) for rank, (score, n) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("cells", [1 << 19, 500])
def test_matches_brute_force(spark, cells):
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = B.top_products(frame, F.col("vec_id") % 10 == 0, 7, shard_cells=cells)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    got = [tuple(row) for row in found.collect()]
    assert len(got) == len(set(got)) and set(got) == expected(rows, 10, 7)


@pytest.mark.parametrize("size", [1, 2, 64, 65, 1000])
def test_balls_hold_their_points(size):
    rng = np.random.default_rng(size)
    codes = rng.integers(-900, 900, (size, 5))
    codes[: size // 3] = codes[0]
    tree = B.Tree.grow(rng.permutation(size), codes)
    balls = tree.balls
    for node in range(len(balls["left"])):
        part = slice(balls["begin"][node], balls["end"][node])
        gaps = np.sqrt(((tree.values[part] - balls["center"][node]) ** 2).sum(axis=1))
        assert (gaps <= balls["radius"][node]).all() and balls["least"][node] == tree.ids[part].min()
    leaves = sorted((b, e) for b, e, left in zip(balls["begin"], balls["end"], balls["left"]) if left < 0)
    assert [b for b, _ in leaves] == [0] + [e for _, e in leaves[:-1]] and leaves[-1][1] == size
    queries = rng.integers(-900, 900, (4, 5))
    upper = tree.bounds(queries.astype(float))
    for node in range(len(balls["left"])):
        products = queries @ tree.codes[balls["begin"][node] : balls["end"][node]].T
        assert (products.max(axis=1) <= upper[:, node]).all()


def test_search_opens_few_leaves():
    rng = np.random.default_rng(1)
    centers = rng.integers(-4000, 4000, (40, 16))
    codes = np.repeat(centers, 200, axis=0) + rng.integers(-40, 40, (8000, 16))
    tree, opened = B.Tree.grow(np.arange(8000), codes), []
    plain = tree.products
    tree.products = lambda *a: opened.append(1) or plain(*a)
    queries = codes[::400]
    found = list(tree.search(np.arange(0, 8000, 400), queries, [None] * 20, 5))
    assert len(found) == 100 and len(opened) < 20 * 125 / 10  # a tenth of all leaves
    floor = {}
    for q, n, score in found:
        floor[q] = min(floor.get(q, (math.inf, 0)), (score, -n))
    shared = [(floor[q][0], -floor[q][1]) for q in range(0, 8000, 400)]
    assert len(list(tree.search(np.arange(0, 8000, 400), queries, shared, 5))) == 80  # all but the k-th itself


def test_empty_table(spark):
    assert B.top_products(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
