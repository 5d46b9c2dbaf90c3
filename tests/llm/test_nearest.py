import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, label int, v string, dim string, q int, c int"


def vectors(dim=9):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, dim)).astype(np.float32)
    base[40:70] = base[50]  # ties
    base[80:90] = base[50] * np.float32(2)
    rows = [(k, base[k].tolist()) for k in range(120)]
    odd = [None, [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), []]
    rows += [(1000 + k, v) for k, v in enumerate(odd)] + [(None, base[0].tolist()), rows[50], rows[0]]
    rows += [(2000, [1.0, 2.0]), (2001, [2.0, 1.0]), (2050, [1e38, 1e38]), (2100, [1e-40, 0.0])]
    return [(*row, 1, "v", "d", 2, 3) for row in rows]


def expected(rows, every, k):
    known = {}
    for number, v, *_ in rows:
        if number is not None and v and None not in v and np.isfinite(v).all() and any(v):
            known[number] = np.array(v, np.float64)
    out = {}
    for q, a in known.items():
        if q % every:
            continue
        scores = []
        for number, b in known.items():
            if number != q and len(a) == len(b):
                scale = np.abs(a).max(), np.abs(b).max()
                x, y = a / scale[0], b / scale[1]
                scores.append((-round(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), 12), number))
        out[q] = [(number, -score) for score, number in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("tiles", [(2048, 8192), (2, 17)])
def test_matches_brute_force(spark, tiles):
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = N.nearest(frame, F.col("vec_id") % 10 == 0, 5, tile_queries=tiles[0], tile_rows=tiles[1]).collect()
    assert len(found) == len({(r.query_id, r.rank) for r in found})
    got = {}
    for row in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(row.query_id, []).append((row.vec_id, round(row.score, 12)))
    want = {q: near for q, near in expected(rows, 10, 5).items() if near}
    assert {q: [n for n, _ in near] for q, near in got.items()} == {q: [n for n, _ in near] for q, near in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-11 for q in got for a, b in zip(got[q], want[q]))


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(30, 2100)), rng.normal(size=(500, 2100)) ** 3
    own, other = N.Codes(a), N.Codes(b)
    about, off = own.bounds(other, slice(0, 500))
    true = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1))
    assert own.codes.dtype == np.int8 and (np.abs(true - about) <= off).all()
    # A code is off by half a step per component at most; of such errors no direction holds more than their root mean square.
    half = np.sqrt(2100) / 2 * (own.scale[:, None] * (1 + other.error) + other.scale) + 1e-8
    assert (off <= half).all() and off.mean() < 0.05


def test_more_blocks_than_one_keep_the_best():
    rng = np.random.default_rng(2)
    q, c = rng.normal(size=(7, 16)), np.round(rng.normal(size=(3 * N.BLOCK + 5, 16)), 1)
    ids = rng.permutation(len(c))
    scores = (q @ c.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1))
    for heap, own in zip(N.tile(np.arange(-7, 0), q, ids, c, 4), scores):
        assert sorted(-n for _, n in heap) == sorted(ids[np.lexsort([ids, -own])[:4]].tolist())


def test_empty_table(spark):
    assert N.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
