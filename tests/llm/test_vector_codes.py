import math
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from tillwise.llm import vector_codes as C

SCHEMA = "vec_id long, embedding array<float>, label int, v string, far string, part int, code string, error string, salt int"


def vectors(n=500, dim=16):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(30, dim))
    base = (centers[rng.integers(0, 30, n)] + rng.normal(size=(n, dim)) / 8).astype(np.float32)
    base[n // 4 : n // 2] = base[7]  # many equal rows
    base[:3] = base[0]  # equal first entries: ties go to the lower one, the others stay unused
    rows = [(3 * k, base[k].tolist(), None if k % 7 == 0 else k % 5) for k in range(n)]
    odd = [None, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] * dim, [], [1.0, 2.0], [1.0] * 8, [3e30] * dim]
    rows += [(-1 - k, v, 1) for k, v in enumerate(odd)]
    rows += [(None, base[9].tolist(), 2), rows[5], rows[5], (15, base[80].tolist(), None), (7, [0.0] * dim, None)]
    return [(*row, "v", "f", 1, "c", "e", 2) for row in rows]


def expected(rows, entries, rounds, parts=4, dim=16):
    known = []
    for number, v, label, *_ in rows:
        if v is not None and len(v) == dim and None not in v and all(map(math.isfinite, v)) and max(v) < 1e20:
            known.append((math.inf if number is None else number, [math.floor(1024 * float(np.float32(x))) for x in v], label))
    known.sort(key=lambda row: row[:2])
    width = dim // parts
    cut = lambda v: [tuple(v[k : k + width]) for k in range(0, dim, width)]
    books = [[cut(v)[k] for _, v, _ in known[:entries]] for k in range(parts)]

    def nearest(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), k) for k, entry in enumerate(book))

    for _ in range(rounds):
        groups = [{} for _ in range(parts)]
        for _, v, _ in known:
            for k, part in enumerate(cut(v)):
                groups[k].setdefault(nearest(books[k], part)[1], []).append(part)
        for k in range(parts):
            for entry, members in groups[k].items():
                books[k][entry] = tuple(sum(column) // len(members) for column in zip(*members))
    found = []
    for number, v, label in known:
        best = [nearest(books[k], part) for k, part in enumerate(cut(v))]
        found.append((None if number == math.inf else number, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    sums = Counter()
    for _, label, _, error in found:
        sums[label] += error
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return Counter((n, code, error, sums[label]) for n, label, code, error in found), sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("entries, labels", [(256, 20_000), (20, 2)])
def test_matches_brute_force(spark, entries, labels):
    rows = vectors()
    coded, books = C.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=entries)
    found = C.with_label_error(coded, labels, 3).select("vec_id", "code", "error", "label_error").collect()
    want, text = expected(rows, entries, 4)
    assert Counter(tuple(row) for row in found) == want
    assert C.digest(books) == text


def test_fewer_rows_than_entries(spark):
    rows = vectors()[:9]
    coded, books = C.compress(spark.createDataFrame(rows, SCHEMA))
    want, text = expected(rows, 256, 4)
    assert [len(book) for book in books.books] == [9] * 4 and C.digest(books) == text
    assert Counter(tuple(r) for r in C.with_label_error(coded).select("vec_id", "code", "error", "label_error").collect()) == want


@pytest.mark.parametrize("spread", [1, 50, 2**23])
def test_assignment_is_exact_and_pruned(spread):
    rng = np.random.default_rng(spread)
    book = rng.integers(-20, 20, (256, 6)) * spread
    book[200:] = book[:56]  # equal entries
    points = np.concatenate([book[rng.integers(0, 256, 300)] + rng.integers(-2, 3, (300, 6)), rng.integers(-20, 20, (300, 6)) * spread])
    pivots = C.choose_pivots(book)
    tried = []
    index, best = C.assign(points, C.distances(points, pivots), book, C.distances(book, pivots), tried)
    every = np.stack([C.squares(points, entry[None, :]) for entry in book], axis=1)
    assert (best == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()
    assert sum(tried) < len(points) * 256 / 3


def test_equal_entries_only():
    book = np.zeros((5, 3), np.int64)
    pivots = C.choose_pivots(book)
    index, best = C.assign(book + 2, C.distances(book + 2, pivots), book, C.distances(book, pivots))
    assert len(pivots) == 1 and index.tolist() == [0] * 5 and best.tolist() == [12] * 5


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1, *"vf", 1, "c", "e", 2)]):
        coded, books = C.compress(spark.createDataFrame(rows, SCHEMA))
        assert C.with_label_error(coded).count() == 0 and books.text() == ""
