import random
import zlib
from hashlib import sha256

import pytest

from tillwise.llm import prefix_trie as T
from tillwise.llm.queries import op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, place int, weight string, bytes int, leaf string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talk():
    rng = random.Random(9)
    words = ["hi", "hi", "hi", "yes", "no", "ü" * 30, "", None, "a:b", "bye"]
    roles = ["user", "assistant", None, "a"]
    rows = []
    for conv in list(range(60)) + list(range(90, 130)) + [10**12 + 4, 10**12 + 5]:
        turns = rng.randint(1, 9)
        if conv % 11 == 3:
            continue
        for turn in range(turns):
            common = turn < 3 or conv % 3 == 0
            rows.append((conv, turn - 2, roles[turn % 2] if common else rng.choice(roles), words[turn % 2] if common else rng.choice(words)))
    rows += [(41, None, "user", "first"), (55, 0, "user", "hi"), (55, 0, "user", "hi"), (None, 1, "user", "x"), (None, None, None, None)]
    rows += [(200, turn, "user", str(turn % 2)) for turn in range(700)]  # a long one
    rows += [(200 + k, turn, "user", "same") for k in range(1, 300) for turn in range(2)]  # a hot sequence
    return [(*row, 1, "k", 2, "w", 3, "l") for row in rows]


def rebuilt(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [row[2:] for row in sorted(turns)] for conv, turns in own.items()}
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        out[conv] = tuple(own.get(conv - conv % 5, [])[:h] + turns[h:])
    return out


def expected(rows):
    members, ends = {}, {}
    for conv, turns in rebuilt(rows).items():
        ends.setdefault(turns, []).append(conv)
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(conv)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += node not in children
    return sorted(
        (
            min(convs), len(node), min(members[node[:-1]]) if node else -1, len(convs), len(children.get(node, [])), leaves[node],
            saved[node], sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        )
        for node, convs in members.items()
    )


def found(frame):
    return sorted(tuple(-1 if c is None else c for c in row) for row in T.trie(frame).select(*COLUMNS).collect())


@pytest.mark.parametrize("run, piece, part", [(4096, 500, 200_000), (7, 3, 150)])
def test_matches_brute_force(spark, monkeypatch, run, piece, part):
    for name, value in (("RUN", run), ("PIECE", piece), ("PART", part)):
        monkeypatch.setattr(T, name, value)
    rows = talk()
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == expected(rows)


def test_only_turnless_conversations(spark):
    conv = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(conv, 0, "user", "gone", *[None] * 6)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows) == [
        (conv, 0, -1, 1, 0, 1, 0, sha256(str(conv).encode()).hexdigest())
    ]


def test_empty_table(spark):
    assert T.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_has_the_columns_of_the_contract(spark):
    assert op12_prefix_trie(spark, "/root/testdata/sf0.001").columns == COLUMNS
