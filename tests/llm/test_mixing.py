import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.llm import mixing as M


def sizes(rows):
    out = Counter()
    for row in rows:
        out[row[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", row[1] or ""))
    return out


def test_targets_are_met_and_no_document_exceeds_three_times_its_size(docs, rows):
    found = M.taken(M.mix(docs, ["doc_id", "source"], undrawn=True)).collect()
    assert len(found) == len(rows)
    held, total = sizes(rows), sum(sizes(rows).values())
    names = sorted(held, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    # By definition: every target is the weight times one level, or three times the size where that is less.
    low, high = 0.0, 10.0 * total
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * held[s], level * weight[s]) for s in names) < total else (low, level)
    taken = Counter()
    for row in found:
        target = min(3 * held[row.row.source], level * weight[row.row.source])
        assert row.target == pytest.approx(target) and row.source_size == held[row.row.source]
        assert 0 <= row.taken <= 3 * row.size
        taken[row.row.source] += row.taken
    for name in names:
        assert abs(taken[name] - min(3 * held[name], level * weight[name])) <= 1


def test_reruns_and_other_partitions_agree(docs):
    once, again = (
        sorted(
            M.mix(d, ["doc_id", "text"]).select(F.hash("row"), "pass", "words", "shard", "turn").collect()
        )
        for d in (docs, docs.repartition(7))
    )
    assert once == again


def test_shards_are_disjoint_parts_of_exact_quotas():
    quotas = np.array([100, 7, 0, 1, 345])
    shards = list(M.tree(quotas, 13, 4, 0, 13))
    assert [s for s, _, _ in shards] == list(range(13))
    assert (sum(own for _, _, own in shards) == quotas).all()
    before = np.zeros(5, int)
    for _, at, own in shards:
        assert (at == before).all()
        before = before + own
    assert max(o.sum() for _, _, o in shards) - min(o.sum() for _, _, o in shards) <= 1
    parts = [list(M.tree(quotas, 13, 4, a, a + 1))[0] for a in range(13)]
    assert all((a[2] == b[2]).all() and a[0] == b[0] for a, b in zip(shards, parts))


def test_splits_follow_the_hypergeometric_mean():
    quotas = np.array([600, 300, 100])
    first = np.mean([next(M.tree(quotas, 2, seed, 0, 1))[2] for seed in range(400)], axis=0)
    assert np.allclose(first, [300, 150, 50], atol=2)


@pytest.mark.parametrize("blocks", [1, 2, 7, 64, 1000])
def test_block_order_is_a_permutation(blocks):
    for source in range(5):
        factor, shift = M.permutation(blocks, 9, source)
        assert len({(factor * k + shift) % blocks for k in range(blocks)}) == blocks


def test_every_block_is_drawn_by_one_shard(spark):
    found = M._shards(spark, [50, 3, 0, 211], per_shard=16, seed=1).collect()
    assert Counter((r.source_no, r.block) for r in found) == Counter(
        (s, b) for s, n in enumerate([50, 3, 0, 211]) for b in range(n)
    )
    assert {r.shard for r in found} == set(range(17))


def test_draws_lie_end_to_end_on_the_line_of_their_source(docs):
    mixed = M.mix(docs, ["doc_id"], block_words=50, blocks_per_shard=4)
    by_source = defaultdict(list)
    for r in mixed.collect():
        by_source[r.source_no].append((r["pass"] * r.source_size + r.start, r.words, r.size))
        assert r.shard is not None and 0 < r.words <= r.size
    for own in by_source.values():
        own.sort()
        assert [place for place, _, _ in own] == [sum(w for _, w, _ in own[:k]) for k in range(len(own))]
        assert all(words == size for _, words, size in own[:-1])
    assert mixed.select("shard").distinct().count() > 10


def test_every_draw_has_a_place_in_its_shard(docs, rows):
    mixed = M.mix(docs, ["doc_id", "text"], block_words=50, blocks_per_shard=4, undrawn=True)
    turns = {}
    for r in mixed.where("shard is not null").collect():
        turns.setdefault((r.row, r.shard), []).append(r.turn)
    found, shards = M.taken(mixed).collect(), defaultdict(dict)
    assert len(found) == len(rows)
    for row in found:
        assert len(row.shard) == len(row.place) and bool(row.shard) == (row.taken > 0)
        for shard, place in zip(row.shard, row.place):
            assert place not in shards[shard]
            shards[shard][place] = row.row
    assert len(shards) > 10 and sum(map(len, shards.values())) == sum(map(len, turns.values()))
    for shard, own in shards.items():
        assert sorted(own) == list(range(len(own)))
        order = [min(turns[own[k], shard]) for k in range(len(own)) if len(turns[own[k], shard]) == 1]
        assert order == sorted(order)


def test_sharing_with_limits():
    assert M.share([], [], 3) == []
    assert M.share([0, 0], [5, 2], 3) == [0.0, 0.0]
    assert M.share([10, 100], [5, 2], 3) == [30.0, 80.0]
    assert M.share([10, 10], [1, 1], 3) == [10.0, 10.0]
    assert M.share([1, 2, 1000], [5, 5, 1], 3) == [3.0, 6.0, 994.0]


def test_first_words(spark):
    text = spark.createDataFrame([("  a b\n\nc  d ", 3)], "t string, n long")
    assert text.select(M.first_words("t", "n")).first()[0] == "a b c"


def test_empty_table(no_docs):
    assert M.taken(M.mix(no_docs, ["doc_id"], undrawn=True)).count() == 0
    assert M.mix(no_docs, no_docs.columns).count() == 0
