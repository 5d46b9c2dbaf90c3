import numpy as np
import xxhash
from pyspark.sql import functions as F

from tillwise.llm import simhash_dedup as S
from tillwise.llm.components import components


def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(gram, 42) for gram in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def reach(fps, radius):
    """Group number of each fingerprint, by comparing all pairs."""
    group = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    return group


def test_fingerprints_and_groups_match_brute_force(docs, rows):
    found = S.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    by_text = {row[1]: fingerprint(row[1]) for row in rows}
    group = dict(zip(by_text, reach(list(by_text.values()), 2)))
    smallest = {}
    for row in rows:
        smallest[group[row[1]]] = min(smallest.get(group[row[1]], 10**9), 10**9 if row[0] is None else row[0])
    expected = sorted((str(r[0]), by_text[r[1]], smallest[group[r[1]]]) for r in rows)
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in found) == expected


def test_one_document_of_each_group_stays(docs, rows):
    kept = S.deduplicate(docs)
    assert kept.columns == docs.columns
    groups = {row.component_id for row in S.near_duplicates(docs).collect()}
    ids = [row.doc_id for row in kept.collect()]
    assert sorted(ids) == sorted(groups)


def test_empty_table(no_docs):
    assert S.near_duplicates(no_docs).count() == 0
    assert S.deduplicate(no_docs).count() == 0


def test_bit_sliced_links_find_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    for radius in (0, 1, 2, 3, 6):
        base = rng.integers(0, 2**64, 40, np.uint64)
        flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False))) for _ in range(160)]
        fps = np.concatenate([base, rng.choice(base, 160) ^ np.array(flips, np.uint64)])
        sizes = [1, 3, 120, 2, 74]
        ends = np.repeat(np.cumsum(sizes), sizes)
        found = {tuple(pair) for pair in S.bit_sliced_links(fps, ends, radius, step=37).tolist()}
        assert found == {
            (i, j) for i in range(200) for j in range(i + 1, ends[i]) if bin(int(fps[i] ^ fps[j])).count("1") <= radius
        }


def test_large_buckets_are_tiled_without_losing_links(spark):
    # All fingerprints agree in most pieces, so they share buckets; neighbours differ by one bit.
    fps = [sum(1 << b for b in range(k)) for k in range(20)] + [(1 << 63) | k * 0x0101 for k in range(30)]
    frame = spark.createDataFrame([((f ^ (1 << 63)) - (1 << 63),) for f in fps], "fp long").distinct()
    links = S.near_links(frame, radius=2, tile=4, per_task=10)
    root = {r.node: r.root for r in components(links).collect()}
    for f, g in zip(fps, reach(fps, 2)):
        signed, lead = ((x ^ (1 << 63)) - (1 << 63) for x in (f, fps[g]))
        assert root.get(signed, signed) == root.get(lead, lead)


def test_components_of_chains_stars_and_loops(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(300, 360)] + [(k, 7) for k in range(300, 310)]
    found = components(spark.createDataFrame(chain + star + [(5, 5), (-3, 100)], "u long, v long"))
    roots = {row.node: row.root for row in found.collect()}
    assert found.count() == len(roots)
    assert {roots[k] for k in range(100, 161)} == {-3} and {roots[k] for k in range(300, 360)} == {7}
    assert 5 not in roots


def test_repeated_rows_have_equal_results(docs):
    same = S.near_duplicates(docs).where("doc_id = 3").select("fp", "component_id")
    assert same.count() == 3 and same.agg(F.count_distinct("fp", "component_id")).first()[0] == 1
