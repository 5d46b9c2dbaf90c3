import random
import re

import pyarrow.parquet as pq
import pytest

import corpus_pipeline as C
from tests.llm.test_simhash import fingerprint, reach
from tillwise.llm import language_id, mixing
from tillwise.llm.queries import ORACLE, QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    """Every stage's result, each from the one before."""
    place, out, now = tmp_path_factory.mktemp("stages"), {"documents": docs}, docs
    for name, stage in C.STAGES:
        stage(spark, now, "").write.parquet(str(place / name))
        out[name] = now = spark.read.parquet(str(place / name))
    return out


def rows(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def key(row):
    return str(row)


def test_all_but_the_last_stage_keep_the_columns(stages, docs):
    for name, _ in C.STAGES[:-1]:
        assert stages[name].columns == docs.columns and stages[name].count() > 0
        assert stages[name].dtypes == docs.dtypes


def test_language_stage_drops_only_what_has_no_language(stages, docs):
    profiles = language_id.learn(docs.where(~language_id.held_out()))
    kept = [r for r in rows(docs) if (found := profiles.closest(r[1]))[0] != "und" and found[1] >= C.LEAST_SCORE]
    assert sorted(rows(stages["language_id"]), key=key) == sorted(kept, key=key)
    lost = {r[1] for r in rows(docs)} - {r[1] for r in kept}
    assert all(not text or len(text.split()) < 5 for text in lost)


def test_language_stage_keeps_short_texts_of_a_large_alphabet(spark):
    rng, letters = random.Random(2), [chr(0x4E00 + k) for k in range(4000)]
    weights = [1 / (k + 1) for k in range(4000)]
    texts = ["".join(rng.choices(letters, weights, k=60 + k % 100)) for k in range(400)]
    rows = [(k, text, "zh", "src0", len(text)) for k, text in enumerate(texts)] + [(400, "12 34 !!", None, "src0", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in C.language_stage(spark, frame, "").collect()) == list(range(400))


def test_simhash_stage_keeps_one_of_each_group(stages):
    before = rows(stages["language_id"])
    texts = sorted({text for _, text in before})
    group = dict(zip(texts, reach([fingerprint(text) for text in texts], 2)))
    lead = {}
    for doc, text in before:
        place = (doc is None, doc or 0)
        lead[group[text]] = min(lead.get(group[text], (place, doc)), (place, doc), key=lambda x: x[0])
    assert sorted(key(r[0]) for r in rows(stages["simhash_dedup"])) == sorted(key(doc) for _, doc in lead.values())


def test_substring_stage_cuts_repeats(stages):
    before, after = rows(stages["simhash_dedup"]), dict(rows(stages["substring_dedup"]))
    first = {}
    for doc, text in before:
        words = WORD.findall(text.encode())
        for k in range(len(words) - 19):
            place, window = (-1 if doc is None else doc, k), tuple(words[k : k + 20])
            first[window] = min(first.get(window, place), place)
    for doc, text in before:
        words, gone = WORD.findall(text.encode()), set()
        for k in range(len(words) - 19):
            if first[tuple(words[k : k + 20])] < (-1 if doc is None else doc, k):
                gone.update(range(k, k + 20))
        kept = [w for k, w in enumerate(words) if k not in gone]
        assert (WORD.findall(after[doc].encode()) == kept) if kept else doc not in after
    for row in stages["substring_dedup"].collect():
        assert row.n_chars == len(row.text) or row.text in {t for _, t in before}


def test_mixing_stage_repeats_and_cuts_documents(stages):
    before = stages["substring_dedup"]
    taken = {r.row.doc_id: r.taken for r in mixing.taken(mixing.mix(before, before.columns, undrawn=True)).collect()}
    words, texts = {}, dict(rows(before))
    for doc, text in rows(stages["mixing"]):
        own = WORD.findall(text.encode())
        words[doc] = words.get(doc, 0) + len(own)
        assert own == WORD.findall(texts[doc].encode())[: len(own)]
    assert words == {doc: n for doc, n in taken.items() if n}


def test_mixing_stage_is_written_shard_by_shard(spark, docs, tmp_path, monkeypatch):
    small = {"block_words": 50, "blocks_per_shard": 4}
    drawn = mixing.mix(docs, docs.columns, **small)
    shards = {}
    for r in drawn.orderBy("shard", "turn").collect():
        shards.setdefault(r.shard, []).append((r.row.doc_id, r.words))
    assert len(shards) > 10
    mix = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda docs, keep: mix(docs, keep, **small))
    C.mixing_stage(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    for file in (tmp_path / "mixed").glob("*.parquet"):
        own = [(r["doc_id"], len(WORD.findall(r["text"].encode()))) for r in pq.read_table(file).to_pylist()]
        while own:  # whole shards, one after the other
            shard = max((s for s in shards if shards[s] == own[: len(shards[s])]), key=lambda s: len(shards[s]))
            own = own[len(shards.pop(shard)) :]
    assert not shards


def test_packing_stage_packs_what_the_mix_holds(stages):
    pieces = stages["packing"].collect()
    assert {p.doc_id for p in pieces} == {doc for doc, _ in rows(stages["mixing"])}
    ends = {}
    for p in pieces:
        ends[p.sequence_id] = ends.get(p.sequence_id, 0) + p.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in ends.values())


def test_each_stage_takes_an_empty_table(spark, no_docs):
    for _, stage in C.STAGES:
        assert stage(spark, no_docs, "").count() == 0


def test_stages_and_queries_are_registered(spark):
    assert [name for name, _ in C.STAGES] == ["language_id", "simhash_dedup", "substring_dedup", "mixing", "packing"]
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLE) <= set(QUERIES)


def test_run_writes_and_rereads_every_stage(spark):
    assert C.run(spark, "/root/testdata/sf0.001").count() > 0
