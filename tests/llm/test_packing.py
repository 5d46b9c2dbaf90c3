import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tillwise.llm import packing as P
from tillwise.llm.queries import vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary()[0])


def check(pieces, documents, window):
    """Every id in one piece, sequences gapless and padded at most where they must be; ``documents``: list of id lists."""
    sequences, found = defaultdict(list), Counter()
    by_document = defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length and p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        by_document[p.row.doc_id].append(p)
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end == window or (end < window and end & (end - 1) == 0)
    for doc, own in by_document.items():
        joined = Counter()
        for p in own:
            joined[p.start, p.doc_tokens, p.ids] += 1
        for ids in documents[doc]:
            body = np.array(ids, "<u4").tobytes()
            assert all(body[4 * s : 4 * s + len(b)] == b for s, n, b in joined if n == len(ids)) or len(documents[doc]) > 1
        assert sum(p.length for p in own) == sum(map(len, documents[doc]))
    assert set(by_document) == set(documents)
    return sequences


def ids_of(tokenizer, rows):
    out = defaultdict(list)
    for row in rows:
        out[row[0]].append(tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [0])
    return out


@pytest.mark.parametrize("window", [1024, 64])
def test_all_ids_are_packed_without_padding(docs, rows, tokenizer, window):
    pieces = P.pack(docs, ["doc_id"], *vocabulary(), window=window).collect()
    documents = ids_of(tokenizer, rows)
    sequences = check(pieces, documents, window)
    total = sum(len(ids) for own in documents.values() for ids in own)
    assert len(sequences) == total // window + bin(total % window).count("1")
    once = [doc for doc, own in documents.items() if len(own) == 1]
    for doc in once:
        own = sorted((p.start, p.ids) for p in pieces if p.row.doc_id == doc)
        assert b"".join(b for _, b in own) == np.array(documents[doc][0], "<u4").tobytes()
        assert [s for s, _ in own] == [sum(len(b) // 4 for _, b in own[:k]) for k in range(len(own))]


def test_empty_table(no_docs):
    assert P.pack(no_docs, ["doc_id"], *vocabulary()).count() == 0


def test_faster_library_gives_the_same_ids(tokenizer):
    texts = [None, "", "Don't  stop\t\tnow\r\n\n  x", "naïve Çà ñandú ½ ² ª", "日本語 text", "a b c\u0085d", "<|endoftext|> x"]
    texts += ["it's we'LL 'S 12345 67.8, !!?? --- $$$", " " * 50 + "end ", "\x00\x1f control", "é" * 300, "<| not special |>"]
    for text, ids in zip(texts, P.token_ids(texts, *vocabulary())):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert P.token_ids([text], vocabulary()[0])[0].tolist() == ids.tolist()


def test_least_squares_solution_is_optimal():
    rng = np.random.default_rng(0)
    histogram = np.zeros(33)
    histogram[1:32] = rng.integers(0, 50, 31)
    combos = P.combinations(np.flatnonzero(histogram), 32)
    assert all(c.sum() == 32 for c in combos) and len({tuple(c) for c in combos}) == len(combos)
    x = P.repeat_counts(combos, histogram, 20_000)
    used = np.zeros((33, len(combos)))
    for j, combo in enumerate(combos):
        for length in combo[combo > 0]:
            used[length, j] += 1
    slope = used.T @ (used @ x - histogram)
    assert x.min() >= 0 and slope.min() > -1e-3 and abs(slope * x).max() < 1e-2


@pytest.mark.parametrize("lengths", [[700] * 50, [1, 63, 63, 1], [32] * 7, [5, 9, 50, 14] * 11 + [3], [63] * 3, []])
def test_plan_fills_windows(lengths):
    window = 64 if max(lengths, default=0) < 64 else 1024
    plan = P.Plan(np.bincount(lengths, minlength=window + 1) if lengths else np.zeros(window + 1), window)
    seen, taken = Counter(), defaultdict(list)
    for length in lengths:
        pieces = plan.places(length, seen[length])
        assert sum(p[1] for p in pieces) == length
        for _, size, sequence, offset in pieces:
            taken[sequence].append((offset, size))
        seen[length] += 1
    assert sorted(taken) == list(range(len(taken))) and len(taken) == plan.sequences + plan.residual_sequences
    for places in taken.values():
        assert sorted(o for o, _ in places) == [sum(s for o2, s in places if o2 < o) for o, _ in sorted(places)]
        end = sum(size for _, size in places)
        assert end == window or end & (end - 1) == 0
