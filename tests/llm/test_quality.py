import re
from collections import Counter

from tillwise.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
        len(lines),
        (text or "").count("!"),
    )


def test_counts_match_brute_force(spark, docs, rows):
    odd = ["a b a b a", "a a a a", "a a a", "x y z\nx y z\n\n  \nx y z ", "\x1c ü b\u0085c", " #*$ %&| <> ", "a\x0bb\x0cc"]
    more = spark.createDataFrame([(k, text) for k, text in enumerate(odd, 9000)], "doc_id long, text string")
    frame = docs.select("doc_id", "text").unionByName(more)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims"]
    found = Q.measures(frame, ["doc_id", "text"]).collect()
    assert len(found) == len(rows) + len(odd)
    for row in found:
        assert tuple(row[name] for name in names) == expected(row.row.text), row.row.text[:80]


def test_verdicts(docs, rows):
    judged = Q.judge(docs, ["doc_id", "text"]).collect()
    assert len(judged) == len(rows)
    for row in judged:
        n, _, _, _, repeated, *_ = expected(row.row.text)
        assert row.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert row.kept == (not row.base_failed and row.quality >= 0.5)
    clean = [r for r in judged if r.n_words > 100 and not r.n_repeat_words and not r.n_dup_lines]
    assert clean and all(r.kept for r in clean)


def test_votes(spark):
    frame = spark.createDataFrame([(1, 10), (15, 100), (30, 100), (0, 0), (100, 100)], "a long, b long")
    votes = [r[0] for r in frame.select(Q.vote("a / b", (0.0, 0.1), (0.0, 0.2))).collect()]
    assert votes == [Q.GOOD, Q.ABSTAIN, Q.BAD, Q.ABSTAIN, Q.BAD]


def test_model_separates_two_kinds_of_documents():
    import random

    rng = random.Random(1)
    patterns, truth = Counter(), {}
    for _ in range(20_000):
        good = rng.random() < 0.85
        votes = tuple(
            0 if rng.random() < 0.1 else 1 if rng.random() < (0.999 if good else 0.35) else -1 for _ in range(6)
        )
        patterns[votes] += 1
        truth.setdefault(votes, Counter())[good] += 1
    model = Q.LabelModel(sorted(patterns.items()), 6)
    assert abs(model.share - 0.85) < 0.02
    assert all(abs(b - 0.35) < 0.06 for b in model.bad) and all(g > 0.99 for g in model.good)
    right = sum(n[model.posterior(v) >= 0.5] for v, n in truth.items())
    assert right / 20_000 > 0.97
    assert Q.LabelModel([], 3).posterior((0, 0, 0)) == 0.5


def test_a_rule_that_misfires_is_outvoted():
    import random

    rng, patterns = random.Random(3), Counter()
    for _ in range(20_000):
        good = rng.random() < 0.9
        right = [0.96, *[0.999] * 5] if good else [0.5] * 6
        patterns[tuple(1 if rng.random() < p else -1 for p in right)] += 1
    model = Q.LabelModel(sorted(patterns.items()), 6)
    assert abs(model.good[0] - 0.96) < 0.01 and all(g > 0.99 for g in model.good[1:])
    assert model.posterior((-1, 1, 1, 1, 1, 1)) >= 0.5  # one bad vote, by the rule that is often wrong
    assert model.posterior((-1, -1, 1, -1, 1, 1)) < 0.5


def test_likelihood_does_not_fall_with_more_rounds():
    import math

    patterns = [((1, 1, 1), 500), ((1, -1, 1), 20), ((-1, -1, 1), 30), ((-1, -1, -1), 25), ((0, 1, -1), 9), ((1, 0, 0), 40)]

    def likelihood(model):
        total = 0
        for votes, n in patterns:
            p = [model.share, 1 - model.share]
            for k, v in enumerate(votes):
                if v:
                    p[0] *= model.good[k] if v == 1 else 1 - model.good[k]
                    p[1] *= model.bad[k] if v == 1 else 1 - model.bad[k]
            total += n * math.log(sum(p))
        return total

    values = [likelihood(Q.LabelModel(patterns, 3, rounds)) for rounds in (2, 5, 20, 100)]
    assert all(b > a - 0.5 for a, b in zip(values, values[1:]))  # the half votes added move it a little


def test_empty_table(no_docs):
    assert Q.judge(no_docs, ["doc_id"]).count() == 0
