import math
import re

import pytest

from tillwise.llm import license_scan as L

PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
FILL = "the of work and is to in under"


def expected(text, templates=L.TEMPLATES, threshold=L.THRESHOLD):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(k, label) for k in range(len(words)) for p, label in PHRASES.items() if tuple(words[k : k + len(p)]) == p]
    labels, best = {label for _, label in places}, 0.0
    for label, template in templates.items():
        own, width = set(L.tokens(template)), len(re.findall(L.LETTER + "+", template))
        width += math.ceil(width / 4)
        shared = max(len(own & set(words[k : k + width])) for k in range(max(1, len(words))))
        if shared >= math.ceil(threshold * len(own) - 1e-9):
            labels.add(label)
            best = max(best, shared / len(own))
    starts = [k for k, _ in places]
    base = ",".join(sorted({label for _, label in places}))
    first, last = min(starts, default=None), max(starts, default=None)
    return len(words), len(places), first, last, base, ",".join(sorted(labels)), 1.0 if places else best


@pytest.fixture(scope="module")
def texts():
    t = L.TEMPLATES
    filler = [f"w{k} {FILL.split()[k % 8]}" for k in range(400)]
    out = [None, "", "   ", "CC BY", "cc-by cc by, ccby CC\nBY 4.0", "xcc by", "cc byé", "all. RIGHTS/reserved", "General  Public\tLicense"]
    out += [f"{a} general public license {b} all rights reserved" for a, b in (("x y", "z"), ("", "cc by"))]
    out += list(t.values()) + [" ".join(filler) + " " + v + " " + " ".join(filler) for v in t.values()]
    for v in t.values():  # with every fifth or every fourth word lost, and in another order
        words = v.split()
        out += [" ".join(w for k, w in enumerate(words) if k % n) for n in (3, 4, 5, 6, 9)] + [" ".join(sorted(words))]
    out += [t["mit"][:60] + "\n" * 3 + t["mit"][60:], t["bsd"].upper(), t["mit-short"] + " KK İ", FILL * 300]
    out += [" ".join(filler[k : k + 11] + [t["mpl-2.0"]] + filler[:50]) for k in range(0, 30, 3)]
    return out


def check(frame, texts, **how):
    found = L.scan(frame, ["doc_id"], **how).collect()
    assert len(found) == frame.count()
    for row in found:
        got = tuple(row[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))
        assert got == pytest.approx(expected(texts[row.row.doc_id], **how), nan_ok=True), texts[row.row.doc_id]


def as_rows(spark, texts):
    rows = [(k, t, "r", 1, "l", 2.0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:12], "doc_id long, text string, hash string, chars int, label string, score double")


def test_matches_brute_force(spark, texts):
    check(as_rows(spark, texts).repartition(3), texts)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_other_thresholds(spark, texts, threshold):
    check(as_rows(spark, texts), texts, threshold=threshold)


def test_documents_with_every_odd_case(docs, rows):
    texts = {row[0]: row[1] for row in rows}
    texts[None] = rows[-2][1]
    found = {row.row.doc_id for row in L.scan(docs, ["doc_id"]).collect()}
    assert found == set(texts)
    check(docs.where("doc_id is not null"), texts)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Released under the Apache License", ""),
        ("This work is licensed under the Mozilla Public License", ""),
        ("Released under the MIT License.", "mit-short"),
        ("under " + "the license " * 30 + "MIT", ""),  # the tokens stand far apart
        ("see the GNU General Public License", "gpl,gpl-work"),
        (L.TEMPLATES["mit"] + " ... " + "w " * 500 + L.TEMPLATES["mit-body"], "mit,mit-body"),
        ("w " * 77 + L.TEMPLATES["bsd-body"], "bsd-body"),
    ],
)
def test_names_of_licenses(spark, text, labels):
    assert L.scan(as_rows(spark, [text] * 12), ["doc_id"]).first().labels == labels


def test_pattern_of_a_vocabulary():
    pattern = re.compile(L._whole(L._any_of(["a", "an", "any", "and", "2", "v"])))
    assert pattern.findall("a An any ant andy and, 2 22 v") == ["a", "An", "any", "and", "2", "v"]
    assert L._any_of([""]) == ""


def test_a_template_needs_tokens(docs):
    with pytest.raises(ValueError, match="no tokens"):
        L.scan(docs, ["doc_id"], templates={"empty": "!!"})


def test_empty_table(no_docs):
    assert L.scan(no_docs, ["doc_id"]).count() == 0


def test_phrases_that_share_words(spark):
    phrases = {"a b": "ab", "b c": "bc", "c": "c"}
    assert L._overlap(list(phrases)) and L._overlap(["a b c", "b"]) and not L._overlap(list(L.PHRASES)) and not L._overlap(["a b a"])
    row = L.scan(as_rows(spark, ["A b, c"] * 12), ["doc_id"], phrases=phrases).first()
    assert (row.n_base, row.first_word, row.base_labels) == (3, 0, "ab,bc,c")
