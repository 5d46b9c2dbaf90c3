import hashlib

from tillwise.llm import substring_dedup as S


def expected(rows, window):
    """Kept words by definition; rows with one id count as versions of one document."""
    texts = [(-1 if row[0] is None else row[0], (row[1] or "").encode().split()) for row in rows]
    first = {}
    for doc, words in texts:
        for k in range(len(words) - window + 1):
            place, key = (doc, k), tuple(words[k : k + window])
            first[key] = min(first.get(key, place), place)
    gone = {}
    for doc, words in texts:
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < (doc, k):
                gone.setdefault(doc, set()).update(range(k, k + window))
    out = []
    for doc, words in texts:
        kept = [word for k, word in enumerate(words) if k not in gone.get(doc, ())]
        out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def result(frame):
    out = []
    for row in frame.collect():
        words = (row.text or "").encode().split()
        doc = -1 if row.row.doc_id is None else row.row.doc_id
        out.append((doc, row.n_words, row.n_removed, hashlib.sha256(b" ".join(words)).hexdigest()))
    return sorted(out)


def test_matches_the_definition(docs, rows):
    found = S.remove_repeats(docs)
    assert result(found) == expected(rows, 20)
    assert set(found.schema["row"].dataType.names) == set(docs.columns) - {"text"}


def test_rows_without_an_id_or_with_one_id_do_not_share_cuts(spark):
    texts = [" ".join(f"{name}{k}" for k in range(150)) for name in "abcde"]
    a, b, c, d, e = texts
    half = " ".join(c.split()[:75])
    rows = [(5, c), (None, a), (None, f"{half} {d}"), (7, e), (7, f"{half} {a}"), (7, e), (8, e)] + [(None, b)] * 4
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r.row.doc_id or -1, r.n_words, r.n_removed) for r in S.remove_repeats(frame).collect())
    bare = [(-1, 150, 0), (-1, 225, 0), (-1, 150, 0), *[(-1, 150, 150)] * 3]
    assert found == sorted(bare + [(5, 150, 75), (7, 150, 0), (7, 150, 0), (7, 225, 225), (8, 150, 150)])


def test_short_windows_and_small_slices(docs, rows, monkeypatch):
    few = [row for row in rows if len(row[1] or "") < 5000]
    small = docs.where("text is null or length(text) < 5000")
    for window in (1, 3, 7):
        assert result(S.remove_repeats(small, window)) == expected(few, window)


def test_periodic_texts(spark):
    texts = ["a b " * 40, "b a " * 40, "a " * 25, "c d e f g h i j k l m n o p q r s t u v " * 3 + "w", "a b " * 12]
    rows = [(k, text) for k, text in enumerate(texts)] + [(9, texts[3])]
    assert result(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows, 20)


def test_white_space_around_a_cut_stays(spark):
    words = " ".join(f"w{k}" for k in range(20))
    rows = [(1, words), (2, f"before\n{words}\n\nafter"), (3, None), (4, "")]
    found = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {row.row.doc_id: row.text for row in found.collect()}
    assert kept == {1: words, 2: "before\n\n\nafter", 3: None, 4: ""}


def test_empty_table(no_docs):
    assert S.remove_repeats(no_docs).count() == 0
