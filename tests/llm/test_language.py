import zlib
from collections import Counter

from tillwise.llm import language_id as L


def grams(text):
    found = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        for n in (1, 2, 3):
            found.update(padded[k : k + n] for k in range(len(padded) - n + 1) if padded[k : k + n] != " ")
    return found


def code(gram):
    return sum(ord(c) << (21 * k) for k, c in enumerate(gram))


def top(counts, size=L.PROFILE):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def test_held_out_languages_are_recognised(docs, rows):
    profiles = L.learn(docs.where(~L.held_out()))
    assert profiles.names == ["de", "en"]
    found = L.classify(docs, profiles, ["doc_id", "text"]).collect()
    assert len(found) == len(rows)
    long = [r for r in found if r.row.text and len(r.row.text.split()) > 20 and any(c.isalpha() for c in r.row.text)]
    truth = {row[1]: "de" if "ung" in row[1] or "sch" in row[1] else "en" for row in rows if row[1]}
    right = [r.lang_pred == truth[r.row.text] for r in long]
    assert sum(right) / len(right) > 0.95
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.row.text or "")) for r in found)
    assert all(0 <= r.score <= 1 for r in found)


def test_profiles_and_distances_match_brute_force(docs, rows):
    learned = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[2] and r[1]]
    counts = {name: sum((grams(r[1]) for r in learned if r[2] == name), Counter()) for name in ("de", "en")}
    ranked = {name: top(c) for name, c in counts.items()}
    profiles = L.learn(docs.where(~L.held_out()))
    for k, name in enumerate(profiles.names):
        own = [L.np.searchsorted(profiles.grams, L.np.uint64(code(g))) for g in ranked[name]]
        assert profiles.places[own, k].tolist() == list(range(len(own)))
    for text in ("The other thing, wher?", "Schachung über pfei", rows[2][1]):
        own = top(grams(text))
        place = {name: {g: k for k, g in enumerate(order)} for name, order in ranked.items()}
        out = {n: sum(abs(p[g] - k) if g in p else L.PROFILE for k, g in enumerate(own)) for n, p in place.items()}
        best = min(out, key=lambda n: (out[n], n))
        name, score = profiles.closest(text)
        assert name == best and abs(score - (1 - out[best] / (len(own) * L.PROFILE))) < 1e-12


def test_nothing_to_learn_from(docs, no_docs):
    profiles = L.learn(no_docs)
    assert {r.lang_pred for r in L.classify(docs.limit(5), profiles, ["doc_id"]).collect()} == {"und"}
    assert L.classify(no_docs, profiles, ["doc_id"]).count() == 0


def test_counts_are_handed_on_when_too_many_are_held():
    batch = L.pa.RecordBatch.from_arrays(
        [L.pa.array(["a", "b", "a"]), L.pa.array(["xyz", "xy", "xyz" * 300])], ["lang", "text"]
    )
    whole, parts = Counter(), Counter()
    for counter, hold in ((whole, 1 << 20), (parts, 2)):
        for out in L._count(iter([batch, batch]), hold):
            for row in out.to_pylist():
                counter[row["lang"], row["gram"]] += row["n"]
    assert whole == parts and whole["b", code("xy")] == 2
