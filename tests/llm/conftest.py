import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that the operators use inside
    "row string, size long, words string, doc string, z string, h string, hash string, shard int, score string, tag int"
)


def sentence(rng: random.Random, n: int, lang: str) -> str:
    """Invented words; the two languages differ in their syllables."""
    parts = ["tha", "ing", "er", "on", "st", "wh", "ea"] if lang == "en" else ["sch", "ung", "ü", "ei", "pf", "ach", "tz"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return "".join(word + rng.choice([" ", " ", " ", ". ", "\n"]) for word in words)


def corpus() -> list[tuple]:
    """Documents with copies, near copies, shared passages and every odd case."""
    rng = random.Random(5)
    texts = [sentence(rng, rng.randint(1, 400), "en" if k % 3 else "de") for k in range(60)]
    passage, line = sentence(rng, 55, "en"), "all the same line again and again for everyone"
    texts += [texts[0]] * 12 + [texts[1] + " end"] * 2
    texts += [sentence(rng, 30, "en") + passage + sentence(rng, 25, "en") for _ in range(8)]
    texts += ["\n".join([line] * k + [sentence(rng, 40, "en")]) for k in (1, 2, 30)]
    texts += [f"{line} {line} " + sentence(rng, k, "de") for k in (3, 60)]
    long = sentence(rng, 30_000, "en")
    texts += [long, "Prefix " + long, "x " * 3000, None, "", "  \n\t ", "a", "one two", "É! " * 40, "12 34 !!", None]
    rows = []
    for k, text in enumerate(texts):
        source = [None, "", "src0", "src0", "src0", "src1", "Src2", "é"][k % 8]
        lang = None if k % 7 == 0 else "de" if text and ("ung" in text or "sch" in text) else "en"
        rows.append((k, text, lang, source, None if text is None else len(text)))
    rows += [rows[3], rows[3], (None, texts[5], "en", "src0", 1), (None, None, None, None, None), (500, texts[7] + "!", "en", None, 2)]
    return [(*row, "r", 1, "w", "d", "z", "h", "x", 2, "s", 3) for row in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
