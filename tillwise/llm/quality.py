"""Quality rules as weak supervision: rules vote or abstain, and a label model weighs the votes.

Method
    Every rule looks at one ratio of a document and votes good, votes bad or abstains. How often a rule is right is not
    set by hand: expectation-maximisation over the vote patterns of the whole corpus estimates, for good and for bad
    documents, how often each rule gives each vote, together with the share of good documents. The posterior
    probability that a document is good, given its votes, replaces the usual demand that it pass every rule.
    Abstaining carries no evidence. The first guess believes in documents without a bad vote, so that the classes keep
    their meaning; it only starts the estimation, which then lets a rule that often misfires be outvoted by the others.

Scale
    All counts come from array functions inside a row; nothing is exploded or shuffled but vote patterns, of which there are
    at most 3 to the number of rules. Only their counts reach the driver. Counts are written once, as a few
    numbers per document, so the texts are read once.

Defined results: a null or empty text has 0 in all counts, every rule abstains and ``base_failed`` is true; repeated rows
are judged alike; a null id is carried along; an empty table gives no rows; only columns to keep are carried, in ``row``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tillwise.llm.common import SPACES
from tillwise.sources.staging import stage

GOOD, BAD, ABSTAIN = 1, -1, 0
SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"

#: Rules: name, ratio, and two pairs of bounds: a ratio inside the first votes good, one outside the second votes bad.
#: A ratio without a denominator is null, which abstains.
RULES: list[tuple[str, str, tuple[float, float], tuple[float, float]]] = [
    ("symbols", "n_symbols / n_words", (0.0, 0.02), (0.0, 0.1)),
    ("repeated_lines", "n_dup_lines / n_lines", (0.0, 0.05), (0.0, 0.5)),
    ("repeated_words", "n_repeat_words / n_words", (0.0, 0.1), (0.0, 0.3)),
    ("word_length", "word_chars / n_words", (3.0, 10.0), (2.0, 14.0)),
    ("letters", "n_letters / word_chars", (0.85, 1.0), (0.65, 1.0)),
    ("capitals", "n_capitals / n_letters", (0.0, 0.15), (0.0, 0.4)),
    ("exclamations", "n_exclaims / n_words", (0.0, 0.02), (0.0, 0.1)),
]


def measures(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """``row`` (struct of the columns to keep) and the counts of each text as longs."""
    n = lambda pattern: F.regexp_count("text", F.lit(pattern))
    texts = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"),
    )
    cut = F.trim("text", F.lit(SPACES))
    words = texts.select(
        "row",
        (F.length("text") - n(SPACE)).alias("word_chars"),
        n(SYMBOL).alias("n_symbols"),
        n(r"\p{L}").alias("n_letters"),
        n(r"\p{Lu}").alias("n_capitals"),
        n("!").alias("n_exclaims"),
        F.filter(F.split("text", "\n"), lambda line: F.trim(line, F.lit(SPACES)) != "").alias("lines"),
        F.when(cut != "", F.split(cut, SPACE + "+")).otherwise(F.array().cast("array<string>")).alias("words"),
    )
    # A window is named by the hash of its three words.
    hashed = words.select(
        "row",
        *["word_chars", "n_symbols", "n_letters", "n_capitals", "n_exclaims"],
        F.size("words").alias("n_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform(
            F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))),
            lambda word, k: F.xxhash64(word, F.get("words", k + 1), F.get("words", k + 2)),
        ).alias("windows"),
    )
    # Only texts in which a window occurs twice are sorted; neighbours with one hash are then the repeated windows.
    pairs = F.array_sort(F.transform("windows", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    ordered = hashed.withColumn(
        "ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), pairs)
    ).drop("windows")
    same = lambda pair, k: pair["h"] == F.get("ordered", k)["h"]
    starts = ordered.withColumn(
        "starts",
        F.array_sort(
            F.transform(
                F.filter("ordered", lambda p, k: F.coalesce(same(p, k - 1), F.lit(False)) | F.coalesce(same(p, k + 1), F.lit(False))),
                lambda pair: pair["k"],
            )
        ),
    ).drop("ordered")
    covered = F.aggregate(
        F.transform("starts", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - s, F.lit(3)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    counted = starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).drop("starts")
    return counted.select("row", *[F.col(c).cast("long").alias(c) for c in counted.columns if c != "row"])


def vote(ratio: str, good: tuple[float, float], fair: tuple[float, float]) -> Column:
    value = F.try_divide(*(F.col(part) for part in ratio.split(" / ")))
    return (
        F.when(value.between(*good), GOOD)
        .when((value < fair[0]) | (value > fair[1]), BAD)
        .otherwise(ABSTAIN)
        .cast("int")
    )


def _votes() -> list[Column]:
    return [vote(ratio, good, fair).alias(f"vote_{name}") for name, ratio, good, fair in RULES]


class LabelModel:
    """Share of good documents and, for both classes, how often each rule votes good when it votes."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 100):
        self.share, self.good, self.bad = 0.5, [0.5] * rules, [0.5] * rules
        believed = [self._first_guess(votes) for votes, _ in patterns]
        for _ in range(rounds if patterns else 0):
            # Half a vote of each kind is added, so that no probability becomes 0 or 1.
            total = sum(n for _, n in patterns)
            self.share = (sum(p * n for p, (_, n) in zip(believed, patterns)) + 0.5) / (total + 1)
            for rule in range(rules):
                given = [(p, v[rule], n) for p, (v, n) in zip(believed, patterns) if v[rule] != ABSTAIN]
                yes = sum(p * n for p, v, n in given if v == GOOD) + 0.5
                no = sum(p * n for p, v, n in given if v == BAD) + 0.5
                self.good[rule] = yes / (yes + no)
                yes = sum((1 - p) * n for p, v, n in given if v == GOOD) + 0.5
                no = sum((1 - p) * n for p, v, n in given if v == BAD) + 0.5
                # A good vote is never evidence against a document: the rules are better than chance.
                self.bad[rule] = min(yes / (yes + no), self.good[rule])
            before, believed = believed, [self.posterior(votes) for votes, _ in patterns]
            if max(abs(a - b) for a, b in zip(before, believed)) < 1e-9:
                break

    @staticmethod
    def _first_guess(votes: tuple[int, ...]) -> float:
        """First guess, before any rule's accuracy is known: one vote for bad outweighs all others."""
        bad = sum(v == BAD for v in votes)
        return 0.9 if not bad else 0.5 ** (2 * bad)

    def weight(self, rule: int, given: int) -> float:
        """Evidence of a vote, as a logarithm of odds."""
        if given == GOOD:
            return math.log(self.good[rule] / self.bad[rule])
        return math.log((1 - self.good[rule]) / (1 - self.bad[rule]))

    def posterior(self, votes: tuple[int, ...]) -> float:
        odds = math.log(self.share / (1 - self.share))
        odds += sum(self.weight(rule, v) for rule, v in enumerate(votes) if v != ABSTAIN)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def judge(docs: DataFrame, keep: list[str], text_column: str = "text", least: float = 0.5) -> DataFrame:
    """Counts, votes (``vote_*``), ``quality`` (posterior probability), ``base_failed`` and ``kept`` of every document."""
    counted = stage(measures(docs, keep, text_column).select("*", *_votes()), "measures")
    names = [f"vote_{name}" for name, *_ in RULES]
    rows = counted.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()  # at most 3 ** rules rows
    model = LabelModel([(tuple(row[name] for name in names), row["n"]) for row in rows], len(names))
    odds = F.lit(math.log(model.share / (1 - model.share)))
    for rule, name in enumerate(names):
        odds = odds + (
            F.when(F.col(name) == GOOD, model.weight(rule, GOOD)).when(F.col(name) == BAD, model.weight(rule, BAD)).otherwise(0.0)
        )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = counted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
