"""License scans by an exact set-similarity join of text blocks with license templates.

Method
    Blocks      A template is looked for in every run of ``width`` words, a quarter more than the template has. For the join
                the words are cut into blocks that overlap by half and are twice as long as the widest run, so every run
                lies whole in one block.
    Order       Tokens of the templates are ordered by how many documents hold them, rarest first.
    Join        A template is contained in a run if the run has at least ``threshold`` of its distinct tokens, that is
                at least ``need`` of them. Then its block and the template share a token among the first ``size - need + 1``
                of either (prefix filter), the block has at least ``need`` template tokens (length filter), and the tokens
                before and after a shared one could still make up ``need`` (positional filter). Of the pairs that
                pass, every run of the block that begins with a token of the template is compared token by token, so the
                join finds every contained template and no other.
    Phrases     The base labels come from phrases whose words stand consecutively; they are counted apart.

Scale
    Texts are read twice and never shuffled: only template tokens matter, so a document sends the few it holds, and
    blocks are made only of documents that hold enough tokens of some template. The templates are a list in the program:
    they and their prefixes are broadcast, which no data can enlarge, so blocks are never shuffled by token. Labels return to the documents in a join of narrow rows.

Defined results: a null or empty text has no words, places or labels; repeated rows are labelled alike; a null id is carried
along; a template without tokens is refused; an empty table gives no rows; only columns to keep are carried, in ``row``.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from tillwise.sources.staging import stage

#: Phrases of the base labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Openings and bodies of widely used notices. A name that alone tells licenses apart stands among at most four
#: tokens, all of which are needed then.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License",
    "apache-body": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-body": "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-work": "GNU General Public License",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-body": "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software",
    "mit-short": "under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
THRESHOLD = 0.8

# Words are what stands between these characters once A-Z are lowered; on the text as it is, A-Z are letters too.
OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: str) -> list[str]:
    """Distinct lower-case words, sorted."""
    return sorted(set(re.findall(LETTER + "+", text.lower())))


def run_width(template: str) -> int:
    """Words of the runs in which a template is looked for."""
    words = len(re.findall(LETTER + "+", template))
    return words + -(-words // 4)


def _any_of(words: list[str]) -> str:
    """Pattern for any of the words; common beginnings are tried once."""
    rest: dict[str, list[str]] = {}
    for word in words:
        rest.setdefault(word[:1], []).append(word[1:])
    options = [re.escape(head) + _any_of(tails) for head, tails in sorted(rest.items()) if head]
    if not options:
        return ""
    return "(?:" + "|".join(options) + ")" + ("?" if "" in rest else "")


def _whole(words: str) -> str:
    """Pattern for whole words; (?i) concerns only A-Z."""
    return f"(?i)(?<!{LETTER})(?:{words})(?!{LETTER})"


def _count(text: str, words: str) -> Column:
    return F.regexp_count(text, F.lit(_whole(words))).cast("long")


def _overlap(phrases: list[str]) -> bool:
    """Whether a place of one phrase can share words with a place of another one."""
    lists = [phrase.split(" ") for phrase in phrases]
    return any(
        a is not b and any(a[k : k + len(b)] == b[: len(a) - k] for k in range(len(a))) for a in lists for b in lists
    )


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LETTER + "+")).cast("long")


def scan(
    docs: DataFrame,
    keep: list[str],
    templates: dict[str, str] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    text_column: str = "text",
) -> DataFrame:
    """One row per document.

    ``row`` (struct of the columns to keep), ``n_words``, ``n_base`` (places of all phrases), ``first_word`` and
    ``last_word`` (smallest and largest start, else null), ``base_labels`` and ``labels`` (with those of contained
    templates) as sorted comma-joined texts, and ``score``: 1 with a base label, else the largest containment found, or 0.
    """
    spark = docs.sparkSession
    own = {label: tokens(text) for label, text in templates.items()}
    if not all(own.values()):
        raise ValueError("a template has no tokens")
    need = {label: math.ceil(threshold * len(words) - 1e-9) for label, words in own.items()}
    vocabulary = sorted(set().union(*own.values())) or [""]
    width = {label: run_width(text) for label, text in templates.items()}
    step = max(width.values(), default=1)
    apart = {phrase: phrase.replace(" ", OTHER + "+") for phrase in phrases}
    any_phrase = "|".join(apart.values())
    any_token = _any_of(vocabulary)

    # --- one pass over the texts: words, phrases, and which template tokens a document holds
    key = [F.xxhash64("text").alias("hash"), F.length("text").alias("chars")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"),
    )
    present = F.array_distinct(
        F.transform(F.regexp_extract_all("text", F.lit(f"({_whole(any_token)})"), F.lit(1)), lambda w: F.translate(w, UPPER, LOWER))
    )
    # All phrases are looked for at once, unless a place of one could hide a place of another.
    hits = F.regexp_extract_all("text", F.lit(f"({_whole(any_phrase)})"), F.lit(1))
    parts = F.split("text", _whole(any_phrase))
    last = F.element_at("hits", -1)

    def places_of(pattern: str) -> Column:
        if _overlap(list(phrases)):
            return _count("text", pattern)
        return F.size(F.filter("hits", lambda hit: hit.rlike(f"(?i)^(?:{pattern})$"))).cast("long")

    base = rows.select(
        "row",
        *key,
        _words(F.col("text")).alias("n_words"),
        present.alias("present"),
        hits.alias("hits"),
        "text",
    )
    base = base.withColumns({f"places_{k}": places_of(pattern) for k, pattern in enumerate(apart.values())})
    places = sum((F.col(f"places_{k}") for k in range(len(apart))), F.lit(0).cast("long"))
    seen = F.col("n_base") > 0
    found = F.array_sort(
        F.array_distinct(
            F.filter(
                F.array(*[F.when(F.col(f"places_{k}") > 0, label) for k, label in enumerate(phrases.values())]),
                lambda label: label.isNotNull(),
            )
        )
    )
    base = base.withColumn("n_base", places).select(
        "row",
        "hash",
        "chars",
        "n_words",
        "present",
        "n_base",
        F.when(seen, _words(parts[0])).alias("first_word"),
        F.when(seen, F.col("n_words") - _words(F.element_at(parts, -1)) - _words(last)).alias("last_word"),
        found.alias("base"),
    )
    base = stage(base, "license-base")

    # --- the global order of tokens, and the prefixes of the templates in it
    seen_in = base.select(F.explode("present").alias("token")).groupBy("token").count().collect()  # <= vocabulary
    often = {row["token"]: row["count"] for row in seen_in}
    ordered = sorted(vocabulary, key=lambda token: (often.get(token, 0), token))
    rank = {token: k for k, token in enumerate(ordered)}
    first = {label: sorted(words, key=rank.get)[: len(words) - need[label] + 1] for label, words in own.items()}
    prefixes = [
        (label, token, place, first[label], own[label], len(own[label]), need[label], width[label])
        for label in own
        for place, token in enumerate(first[label])
    ]
    prefixes = spark.createDataFrame(
        prefixes,
        "label string, token string, place int, prefix array<string>, tokens array<string>, size int, need int, width int",
    )

    # --- blocks of the documents that hold enough tokens of some template
    enough = F.lit(False)
    for label, words in own.items():
        enough = enough | (F.size(F.array_intersect("present", _strings(words))) >= need[label])
    blocks = (
        rows.select("text", *key, present.alias("present"))
        .where(enough)
        .select("hash", "chars", F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({LETTER}+)"), F.lit(1)).alias("words"))
        .select(
            "hash",
            "chars",
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("words") - 1) / step).cast("int") - 1)),
                    lambda k: F.slice("words", k * step + 1, F.lit(2 * step)),
                )
            ).alias("block", "words"),
        )
        # Only template tokens can be shared; they stand in the global order, rarest first.
        .withColumn("known", F.array_intersect(_strings(ordered), "words"))
    )
    least = min(need.values(), default=1)
    candidates = (
        blocks.where(F.size("known") >= least)
        .select("*", F.posexplode(F.slice("known", F.lit(1), F.size("known") - least + 1)).alias("at", "token"))
        .join(F.broadcast(prefixes), "token")
        .where("size(known) >= need and at <= size(known) - need")
        .where("least(place, at) + 1 + least(size - place - 1, size(known) - at - 1) >= need")
        # A pair is met once for each token its prefixes share; the first of them stands for it.
        .where("array_intersect(known, prefix)[0] = token")
    )
    begins = F.filter(F.sequence(F.lit(1), F.size("words")), lambda k: F.array_contains("tokens", F.get("words", k - 1)))
    shared = F.transform(begins, lambda k: F.size(F.array_intersect("tokens", F.slice("words", k, F.col("width")))))
    contained = (
        candidates.where(F.size(F.array_intersect("known", "tokens")) >= F.col("need"))
        .withColumn("shared", F.array_max(shared))
        .where("shared >= need")
        .groupBy("hash", "chars")
        .agg(F.collect_set("label").alias("found"), F.max(F.col("shared") / F.col("size")).alias("containment"))
    )
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return base.join(contained, ["hash", "chars"], "left").select(
        "row",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(seen, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
