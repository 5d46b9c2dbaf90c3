"""Quotation linking: who answers whom, from quoted passages, and conversations without the quotes.

Method
    Levels      A line's quote level is the number of ``>`` marks in front of it; lines of one level that follow each other
                are a passage. The line that announces a quote ("... wrote:") goes with it.
    Passages    Each passage, each of its paragraphs (which end at a blank quoted line) and each of its lines is
                normalised (case, white space, so line ends as well) and hashed. So are the own words of every message: the
                whole, each paragraph, and each line.
    Links       A hash of a quote is joined to the nearest earlier message of the same conversation whose own words have it.
                A message answers the one that most of its lowest-level quoted characters come from.
    Order       Answers belong to the thread of the message they answer, found by pointer doubling. Ordered by thread, then turn,
                every message stands after the one it answers: that gives its ``position`` in the conversation, from 0. A message
                that quotes nothing starts a thread.
    Output      Messages without quoted lines.

Scale
    Own words are hashed in conversations with a quote alone, and written once. The nearest earlier message comes from running maxima over ranges of
    turns, first inside a range, then over the ranges, so a line that stands in every turn of a hot conversation is
    split by range; there is no join of equal lines with each other. Pointer doubling needs as many rounds as
    the logarithm of the longest chain of answers, over linked messages only, each written to the shared folder. Positions are numbers in
    one order of all messages, sorted as three numbers each over many tasks, less the first number of the conversation, so a
    hot conversation is no window of its own.

Defined results: a null or empty text has no quotes and stays as it is; a message of only quotes has an empty text; a
quote whose original is not in the conversation gives no link; rows with one conversation and turn are one message (their quotes
count together); a row with a null conversation or turn is never linked, is its own thread and has no position; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillwise.operators.numbering import number_rows
from tillwise.sources.staging import stage

MARKS = r"^[ \t>]*>[ \t]?"  # no repeated group: those overflow the stack on long lines
QUOTING = r"(?m)^[ \t]*>"
#: Words that announce a quote at the end of a line.
ANNOUNCES = r"(?i)\b(?:wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$"
RANGE = 1000  # turns
KNOWN = "conv_id is not null and turn is not null"


def _plain(text: Column) -> Column:
    """Normal form of a passage."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _lines(text: str) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, f"({MARKS})", 1)
    return F.length(marks) - F.length(F.translate(marks, ">", ""))


def parse(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, lines, own``: lines as (level, text) structs where there are quotes; own words."""
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role"),
        F.col("text"),
        F.when(
            F.col("text").rlike(QUOTING),
            F.transform(
                _lines("text"), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("text"))
            ),
        ).alias("lines"),
    )
    announces = lambda line, k: F.coalesce(
        line["text"].rlike(ANNOUNCES) & (F.get("lines", k + 1)["level"] > 0), F.lit(False)
    )
    own = F.filter("lines", lambda line, k: (line["level"] == 0) & ~announces(line, k))
    kept = F.trim(F.array_join(F.transform(own, lambda line: line["text"]), "\n"), F.lit(" \t\n"))
    return rows.withColumn("own", F.when(F.col("lines").isNull(), F.col("text")).otherwise(kept))


def _originals(parsed: DataFrame) -> DataFrame:
    """``conv_id, turn, hash`` of the own words of every message: whole, by paragraph and by line."""
    paragraphs, lines = F.split("own", r"\n\s*\n"), F.split("own", "\n")
    every = F.concat(F.array("own"), paragraphs, lines)
    hashes = F.array_distinct(
        F.transform(F.filter(F.transform(every, _plain), lambda p: p != ""), lambda p: F.xxhash64(p))
    )
    return parsed.where("own is not null").select("conv_id", "turn", F.explode(hashes).alias("hash"))


def _quotes(parsed: DataFrame) -> DataFrame:
    """``conv_id, turn, level, hash, chars`` of the quoted passages, their paragraphs and their lines."""
    lines = (
        parsed.where("lines is not null")
        .withColumn("message", F.xxhash64("conv_id", "turn", "text"))
        .select("conv_id", "turn", "message", F.posexplode("lines").alias("place", "line"))
        .select("conv_id", "turn", "message", "place", "line.level", "line.text")
    )
    inside = Window.partitionBy("conv_id", "turn", "message", "level").orderBy("place")
    lines = lines.where("level > 0").withColumn("island", F.col("place") - F.row_number().over(inside))
    passages = lines.groupBy("conv_id", "turn", "message", "level", "island").agg(
        F.sort_array(F.collect_list(F.struct("place", "text"))).alias("lines")
    )
    texts = F.transform("lines", lambda line: line["text"])
    paragraphs = F.split(F.array_join(texts, "\n"), r"\n\s*\n")
    every = F.array_distinct(F.transform(F.concat(F.array(F.array_join(texts, " ")), paragraphs, texts), _plain))
    return (
        passages.select("conv_id", "turn", "level", F.explode(F.filter(every, lambda p: p != "")).alias("passage"))
        .groupBy("conv_id", "turn", "level", F.xxhash64("passage").alias("hash"))
        .agg(F.max(F.length("passage")).alias("chars"))
    )


def links(parsed: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, n_quotes, n_linked``: for messages with quotes, the turn they answer (or null).

    ``n_quotes`` counts the distinct quoted passages, paragraphs and lines, ``n_linked`` those found in an earlier message.
    """
    known = parsed.where(KNOWN)
    quotes = stage(_quotes(known), "quoted-passages")
    quoting = quotes.select("conv_id").distinct()
    originals = stage(_originals(known.join(quoting, "conv_id", "left_semi")), "own-passages")
    events = quotes.select("conv_id", "hash", "turn", "level", "chars", F.lit(None).cast("long").alias("said")).unionByName(
        originals.select("conv_id", "hash", "turn", F.col("turn").alias("said")), allowMissingColumns=True
    )
    events = events.withColumn("range", F.floor(F.col("turn") / RANGE).cast("long"))
    # The last earlier turn that has the words: in the same range of turns, or else in an earlier range.
    near = Window.partitionBy("conv_id", "hash", "range").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    far = Window.partitionBy("conv_id", "hash").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        originals.groupBy("conv_id", "hash", F.floor(F.col("turn") / RANGE).cast("long").alias("range"))
        .agg(F.max("turn").alias("last"))
        .unionByName(
            quotes.select("conv_id", "hash", F.floor(F.col("turn") / RANGE).cast("long").alias("range")).distinct(),
            allowMissingColumns=True,
        )
        .groupBy("conv_id", "hash", "range")
        .agg(F.max("last").alias("last"))
        .withColumn("before", F.max("last").over(far))
        .drop("last")
    )
    found = (
        events.withColumn("near", F.max("said").over(near))
        .where("level is not null")
        .join(ranges, ["conv_id", "hash", "range"])
        .select("conv_id", "turn", "level", "chars", F.coalesce("near", "before").alias("original"))
    )
    by_original = found.groupBy("conv_id", "turn", "level", "original").agg(
        F.sum("chars").alias("chars"), F.count("*").alias("n")
    )
    linked = F.col("original").isNotNull()
    best = F.min(F.when(linked, F.struct("level", (-F.col("chars")).alias("c"), (-F.col("original")).alias("o"))))
    return by_original.groupBy("conv_id", "turn").agg(
        (-best["o"]).alias("reply_to"), F.sum("n").alias("n_quotes"), F.sum(F.when(linked, F.col("n")).otherwise(0)).alias("n_linked")
    )


def _threads(replies: DataFrame) -> DataFrame:
    """``conv_id, turn, thread, depth`` of the linked messages, by pointer doubling."""
    now = stage(replies.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).alias("depth")), "threads")
    while True:
        above = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("higher"), F.col("depth").alias("more"))
        step = now.join(above, ["conv_id", "thread"], "left").select(
            "conv_id",
            "turn",
            F.coalesce("higher", "thread").alias("thread"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("higher").isNotNull().alias("moved"),
        )
        following = stage(step, "threads")
        if following.where("moved").isEmpty():
            return following.drop("moved")
        now = following.drop("moved")


def _positions(messages: DataFrame, linked: DataFrame) -> DataFrame:
    """``conv_id, turn, position``: the place of every message in the reply order of its conversation, from 0."""
    keys = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"))
    places = (
        keys.where(KNOWN)
        .distinct()
        .join(linked.select("conv_id", "turn", "thread"), ["conv_id", "turn"], "left")
        .select("conv_id", F.coalesce("thread", "turn").alias("thread"), "turn")
    )
    numbered = number_rows(places, ["conv_id", "thread", "turn"], "number")
    first = numbered.groupBy("conv_id").agg(F.min("number").alias("first"))
    return numbered.join(first, "conv_id").select("conv_id", "turn", (F.col("number") - F.col("first")).alias("position"))


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: ``conv_id, turn, position, role, text`` (without quotes), ``reply_to, thread, depth, n_quotes, n_linked``.

    Ordered by conversation and ``position``, replies follow what they answer; ``in_order`` does that.
    """
    parsed = parse(messages)
    found = stage(links(parsed), "reply-links")
    threads = _threads(found.where("reply_to is not null"))
    linked = stage(found.join(threads, ["conv_id", "turn"], "left"), "threaded-links")
    both = _positions(messages, linked).join(linked, ["conv_id", "turn"], "left")
    return parsed.join(both, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "position",
        "role",
        F.col("own").alias("text"),
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("n_quotes", F.lit(0).cast("long")).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Conversations as they are read: each message after the one it answers, rows of one message by their text."""
    return rows.orderBy("conv_id", "position", "turn", "role", "text")
