"""Trie of all prefixes of conversations, from whole sequences collapsed to weighted ones.

Method
    Identical conversations are grouped into one weighted sequence with the list of the conversations that end there. Sequences
    that are proper prefixes of others are dropped by an anti-join; those left are the leaves. Every sequence gives its weight to each
    of its prefixes, and a node is the sum over all sequences through it.

    A sequence of turns has a 128-bit key: the XOR of the hashes of (place, turn) of its turns. XOR combines in any
    order, so the keys of all prefixes of a conversation come from running sums over parts of it, and the key of a node's
    parent is its own key without its last turn. Nodes are compared by depth and key, which takes 128 bits as enough.

    Savings of a subtree: each node is charged to one leaf below it, the smallest. On the path of a leaf the charged nodes
    are the lowest ones; a node's total is the sum, over the leaves below it, of what they are charged at its depth or lower.

Scale
    Texts are hashed where they are read: only numbers are shuffled. A conversation of any length is cut at places of a global sort and
    at every ``RUN`` turns, and the parts are put together by one small row each, so no task holds a whole
    conversation. Copies are combined before prefixes are made: a conversation repeated by a third of all is one sequence. The first
    level, whose nodes all have one parent, is linked by a constant, not by a join. Lists of ends are sorted over many
    tasks, joined to texts of ``PIECE`` ids, and hashed as a stream, so no list is ever held whole.

Defined results: rows with a null conversation take no part; remainders have the sign of the conversation's number; turns with an equal number stand in the order of a hash of role and text, equal rows
are turns of their own; a null turn comes first; null role or text is empty; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillwise.llm.common import parts_for
from tillwise.sources.staging import stage

RUN = 4096  # turns whose running sums are made in one window
PIECE = 500  # ids in one text of a list of ends
PART = 200_000  # rows in a range of the global sorts
POSITION_BITS = 33  # of monotonically_increasing_id
KEY = ["depth", "k1", "k2"]
NO_ENDS = sha256(b"").hexdigest()


def _halves(digest: Column) -> list[Column]:
    """Two longs of a hexadecimal digest."""
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17)]


def _xor(a: str, b: str) -> Column:
    return F.coalesce(F.col(a), F.lit(0)).bitwiseXOR(F.coalesce(F.col(b), F.lit(0)))


def numbered_turns(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, place, t1, t2, bytes``: every turn with its place from 1, its hash and the bytes of its text; a written table."""
    words = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    # The length of the role tells where it ends.
    digest = F.md5(F.concat_ws(":", F.octet_length(words(role)).cast("string"), words(role), words(text)))
    hashed = (
        conversations.where(F.col(f"`{conv}`").isNotNull())
        .select(
            F.col(f"`{conv}`").cast("long").alias("conv_id"),
            F.col(f"`{turn}`").cast("long").alias("turn"),
            *[half.alias(name) for half, name in zip(_halves(digest), ("t1", "t2"))],
            F.octet_length(words(text)).cast("long").alias("bytes"),
        )
        # Equal rows, even a third of the table, are told apart by their place in the input and so spread over ranges.
        .withColumn("input", F.monotonically_increasing_id())
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "t1", "t2", "input"]
    ranges = parts_for(hashed.count(), PART, 8)
    ranged = hashed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("input", "turn")
    ranged = stage(ranged.withColumn("at", F.monotonically_increasing_id()), "ordered-turns")
    ranged = ranged.withColumn("range", F.shiftright("at", POSITION_BITS))
    # Where a conversation goes on in a later range, its turns before: one row per such place.
    counts = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "range", F.sum("rows").over(earlier).alias("before")).where("before > 0")
    within = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("at"))
    placed = ranged.withColumn("within", within).join(offsets, ["conv_id", "range"], "left")
    place = (F.col("within") + F.coalesce("before", F.lit(0))).alias("place")
    return stage(placed.select("conv_id", place, "t1", "t2", "bytes"), "turns")


def rebuilt_turns(turns: DataFrame, modulus: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """The turns of all conversations with their heads taken from others: ``conv_id, depth, t1, t2, bytes``; and all ``conv_id``.

    Conversation c begins with the first h turns of c - c % modulus, h = crc32(c) % heads, and goes on with its own turns after h.
    """
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("head")
    base = (F.col("conv_id") - F.col("conv_id") % modulus).alias("base")
    lengths = stage(turns.groupBy("conv_id").agg(F.count("*").alias("turns")), "lengths")
    own_lengths = lengths.select("conv_id", base, head)
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    # How many turns the head gives: fewer than h where the other conversation is short or absent.
    given = own_lengths.join(bases, "base", "left").select(
        "conv_id", "base", "head", F.least("head", F.coalesce("base_turns", F.lit(0))).alias("given")
    )
    starts = turns.where((F.col("place") < heads) & (F.col("conv_id") % modulus == 0)).withColumnRenamed("conv_id", "base")
    first = given.join(starts, "base").where("place <= given").select("conv_id", F.col("place").alias("depth"), "t1", "t2", "bytes")
    rest = turns.withColumn("head", head).where("place > head").drop("head")
    short = given.where("given < head")
    rest = rest.join(short.select("conv_id", (F.col("head") - F.col("given")).alias("less")), "conv_id", "left")
    rest = rest.select("conv_id", (F.col("place") - F.coalesce("less", F.lit(0))).alias("depth"), "t1", "t2", "bytes")
    return first.unionByName(rest), lengths.select("conv_id")


def running(rows: DataFrame, key: str, place: str, totals: dict[str, tuple[str, str]], backwards: bool = False) -> DataFrame:
    """Add running totals along ``place`` per ``key``: name -> (column, "bit_xor" or "sum"); ``backwards`` runs from the end.

    Runs of ``RUN`` places are windows of their own; the totals of the other runs before are added by one row per run.
    """
    run = F.floor(F.col(place) / RUN).alias("run")
    order = F.desc(place) if backwards else F.asc(place)
    combine = {"bit_xor": F.bit_xor, "sum": F.sum}
    window = Window.partitionBy(key, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", run)
    runs = rows.groupBy(key, "run").agg(*[combine[how](column).alias(f"{name} of run") for name, (column, how) in totals.items()])
    earlier = Window.partitionBy(key).orderBy(F.desc("run") if backwards else F.asc("run")).rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select(key, "run", *[combine[how](f"{name} of run").over(earlier).alias(f"{name} before") for name, (_, how) in totals.items()])
    before = before.where(" or ".join(f"`{name} before` is not null" for name in totals))
    rows = rows.select("*", *[combine[how](column).over(window).alias(f"{name} within") for name, (column, how) in totals.items()])
    rows = rows.join(before, [key, "run"], "left")
    for name, (_, how) in totals.items():
        both = _xor(f"{name} within", f"{name} before") if how == "bit_xor" else F.col(f"{name} within") + F.coalesce(f"{name} before", F.lit(0))
        rows = rows.withColumn(name, both).drop(f"{name} within", f"{name} before")
    return rows.drop("run")


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, x1, x2, bytes``: the key of the first ``depth`` turns, and what its last turn gave to it."""
    digest = F.md5(F.concat_ws(":", F.col("depth").cast("string"), F.col("t1").cast("string"), F.col("t2").cast("string")))
    hashed = rebuilt.select("conv_id", "depth", "bytes", *[half.alias(name) for half, name in zip(_halves(digest), ("x1", "x2"))])
    return running(hashed, "conv_id", "depth", {"k1": ("x1", "bit_xor"), "k2": ("x2", "bit_xor")})


def sequences(prefix: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2``: the whole sequence of every conversation, turnless ones included."""
    last = prefix.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("last")).select("conv_id", "last.*")
    zero = F.lit(0).cast("long")
    return conversations.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(name, zero).alias(name) for name in KEY])


def end_lists(whole: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256``: hash of the ascending, comma-joined conversations of each sequence."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, done = None, [], []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done), [pa.int64()] * 4 + [pa.string()])]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, [*KEY, "first", "ids"])

        def close() -> None:
            if ids:
                done.append((*key, ids[0], ",".join(map(str, ids))))

        for batch in batches:
            for *row, conv in zip(*[batch.column(name).to_pylist() for name in [*KEY, "conv_id"]]):
                if row != key or len(ids) == PIECE:
                    close()
                    key, ids = row, []
                    if len(done) == 2 * PIECE:
                        yield flush()
                ids.append(conv)
        close()
        if done:
            yield flush()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = [*zip(*done)]
            kinds = [pa.int64()] * 3 + [pa.string()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [*KEY, "ends_sha256"])

        for batch in batches:
            for *row, ids in zip(*[batch.column(name).to_pylist() for name in [*KEY, "ids"]]):
                if row != key:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = row, sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(done) > 10_000:
                yield flush()
        if key:
            done.append((*key, state.hexdigest()))
            yield flush()

    order = [*KEY, "conv_id"]
    spread = whole.repartitionByRange(parts_for(whole.count(), PART, 8), *order).sortWithinPartitions(*order)
    texts = spread.select(*order).mapInArrow(pieces, "depth long, k1 long, k2 long, first long, ids string")
    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids").mapInArrow(
        hashed, "depth long, k1 long, k2 long, ends_sha256 string"
    )


def trie(conversations: DataFrame, modulus: int = 5, heads: int = 9, **columns: str) -> DataFrame:
    """One row per node; see the contract of the query for the columns. ``columns`` names those of the table (conv, turn, role, text)."""
    rebuilt, every = rebuilt_turns(numbered_turns(conversations, **columns), modulus, heads)
    prefix = stage(prefixes(rebuilt), "prefixes")
    whole = stage(sequences(prefix, every), "sequences")

    # Collapse: one weighted sequence for identical conversations, under the smallest of them.
    collapsed = stage(whole.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id")), "collapsed")
    paths = stage(prefix.join(collapsed.select("conv_id", "weight", F.col("depth").alias("length")), "conv_id"), "paths")
    inner = paths.where("depth < length").select(*KEY).distinct()
    root = F.lit(0).cast("long")
    leaves = collapsed.where((F.col("depth") > 0) | (F.lit(paths.isEmpty()))).join(inner, KEY, "left_anti")
    leaves = stage(leaves.select("conv_id", F.lit(True).alias("leaf")), "leaves")

    # Every sequence gives its weight to its prefixes; the root is the prefix of no turns.
    marked = paths.join(leaves, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False)))
    marked = stage(marked.select("conv_id", "weight", "leaf", *KEY, "x1", "x2", "bytes"), "marked-paths")
    at_root = collapsed.join(leaves, "conv_id", "left").select(
        "conv_id", "weight", F.coalesce("leaf", F.lit(False)).alias("leaf"), *[root.alias(name) for name in [*KEY, "x1", "x2", "bytes"]]
    )
    through = marked.unionByName(at_root)
    nodes = through.groupBy(*KEY).agg(
        F.sum("weight").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.count_if("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf"), F.col("conv_id"))).alias("owner"),
        *[F.first(name).alias(name) for name in ("x1", "x2", "bytes")],
    )
    nodes = stage(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")

    # What each leaf is charged at a depth or lower, added up over the leaves of a node.
    charged = nodes.select(F.col("owner").alias("leaf_id"), "depth", *[F.lit(None).cast("long").alias(k) for k in ("k1", "k2")], "own")
    walked = through.where("leaf").select(F.col("conv_id").alias("leaf_id"), *KEY, F.lit(0).cast("long").alias("own"))
    steps = charged.unionByName(walked).groupBy("leaf_id", "depth").agg(*[F.max(n).alias(n) for n in ("k1", "k2")], F.sum("own").alias("own"))
    below = running(steps, "leaf_id", "depth", {"lower": ("own", "sum")}, backwards=True)
    saved = below.groupBy(*KEY).agg(F.sum("lower").alias("saved_tokens"))

    # Links to the parents: its depth is one less and its key lacks the last turn.
    up = [(F.col("depth") - 1).alias("depth"), *[F.col(k).bitwiseXOR(F.col(x)).alias(k) for k, x in (("k1", "x1"), ("k2", "x2"))]]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    parents = nodes.where("depth > 0").select(*KEY, F.col("conv_id").alias("parent_conv_id"))
    parents = parents.select(F.col("depth").alias("up_depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), "parent_conv_id")
    deep = nodes.where("depth > 1").withColumns({"up_depth": up[0], "up1": up[1], "up2": up[2]})
    deep = deep.join(parents, ["up_depth", "up1", "up2"]).drop("up_depth", "up1", "up2")
    first = nodes.where("depth = 1").withColumn("parent_conv_id", nodes.where("depth = 0").agg(F.min("conv_id")).scalar())
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    linked = deep.unionByName(first).unionByName(top)
    return (
        linked.join(children, KEY, "left")
        .join(saved, KEY, "left")
        .join(end_lists(whole), KEY, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            "n_leaves",
            F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
            *KEY[1:],
        )
    )
