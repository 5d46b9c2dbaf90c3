"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Method
    Targets     Sources weigh 5, 2, 1, repeating, in code point order (null last) and share all words; a source gives at
                most ``most`` times its words, and what it cannot give is shared again by weight.
    Draw        The documents of a source are laid out on a line of words in the order of a seeded hash, one pass after
                the other until the target is reached; so whole passes take every document, and the last one takes
                a random part. The document at the end is cut. A source's words are met exactly, to rounding.
    Blocks      The line is cut into blocks of ``block_words``; a drawn document belongs to the block it starts in.
    Tree        The block quotas of all sources are split among the output shards by recursive halving: how many blocks
                of each source go left is drawn from the multivariate hypergeometric distribution, seeded by the node. A
                shard takes the next blocks of every source in permuted order, so shards are disjoint and quotas exact.
    Shuffle     Inside a shard documents are ordered by a seeded hash. ``in_order`` writes the mix that way, and
                ``with_places`` numbers the draws of a shard in that order.

Scale
    The driver holds one number per source. Positions come from sums over hash ranges of a source, then running sums
    inside a range, so a source with a third of all rows is spread over many tasks. Every task walks only the branches
    of the tree that lead to its own shards. Reruns give the same rows: all draws depend on seeds and content alone.

Defined results: a null or empty text has size 0 and is never drawn; a null source is a source of its own; a null id is
carried along; repeated rows are documents of their own; equal rows are interchangeable; an empty table gives no rows;
only the columns to keep are carried, inside ``row``, so their names never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tillwise.llm.common import parts_for, word_count
from tillwise.sources.staging import stage

WEIGHTS = (5, 2, 1)
SEED = 20_117


def share(sizes: list[int], weights: list[float], most: int) -> list[float]:
    """Targets that share all words by weight, none above ``most`` times its size."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if weights[k] * unit > most * sizes[k]}
        for k in full or open_:
            targets[k] = float(most * sizes[k]) if full else weights[k] * unit
        left -= sum(targets[k] for k in full)
        open_ = open_ - full if full else set()
    return targets


def tree(quotas: np.ndarray, shards: int, seed: int, begin: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(shard, blocks of each source in the shards before it, blocks of each source in it)`` for begin <= shard < end."""
    todo = [(0, shards, quotas.astype(np.int64), np.zeros(len(quotas), np.int64))]
    while todo:
        low, high, quota, before = todo.pop()
        if high <= begin or low >= end:
            continue
        if high - low == 1:
            yield low, before, quota
            continue
        middle = (low + high) // 2
        room = int(quota.sum()) * (middle - low) // (high - low)
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(quota, room)
        todo += [(middle, high, quota - left, before + left), (low, middle, left, before)]


def permutation(blocks: int, seed: int, source: int) -> tuple[int, int]:
    """Factor and shift of a permutation ``place -> (factor * place + shift) % blocks``."""
    rng = np.random.default_rng([seed, source])
    factor, shift = (int(x) for x in rng.integers(0, max(1, blocks), 2))
    while gcd(factor, blocks) != 1:
        factor += 1
    return factor % max(1, blocks), shift


def _shards(spark, quotas: list[int], per_shard: int, seed: int) -> DataFrame:
    """``source_no, block, shard``: where every block of every source goes."""
    count = np.array(quotas, np.int64)
    shards = max(1, -(-int(count.sum()) // per_shard))
    turns = [permutation(n, seed, k) for k, n in enumerate(quotas)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for shard, before, own in tree(count, shards, seed, int(ids.min()), int(ids.max()) + 1):
                for source in np.flatnonzero(own):
                    factor, shift = turns[source]
                    places = np.arange(before[source], before[source] + own[source])
                    block = (factor * places + shift) % count[source]
                    n = len(block)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, source, np.int32)), pa.array(block), pa.array(np.full(n, shard, np.int64))],
                        ["source_no", "block", "shard"],
                    )

    ids = spark.range(0, shards, 1, parts_for(shards, 1000))
    return ids.mapInArrow(walk, "source_no int, block long, shard long")


def mix(
    docs: DataFrame,
    keep: list[str],
    source_column: str = "source",
    text_column: str = "text",
    weights: tuple[float, ...] = WEIGHTS,
    most: int = 3,
    block_words: int = 4096,
    blocks_per_shard: int = 64,
    undrawn: bool = False,
    seed: int = SEED,
) -> DataFrame:
    """Drawn documents, one row per draw.

    ``row`` (struct of the columns to keep), ``source_no``, ``source_size``, ``target``, ``size`` (words of the
    document), ``start`` (its place in its source), ``pass``, ``words`` (how many of its first words are taken), ``shard``
    and ``turn`` (the order inside the shard). With ``undrawn`` documents that are never drawn have one row with 0 words.
    """
    spark = docs.sparkSession
    text, source = F.col(f"`{text_column}`"), F.col(f"`{source_column}`")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        source.alias("source"),
        word_count(text_column).alias("size"),
        F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in keep], text).alias("h"),
    )
    sizes = stage(rows.select("source", "size", "h"), "sizes")
    found = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row a source
    found.sort(key=lambda row: (row.source is None, row.source))
    targets = share([r["size"] for r in found], [weights[k % len(weights)] for k in range(len(found))], most)
    words = [int(t + 0.5) for t in targets]
    block = max(block_words, sum(words) >> 28)  # a draw from the tree can hold 10**9 blocks
    listed = spark.createDataFrame(
        [(r.source, k, r["size"], targets[k], words[k]) for k, r in enumerate(found)],
        "name string, source_no int, source_size long, target double, quota long",
    )
    bits = max(1, sum(r.n for r in found) // 50_000).bit_length()  # hash ranges of about 50,000 rows
    bucket = F.shiftright("h", 64 - bits).alias("bucket")
    numbered = lambda frame: frame.join(listed, frame["source"].eqNullSafe(listed["name"]))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        numbered(sizes)
        .groupBy("source_no", bucket)
        .agg(F.sum("size").alias("held"))
        .select("source_no", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("source_no", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        numbered(rows)
        .select("row", "size", "h", "source_no", "source_size", "target", "quota", bucket)
        .join(ranges, ["source_no", "bucket"])
        .withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    )
    draws = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(most - 1)),
            lambda k: F.struct(
                k.alias("pass"),
                (k * F.col("source_size") + F.col("start")).alias("place"),
                F.least("size", F.col("quota") - k * F.col("source_size") - F.col("start")).alias("words"),
            ),
        ),
        lambda draw: draw["words"] > 0,
    )
    columns = ["row", "source_no", "source_size", "target", "size", "start", "h"]
    drawn = placed.select(*columns, (F.explode_outer if undrawn else F.explode)(draws).alias("draw")).select(
        *columns, "draw.*", F.floor(F.col("draw.place") / block).cast("long").alias("block")
    )
    shards = _shards(spark, [-(-n // block) for n in words], blocks_per_shard, seed)
    return drawn.join(shards, ["source_no", "block"], "left" if undrawn else "inner").select(
        "row",
        "source_no",
        "source_size",
        "target",
        "size",
        "start",
        "pass",
        F.coalesce("words", F.lit(0).cast("long")).alias("words"),
        "shard",
        F.xxhash64(F.lit(seed), "shard", "h", "pass").alias("turn"),
    )


#: The order of the draws; equal turns are told apart by the place on the line of the source.
ORDER = ("shard", "turn", "source_no", "start", "pass")


def in_order(mixed: DataFrame, partitions: int) -> DataFrame:
    """The mix as it is written: every shard whole in one partition, its documents in their shuffled order."""
    return mixed.repartition(partitions, "shard").sortWithinPartitions(*ORDER)


def with_places(mixed: DataFrame) -> DataFrame:
    """``place``: where a draw stands in its shard, from 0; null for a document that is never drawn."""
    # Shards are of one size. Documents without a shard stay with those they are read with, and have no place.
    undrawn = F.col("shard").isNull()
    marked = mixed.withColumn("read_with", F.when(undrawn, F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("shard", "read_with").orderBy(*ORDER[1:])).cast("long") - 1
    return marked.withColumn("place", F.when(~undrawn, place)).drop("read_with")


def first_words(text: str, words: str):
    """Column: the first words of a text, joined by blanks."""
    parts = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda word: word != "")
    return F.array_join(F.slice(parts, F.lit(1), F.col(words).cast("int")), " ")


def taken(mixed: DataFrame) -> DataFrame:
    """One row per document of a mix with undrawn documents.

    ``row, size, source_size, target, taken``, and of each of its draws, in the order of the passes, the ``shard`` and
    the ``place`` in the shard.
    """
    draw = F.when(F.col("shard").isNotNull(), F.struct("pass", "shard", "place"))
    # A document with words is alone at its place; those without have one row each and are counted.
    grouped = with_places(mixed).groupBy("source_no", "start", "size", "row").agg(
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.sum("words").alias("taken"),
        F.sort_array(F.collect_list(draw)).alias("draws"),  # at most one a pass
        F.when(F.col("size") == 0, F.count("*")).otherwise(1).cast("int").alias("copies"),
    )
    return grouped.select(
        "row",
        "size",
        "source_size",
        "target",
        "taken",
        F.col("draws.shard").alias("shard"),
        F.col("draws.place").alias("place"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")
