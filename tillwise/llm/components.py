"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join. A node with very many links is combined before the shuffle in the
grouping, and its join partition is one that adaptive execution may split. Links are written to the shared folder
after each round, so a lost executor never repeats earlier rounds. The number of rounds is logarithmic in the size
of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillwise.sources.staging import stage


def _minimum_link(links: DataFrame) -> DataFrame:
    """For each node ``u``, the smallest of itself and its neighbours ``v``."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_minimum_link(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` point from the larger to the smaller node."""
    joined = links.join(_minimum_link(links), "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node in the links ``(u, v)`` of longs; the root is the smallest node reachable.

    Nodes without a link, links to itself and repeated links need no care: the first two give no row, the last none
    more. An empty link table gives an empty result.
    """
    state = lambda frame: tuple(
        frame.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
    )
    now = stage(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links"
    )
    before, after = None, state(now)
    while after[0] and after != before:
        now = stage(_small_star(_large_star(now)), "links")
        before, after = after, state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
