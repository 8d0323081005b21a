"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.llm.store import stage

MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Tie the larger neighbours of each node to the least node it sees."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Tie the smaller neighbours of each node, and itself, to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _clean(links: DataFrame) -> DataFrame:
    """Distinct links from the larger node to the smaller."""
    return (
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): the root is the least node that links reach.

    Both columns are numbers. Each round is a join and an aggregation with a
    partial step, so a node with many links is spread; its result is stored, and
    the rounds end when one changes nothing. The number of rounds grows with the
    logarithm of the longest chain.
    """
    links = stage(_clean(links.select("a", "b")), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        links = stage(_small_star(_clean(_large_star(links))).distinct(), "links")
    else:
        raise RuntimeError(f"links have not settled in {MAX_ROUNDS} rounds")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
