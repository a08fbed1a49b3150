"""Connected components of a table of links, by rounds of star operations on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpointed


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(links: DataFrame, both: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours (larger: those above it, else those below) hang on the node's least neighbour or itself."""
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
    side = both.filter("b > a") if larger else both.filter("b < a")
    hung = side.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    if not larger:
        hung = hung.union(least.select("a", F.col("root").alias("b")))
    return hung.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node that a row (a, b) of `links` names. Loops and repeats do no
    harm; an empty table gives an empty one."""
    links = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                         .filter("a <> b").distinct())
    seen = _digest(links)
    while seen[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        wide = _star(links, both, larger=True)
        links = checkpointed(_star(wide, wide, larger=False))
        now = _digest(links)
        if now == seen:
            break
        seen = now
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
