"""Connected components by alternating large and small stars; only tables in the shared folder hold the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(links: DataFrame) -> DataFrame:
    """Each neighbour larger than a node is linked to the least of the node and its neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these. links: a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    others = links.join(least, "b").select("m", F.col("a").alias("b")).unionByName(least.select("m", "b"))
    return others.select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and top (the least node of its component) for each node of links (a, b).

    Each round at least halves the longest chains; it ends when neither star changes a link.
    """
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = _mark(links)
    for _ in range(rounds):
        links = written(_small(_large(links)), "links")
        after = _mark(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components: {rounds} rounds were not enough")
    return links.select(F.col("b").alias("node"), F.col("a").alias("top")).unionByName(links.select("a", F.col("a").alias("top")).distinct().withColumnRenamed("a", "node"))


def _mark(links: DataFrame) -> tuple:
    """A sum over the set of links: two counters, whatever their number."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
