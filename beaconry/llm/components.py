"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.session import materialize


def _sum(links: DataFrame) -> tuple:
    """Tells two sets of links apart."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached from each node of ``links`` (a, b).

    Large and small stars in turn, until nothing changes: the number of rounds
    grows with the logarithm of the longest path. Every round is one join on a
    node with adaptive splitting of hot nodes, and is written to the shared
    folder. A link may repeat, and may lead from a node to itself; rows with a
    null end are left out. No links give no rows.
    """
    links = links.select("a", "b").where("a is not null and b is not null").distinct()
    links = materialize(links, "links")
    before = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        large = both.join(least, "a").where("b >= a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        down = large.union(least.select("a", F.col("least").alias("b"))).select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        links = materialize(small.union(least.select("a", F.col("least").alias("b"))).distinct(), "links")
        after = _sum(links)
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after
