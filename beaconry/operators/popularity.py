"""How often items are asked for, against a Zipf and a uniform law."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zipf_weights(items: DataFrame, s: float = 1.2) -> DataFrame:
    """Normalised Zipf and uniform probabilities for items with a given ``rank`` (1, 2, ...)."""
    weight = F.pow(F.col("rank").cast("double"), F.lit(-float(s)))
    mass = items.agg(F.sum(weight)).scalar()
    size = items.agg(F.count(F.lit(1))).scalar()
    return items.select("*", (weight / mass).alias("zipf_share"), (F.lit(1.0) / size).alias("uniform_share"))


def popularity_profile(counts: DataFrame, item: str, n: str = "n", s: float = 1.2) -> DataFrame:
    """Items by rank, with their observed share beside the Zipf and the uniform one.

    ``counts`` has one row per item. The rank goes by count, equal counts by a
    hash of the item. Ranks come from the number of items per (count, hash
    prefix), so items with the same count never meet in one task.
    """
    hashed = counts.select(F.col(item).alias("item"), F.col(n).alias("n"), F.md5(item).alias("_hash"))
    prefixed = hashed.withColumn("_prefix", F.substring("_hash", 1, 3))
    groups = prefixed.groupBy("n", "_prefix").agg(F.count(F.lit(1)).alias("_items"))
    # One row per distinct count: about the square root of the total at most.
    higher = Window.partitionBy(F.lit(0)).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        groups.groupBy("n")
        .agg(F.sum("_items").alias("_level_items"))
        .select("n", F.coalesce(F.sum("_level_items").over(higher), F.lit(0)).alias("_above"))
    )
    earlier = Window.partitionBy("n").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select(
        "n", "_prefix", F.coalesce(F.sum("_items").over(earlier), F.lit(0)).alias("_before")
    ).join(levels, "n")
    within = Window.partitionBy("n", "_prefix").orderBy("_hash", "item")
    ranked = (
        prefixed.withColumn("_row", F.row_number().over(within))
        .join(offsets, ["n", "_prefix"])
        .select("item", "n", (F.col("_above") + F.col("_before") + F.col("_row")).alias("rank"))
    )
    total = counts.agg(F.sum(n)).scalar()
    return zipf_weights(ranked.withColumn("observed_share", F.col("n") / total), s)
