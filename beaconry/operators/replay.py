"""Requests beside the cached answers that were valid at their time.

The answers are given (each a fill of its key), not simulated: what a request met
is the newest fill of its key at or before it, if that has not run out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions import ttl_seconds

# Length of the slices a key's history is cut into, so that no task holds a hot key whole.
SLICE_US = 10_000_000


def usable_entries(entries: DataFrame) -> DataFrame:
    """Cache entries (key, payload, ...) that can be served: those whose payload is a JSON value.

    A payload that does not parse, like an absent one or a JSON null, is a miss.
    """
    value = F.try_parse_json("payload")
    return entries.where(value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True)))


def replay_input(keyed: DataFrame) -> DataFrame:
    """Requests with ``cache_key`` in the form ``requests_to_fills`` takes; unkeyed ones are left out."""
    return keyed.where(F.col("cache_key").isNotNull()).select(
        "query_id",
        F.col("cache_key").alias("key"),
        (ttl_seconds(F.col("query_type")).cast("long") * 1_000_000).alias("ttl_us"),
        "created_us",
        "retry_count",
    )


def fills_of(routed: DataFrame) -> DataFrame:
    """The fills (key, fill_us) that routed attempts leave: their computed answers."""
    computed = routed.where((F.col("route") == "done") & ~F.col("cached"))
    return computed.select(F.col("cache_key").alias("key"), F.col("done_us").alias("fill_us"))


def _slice(at: str) -> Column:
    return F.floor(F.col(at) / F.lit(SLICE_US)).cast("long")


def requests_to_fills(requests: DataFrame, fills: DataFrame) -> DataFrame:
    """Every request with ``fill_us``, the newest fill of its key at or before ``created_us``.

    It is null where there is none, or where the newest one has run out: a request at
    ``fill_us + ttl_us`` or later. A ``ttl_us`` of zero or less never runs out. Where fills
    of a key overlap, the newest counts, whatever order the rows come in. Requests without
    a key have no fill.

    Running maxima within slices of a key's history, and over one row per slice for the
    fills before it: neither requests nor fills meet in pairs.
    """
    asked = requests.drop("fill_us").withColumns({"_at": F.col("created_us"), "_slice": _slice("created_us")})
    given = fills.where(F.col("key").isNotNull()).select(
        "key", "fill_us", F.col("fill_us").alias("_at"), _slice("fill_us").alias("_slice")
    )
    both = asked.withColumn("_asked", F.lit(True)).unionByName(given, allowMissingColumns=True)
    slices = both.groupBy("key", "_slice").agg(F.max("fill_us").alias("_newest"))
    before = Window.partitionBy("key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("key", "_slice", F.max("_newest").over(before).alias("_carried"))
    # The frame up to the current row takes in fills of the same time.
    within = Window.partitionBy("key", "_slice").orderBy("_at")
    seen = both.withColumn("_within", F.max("fill_us").over(within)).where("_asked")
    newest = F.coalesce("_within", "_carried")
    valid = (F.col("ttl_us") <= 0) | (F.col("created_us") < newest + F.col("ttl_us"))
    joined = seen.join(carried, ["key", "_slice"], "left").withColumn("fill_us", F.when(valid, newest))
    return joined.select(*[c for c in requests.columns if c != "fill_us"], "fill_us")
