"""Requests beside the cached answers valid at their time, as both arrive.

A left outer interval join of two streams, then the newest fill of each request. State is kept no longer than
an answer may live, behind the watermark of both sides. Both sides meet by key and stretch of time, so that a row is not compared
with all that the state holds of its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from beaconry.session import micros
from beaconry.streaming.jobs import TRIGGER, state_partitions

REQUEST = "query_id long, key string, ttl_us long, created_us long"
FILL = "key string, fill_us long"
# The longest time an answer may be served, which bounds the state.
LONGEST_TTL = "10 minutes"


def requests_to_fills_stream(
    requests: DataFrame, fills: DataFrame, watermark: str = "30 seconds", longest_ttl: str = LONGEST_TTL
) -> DataFrame:
    """Every request (query_id, key, ttl_us, created_us) once, with ``fill_us``: the newest fill of its key at or
    before it, null if there is none or it has run out. Written when no earlier fill can come any more (append mode).

    Query ids tell requests apart. A ``ttl_us`` must be above zero; one beyond ``longest_ttl`` counts as that. Requests without a key
    have no fill. Rows without a time are dropped.
    """
    # An answer is valid in the stretch of its fill and in the next one at most.
    width = max(1, micros(requests.sparkSession, longest_ttl)[0])
    first = F.expr(f"fill_us div {width}")
    asked = requests.select(
        "query_id",
        "key",
        "ttl_us",
        "created_us",
        F.timestamp_micros("created_us").alias("asked_at"),
        F.expr(f"created_us div {width}").alias("stretch"),
    ).where("asked_at is not null")
    given = fills.select(
        F.col("key").alias("fill_key"),
        "fill_us",
        F.timestamp_micros("fill_us").alias("filled_at"),
        F.explode(F.array(first, first + 1)).alias("fill_stretch"),
    ).where("filled_at is not null")
    asked, given = asked.withWatermark("asked_at", watermark), given.withWatermark("filled_at", watermark)
    valid = (
        (F.col("key") == F.col("fill_key"))
        & (F.col("stretch") == F.col("fill_stretch"))
        & (F.col("filled_at") <= F.col("asked_at"))
        & (F.col("filled_at") > F.col("asked_at") - F.expr(f"INTERVAL '{longest_ttl}'"))
        & (F.col("created_us") < F.col("fill_us") + F.col("ttl_us"))
    )
    joined = asked.join(given, valid, "leftOuter")
    newest = joined.groupBy("asked_at", "query_id", "key", "ttl_us", "created_us").agg(F.max("fill_us").alias("fill_us"))
    return newest.select("query_id", "key", "ttl_us", "created_us", "fill_us")


def start_fills_job(
    requests: DataFrame,
    fills: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    partitions: int | None = None,
    **options: str,
) -> StreamingQuery:
    """Served requests to a folder of parquet files."""
    served = requests_to_fills_stream(requests, fills, **options)
    with state_partitions(requests.sparkSession, partitions):
        return (
            served.writeStream.outputMode("append")
            .format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or TRIGGER))
            .start()
        )
