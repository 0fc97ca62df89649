"""Request events: intake, normalisation, JSON encoding and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconry.functions import epoch_seconds_to_timestamp, iso_utc, query_type_name
from beaconry.schemas import METRIC_EVENT

# The events that answer a request, and those that give it up.
SUCCESS_EVENTS = ("hit", "miss", "recovery")
FAILURE_EVENTS = ("dlq", "error")


def accept_raw_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split an intake into accepted events and rejects (no ``event`` name)."""
    named = F.col("event").isNotNull()
    return events.where(named), events.where(~named)


def normalize_events(events: DataFrame, as_of: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw events to metric events.

    ``as_of`` (epoch seconds) stands in for a missing or zero ``ts``; without it
    the current time does. ``keep`` names extra input columns to carry along.
    """
    event = F.col("event")
    success = F.coalesce(event.isin(*SUCCESS_EVENTS), F.lit(False))
    failure = F.coalesce(event.isin(*FAILURE_EVENTS), F.lit(False))
    arrival = F.unix_micros(F.current_timestamp()) / 1e6 if as_of is None else F.lit(float(as_of))
    ts = F.coalesce(F.nullif(F.col("ts"), F.lit(0.0)), arrival)
    default_retries = F.when(event == "retry", 1).when(event == "dlq", None).otherwise(0)
    return events.select(
        *keep,
        ts.alias("ts"),
        iso_utc(epoch_seconds_to_timestamp(ts)).alias("timestamp"),
        event.alias("event_type"),
        query_type_name(F.col("query_type")).alias("query_type"),
        "latency_ms",
        F.when(success, event == "hit").alias("cache_hit"),
        F.coalesce(event == "recovery", F.lit(False)).alias("was_retried"),
        F.coalesce(event == "retry", F.lit(False)).alias("is_retry_event"),
        F.coalesce(F.col("retry_count"), default_retries).alias("retry_count"),
        F.when(success, "success").when(failure, "failed").otherwise("pending").alias("status"),
        "key",
    )


def encode_events(events: DataFrame) -> DataFrame:
    """Metric events as JSON messages, one per row in ``value``."""
    fields = [F.col(name) for name in METRIC_EVENT.fieldNames()]
    return events.select(F.to_json(F.struct(*fields)).alias("value"))


def decode_events(messages: DataFrame) -> DataFrame:
    """JSON messages to metric events with ``event_time``.

    A message that does not parse, or has no usable ``ts``, is dropped. Works on
    batch and streaming input alike.
    """
    return with_event_time(parse_json(messages, METRIC_EVENT))


def parse_json(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """The fields of JSON documents in ``value``; all null where one does not parse.

    The generator keeps later filters above it: pushed below a plain projection
    they would parse every message again.
    """
    return messages.select(F.inline(F.array(F.from_json(F.col("value").cast("string"), schema))))


def with_event_time(events: DataFrame) -> DataFrame:
    timed = events.withColumn("event_time", epoch_seconds_to_timestamp(F.col("ts")))
    return timed.where(F.col("event_time").isNotNull())


def success_latency() -> Column:
    """Latency of answered requests, null for everything else."""
    return F.when(F.col("status") == "success", F.col("latency_ms"))
