"""Zone requests: keys, validation, and what follows from an attempt to answer one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions import cache_key, can_be_keyed, ttl_seconds
from beaconry.operators.sizes import dimension
from beaconry.schemas import REQUEST_PARAMS

# Attempts after the first one, and the topics of failed requests.
MAX_RETRIES = 3
RETRY_TOPIC = "retry-queries"
DEAD_LETTER_TOPIC = "dlq-queries"

QUERY_TYPES = ("Q1", "Q2", "Q3", "Q4", "Q5")
DEFAULT_CONFIDENCE = 0.0
DEFAULT_BINS = 5


def param(name: str) -> Column:
    return F.col(f"params.{name}")


def _params() -> dict[str, Column]:
    return {name: param(name) for name in REQUEST_PARAMS.fieldNames()}


def with_cache_key(requests: DataFrame) -> DataFrame:
    """Adds ``cache_key``; null where the request cannot be keyed."""
    return requests.withColumn("cache_key", cache_key(F.col("query_type"), _params()))


def validate_requests(requests: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds ``error_reason``: why a request cannot be answered, null if it can."""
    kind = F.upper("query_type")
    known = F.coalesce(kind.isin(*QUERY_TYPES), F.lit(False))
    pair = kind == "Q4"
    asked = requests.withColumns(
        {
            "_first": F.when(pair, param("zone_a")).otherwise(param("zone_id")),
            "_second": F.when(pair, param("zone_b")),
        }
    )
    names = dimension(zones.select("zone_id"))
    joined = asked.join(
        names.select(F.col("zone_id").alias("_first"), F.lit(True).alias("_has_first")), "_first", "left"
    ).join(names.select(F.col("zone_id").alias("_second"), F.lit(True).alias("_has_second")), "_second", "left")
    missing = F.col("_first").isNull() | (pair & F.col("_second").isNull())
    unknown_zone = F.col("_has_first").isNull() | (pair & F.col("_has_second").isNull())
    reason = (
        F.when(~known, "unknown_query_type")
        .when(missing, "missing_parameter")
        .when(unknown_zone, "unknown_zone")
        .when((kind == "Q5") & (param("bins") < 1), "invalid_bins")
    )
    return joined.withColumn("error_reason", reason).drop("_first", "_second", "_has_first", "_has_second")


def route_attempts(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """What becomes of each attempt: its route, its event, and the message it sends on.

    On the queue a failure goes to the retry topic until the retries are used
    up, then to the dead-letter topic; a request that cannot be keyed is dropped.
    Synchronous requests are answered, rejected or fail on the spot.
    """
    keyed = with_cache_key(attempts)
    queued = F.col("mode") == "queue"
    unkeyed = ~can_be_keyed(F.col("query_type"), _params())
    answered = F.col("cached") | ~F.col("failed")
    may_retry = F.col("retry_count") < max_retries
    route = (
        F.when(unkeyed & queued, "dropped")
        .when(unkeyed, "rejected")
        .when(answered, "done")
        .when(~queued, "failed")
        .when(may_retry, "retry")
        .otherwise("dlq")
    )
    routed = keyed.withColumn("route", route)
    done, retry, dead = (F.col("route") == r for r in ("done", "retry", "dlq"))
    event = (
        F.when(done & queued & (F.col("retry_count") > 0), "recovery")
        .when(done & F.col("cached"), "hit")
        .when(done, "miss")
        .when(F.col("route") == "failed", "error")
        .when(retry | dead, F.col("route"))
    )
    return routed.withColumns(
        {
            "event": event,
            "topic": F.when(retry, RETRY_TOPIC).when(dead, DEAD_LETTER_TOPIC),
            "next_retry_count": F.when(retry, F.col("retry_count") + 1).when(dead, F.col("retry_count")),
            "latency_ms": F.when(done, (F.col("done_us") - F.col("created_us")) / 1000.0),
            "ttl": F.when(done & ~F.col("cached"), ttl_seconds(F.col("query_type"))),
            "failed_us": F.when(dead, F.col("done_us")),
        }
    )


def retry_messages(routed: DataFrame) -> DataFrame:
    """The requests to try again, with their new retry count."""
    again = routed.where(F.col("topic") == RETRY_TOPIC)
    return again.select(
        "query_id", "query_type", "params", F.col("next_retry_count").alias("retry_count"), "created_us"
    )


def dead_letters(routed: DataFrame) -> DataFrame:
    """The requests given up, with the time and the reason."""
    dead = routed.where(F.col("topic") == DEAD_LETTER_TOPIC)
    return dead.select("query_id", "query_type", "params", "retry_count", "created_us", "failed_us", "error")


def attempt_events(routed: DataFrame) -> DataFrame:
    """The raw event each attempt reports; an answer tells how long the look-up took, a computed one the computing too."""
    return routed.where(F.col("event").isNotNull()).select(
        "event",
        F.upper("query_type").alias("query_type"),
        F.col("cache_key").alias("key"),
        "latency_ms",
        F.when(F.col("route") == "done", F.col("lookup_ms")).alias("lookup_ms"),
        F.when((F.col("route") == "done") & ~F.col("cached"), F.col("compute_ms")).alias("compute_ms"),
        "ttl",
        F.when(~F.col("route").isin("done"), F.col("error")).alias("error"),
        F.when(F.col("mode") == "queue", F.col("retry_count")).alias("retry_count"),
        (F.col("done_us") / 1e6).alias("ts"),
    )
