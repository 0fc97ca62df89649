"""Inputs of the registered queries, derived from the given parquet tables.

Each view covers its whole source table. ``plans/checks.py`` writes the same
arithmetic in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.functions import box_area_km2
from beaconry.operators.events import normalize_events, with_event_time
from beaconry.operators.zones import zone_table
from beaconry.session import prepare

# 2024-01-01T00:00:00Z, the first day of the events table.
BASE_US = 1_704_067_200_000_000
BASE_SECONDS = BASE_US / 1e6
# Events span 30 days; compressed a thousand times they span 43.2 minutes.
END_US = BASE_US + 30 * 86_400_000
END_SECONDS = END_US / 1e6

THRESHOLDS = (0.0, 0.5, 0.7, 0.9, 1.0)
BIN_COUNTS = (3, 5, 10, 20)
# Bin counts a request may ask for.
REQUEST_BINS = (3, 4, 5, 6, 8, 10, 12, 15, 20)


# Declared, so that reading a table does not start with a job over its file footers.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_extendedprice double, l_discount double",
    "orders": "o_orderkey bigint, o_custkey bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _pick(index: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = table(spark, sf_dir, "events")
    kind, user, seq = F.col("event_type"), F.col("user_id"), F.col("event_id")
    native_us = _micros(F.col("ts"))
    ts_us = F.lit(BASE_US) + F.floor((native_us - BASE_US) / 1000).cast("long")
    return src.select(
        seq.alias("seq"),
        F.when(kind == "view", "hit")
        .when(kind == "click", "miss")
        .when(kind == "signup", "recovery")
        .when(kind == "purchase", "retry")
        .when(user % 2 == 0, "dlq")
        .otherwise("error")
        .alias("event"),
        F.when(user % 6 != 0, F.concat(F.lit("q"), (user % 6).cast("string"))).alias("query_type"),
        F.when(kind.isin("view", "click", "signup"), F.col("value")).alias("latency_ms"),
        F.when(kind == "signup", 1 + seq % 3)
        .when((kind == "error") & (user % 2 == 0), 3)
        .when((kind == "purchase") & (seq % 2 == 0), seq % 3)
        .cast("int")
        .alias("retry_count"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("key"),
        ts_us.alias("ts_us"),
        (ts_us / 1e6).alias("ts"),
        F.concat(F.lit("s"), (user % 8).cast("string")).alias("label"),
        (user % 8).cast("int").alias("run_no"),
        F.floor((native_us - BASE_US) / 3_600_000_000).cast("double").alias("hour"),
    )


def metric_events(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return with_event_time(normalize_events(raw_events(spark, sf_dir), as_of=END_SECONDS, keep=keep))


def zones(spark: SparkSession) -> DataFrame:
    return zone_table(prepare(spark))


def zones_with_area(spark: SparkSession) -> DataFrame:
    return zones(spark).withColumn("area_km2", box_area_km2(*map(F.col, ("lat_min", "lat_max", "lon_min", "lon_max"))))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        (F.lit(-33.55) + (F.col("l_orderkey") % 1000) * F.lit(0.00017)).alias("latitude"),
        (F.lit(-70.82) + ((F.col("l_partkey") * 37) % 1000) * F.lit(0.00029)).alias("longitude"),
        (F.col("l_extendedprice") / 20).alias("area_in_meters"),
        (F.col("l_discount") * 10).alias("confidence"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    zone = (
        F.when(order % 89 == 0, "ZX")
        .when(order % 83 == 0, None)
        .otherwise(F.concat(F.lit("Z"), (1 + customer % 5).cast("string")))
    )
    return table(spark, sf_dir, "orders").select(
        order.alias("query_id"),
        F.when(order % 97 == 0, "Q9")
        .otherwise(F.concat(F.lit("q"), (1 + order % 5).cast("string")))
        .alias("query_type"),
        F.struct(
            zone.alias("zone_id"),
            zone.alias("zone_a"),
            F.concat(F.lit("Z"), (1 + (customer + 1 + order % 4) % 5).cast("string")).alias("zone_b"),
            F.when(order % 79 != 0, (order % 21) / F.lit(20.0)).alias("confidence_min"),
            F.when(order % 73 != 0, _pick(order % 9, REQUEST_BINS)).alias("bins"),
        ).alias("params"),
        (F.lit(BASE_US) + order * 100_000).alias("created_us"),
        (customer % 4).cast("int").alias("retry_count"),
        (order % 11 == 0).alias("failed"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the outcome of one attempt at answering them."""
    order = F.col("query_id")
    return requests(spark, sf_dir).select(
        "query_id",
        "query_type",
        "params",
        "retry_count",
        "created_us",
        (F.col("created_us") + 40_000 + (order % 50) * 1_000).alias("done_us"),
        F.when(order % 13 == 0, "sync").otherwise("queue").alias("mode"),
        (order % 3 == 0).alias("cached"),
        "failed",
        F.when(F.col("failed"), "503 service unavailable").alias("error"),
        ((order % 7) / F.lit(4.0)).alias("lookup_ms"),
        (30.0 + order % 90).alias("compute_ms"),
    )


def consumer_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End offsets (one row per partition) with the committed ones, some absent."""
    per_partition = (
        table(spark, sf_dir, "events")
        .groupBy(
            _pick(F.col("event_id") % 3, ("queries", "retry-queries", "dlq-queries")).alias("topic"),
            (F.col("user_id") % 3).cast("int").alias("partition"),
        )
        .agg(F.count(F.lit(1)).alias("end_offset"), F.count_if(F.col("value") < 40).alias("seen"))
    )
    absent = (F.col("topic") == "retry-queries") & (F.col("partition") == 2)
    ahead = (F.col("topic") == "queries") & (F.col("partition") == 1)
    committed = F.when(absent, None).when(ahead, F.col("end_offset") + 5).otherwise(F.col("seen"))
    return per_partition.select("topic", "partition", "end_offset", committed.alias("committed"))


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per day; evicted keys so far = errors up to the end of that day."""
    from pyspark.sql import Window

    days = (
        table(spark, sf_dir, "events")
        .groupBy(F.floor((_micros(F.col("ts")) - BASE_US) / 86_400_000_000).cast("long").alias("day"))
        .agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    )
    # Runs over one row per calendar day, not over events.
    so_far = Window.partitionBy("policy").orderBy("day")
    return days.withColumn("policy", F.lit("LRU")).select(
        "policy",
        (F.lit(BASE_US) + (F.col("day") + 1) * 86_400_000_000).alias("sample_us"),
        F.sum("errors").over(so_far).alias("evicted_keys"),
    )


def run_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End and committed offsets of each run's topics."""
    rows = table(spark, sf_dir, "events")
    return rows.groupBy(
        F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string")).alias("label"),
        _pick(F.col("event_id") % 3, ("queries", "retry-queries", "dlq-queries")).alias("topic"),
        (F.col("user_id") % 3).cast("int").alias("partition"),
    ).agg(F.count(F.lit(1)).alias("end_offset"), F.count_if(F.col("value") < 40).alias("committed"))


def run_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per run and day; evicted keys so far = errors of the run up to the end of that day."""
    from pyspark.sql import Window

    days = raw_events(spark, sf_dir).groupBy("label", F.floor(F.col("hour") / 24).cast("long").alias("day")).agg(
        F.count_if(F.col("event").isin("dlq", "error")).alias("errors")
    )
    # Runs over one row per run and calendar day, not over events.
    so_far = Window.partitionBy("label").orderBy("day")
    return days.select(
        "label",
        (F.lit(BASE_US) + (F.col("day") + 1) * 86_400_000_000).alias("sample_us"),
        F.sum("errors").over(so_far).alias("evicted_keys"),
    )


def backlog_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backlog per run label and hour of the range."""
    rows = raw_events(spark, sf_dir)
    backlog = F.count_if(F.col("event") == "retry") - F.count_if(F.col("event") == "hit")
    return rows.groupBy("label", F.col("hour").alias("time_offset")).agg(
        F.greatest(F.lit(0), backlog).cast("long").alias("backlog")
    )


def backlog_phases(spark: SparkSession) -> DataFrame:
    """An outage and a load spike, in seconds from the start of a run."""
    return prepare(spark).createDataFrame(
        [("outage", 30.0, 60.0), ("spike", 35.0, 50.0)], "phase string, phase_start double, phase_end double"
    )
