"""Declared schemas. Nothing in this package infers a schema from data."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


RAW_EVENT = T.StructType(
    [T.StructField("event", T.StringType(), False)]
    + _struct(
        ("query_type", T.StringType()),
        ("key", T.StringType()),
        ("latency_ms", T.DoubleType()),
        ("lookup_ms", T.DoubleType()),
        ("compute_ms", T.DoubleType()),
        ("ttl", T.IntegerType()),
        ("error", T.StringType()),
        ("retry_count", T.IntegerType()),
        ("ts", T.DoubleType()),
    ).fields
)

METRIC_EVENT = _struct(
    ("ts", T.DoubleType()),
    ("timestamp", T.StringType()),
    ("event_type", T.StringType()),
    ("query_type", T.StringType()),
    ("latency_ms", T.DoubleType()),
    ("cache_hit", T.BooleanType()),
    ("was_retried", T.BooleanType()),
    ("is_retry_event", T.BooleanType()),
    ("retry_count", T.IntegerType()),
    ("status", T.StringType()),
    ("key", T.StringType()),
)

BUILDING = _struct(
    ("latitude", T.DoubleType()),
    ("longitude", T.DoubleType()),
    ("area_in_meters", T.DoubleType()),
    ("confidence", T.DoubleType()),
)

ZONE = T.StructType(
    [T.StructField("zone_id", T.StringType(), False)]
    + _struct(
        ("name", T.StringType()),
        ("lat_min", T.DoubleType()),
        ("lat_max", T.DoubleType()),
        ("lon_min", T.DoubleType()),
        ("lon_max", T.DoubleType()),
    ).fields
)

REQUEST_PARAMS = _struct(
    ("zone_id", T.StringType()),
    ("zone_a", T.StringType()),
    ("zone_b", T.StringType()),
    ("confidence_min", T.DoubleType()),
    ("bins", T.IntegerType()),
)

ATTEMPT = _struct(
    ("query_id", T.LongType()),
    ("query_type", T.StringType()),
    ("params", REQUEST_PARAMS),
    ("retry_count", T.IntegerType()),
    ("created_us", T.LongType()),
    ("done_us", T.LongType()),
    ("mode", T.StringType()),
    ("cached", T.BooleanType()),
    ("failed", T.BooleanType()),
    ("error", T.StringType()),
    ("lookup_ms", T.DoubleType()),
    ("compute_ms", T.DoubleType()),
)

# The window document as the sink stores it; window_id is its key.
WINDOW_DOCUMENT = _struct(
    ("window_id", T.StringType()),
    ("window_start", T.TimestampType()),
    ("window_end", T.TimestampType()),
    ("@timestamp", T.TimestampType()),
    ("throughput_per_min", T.DoubleType()),
    ("latency_p50", T.DoubleType()),
    ("latency_p95", T.DoubleType()),
    ("latency_p99", T.DoubleType()),
    ("latency_avg", T.DoubleType()),
    ("hit_rate", T.DoubleType()),
    ("retry_rate", T.DoubleType()),
    ("dlq_rate", T.DoubleType()),
    ("count_success", T.LongType()),
    ("count_hit", T.LongType()),
    ("count_miss", T.LongType()),
    ("count_recovery", T.LongType()),
    ("count_retry", T.LongType()),
    ("count_dlq", T.LongType()),
    ("count_error", T.LongType()),
    ("count_events", T.LongType()),
)

PERCENTILES = _struct(
    ("p50", T.DoubleType()), ("p95", T.DoubleType()), ("p99", T.DoubleType())
)

BACKLOG_POINT = _struct(("time_offset", T.DoubleType()), ("backlog", T.LongType()))

QUERY_TYPE_SUMMARY = _struct(
    ("hits", T.LongType()),
    ("misses", T.LongType()),
    ("recoveries", T.LongType()),
    ("retries", T.LongType()),
    ("dlq", T.LongType()),
    ("total", T.LongType()),
    ("hit_rate", T.DoubleType()),
    ("p50_ms", T.DoubleType()),
    ("p95_ms", T.DoubleType()),
    ("p99_ms", T.DoubleType()),
)

SNAPSHOT = _struct(
    ("label", T.StringType()),
    ("snapshot_ts", T.DoubleType()),
    ("elapsed_sec", T.DoubleType()),
    (
        "totals",
        _struct(
            ("hits", T.LongType()),
            ("misses", T.LongType()),
            ("recoveries", T.LongType()),
            ("retries", T.LongType()),
            ("dlq", T.LongType()),
            ("errors", T.LongType()),
            ("total_requests", T.LongType()),
        ),
    ),
    ("hit_rate", T.DoubleType()),
    ("miss_rate", T.DoubleType()),
    ("retry_rate", T.DoubleType()),
    ("recovery_rate", T.DoubleType()),
    ("dlq_rate", T.DoubleType()),
    ("backlog_size", T.LongType()),
    ("throughput_qps_total", T.DoubleType()),
    ("throughput_qps_recent_10s", T.DoubleType()),
    ("latency_ms_hit", PERCENTILES),
    ("latency_ms_miss", PERCENTILES),
    ("latency_ms_recovery", PERCENTILES),
    ("latency_ms_all", PERCENTILES),
    ("mean_t_cache_ms", T.DoubleType()),
    ("mean_t_db_ms", T.DoubleType()),
    ("cache_efficiency", T.DoubleType()),
    (
        "eviction",
        _struct(("total_evicted", T.LongType()), ("rate_per_min", T.DoubleType())),
    ),
    ("by_query", T.MapType(T.StringType(), QUERY_TYPE_SUMMARY)),
    (
        "extra",
        _struct(
            ("use_kafka", T.BooleanType()),
            ("scale", T.IntegerType()),
            ("simulated_failure", T.BooleanType()),
            ("description", T.StringType()),
            ("spike_start_time", T.DoubleType()),
            ("spike_end_time", T.DoubleType()),
            ("backlog_history", T.ArrayType(BACKLOG_POINT)),
        ),
    ),
)

CACHE_STATS = _struct(
    ("policy", T.StringType()),
    ("used_memory", T.LongType()),
    ("used_memory_human", T.StringType()),
    ("maxmemory", T.LongType()),
    ("n_keys", T.LongType()),
    ("evicted_keys", T.LongType()),
    ("keyspace_hits", T.LongType()),
    ("keyspace_misses", T.LongType()),
    ("sample_us", T.LongType()),
)

CONSUMER_OFFSETS = _struct(
    ("topic", T.StringType()),
    ("partition", T.IntegerType()),
    ("end_offset", T.LongType()),
    ("committed", T.LongType()),
)
