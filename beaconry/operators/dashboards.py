"""Dashboard series over stored window documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What each panel shows of the windows that end in a time bucket.
PANEL_MEANS = ("throughput_per_min", "latency_p50", "latency_p95", "hit_rate", "retry_rate", "dlq_rate")
PANEL_PEAKS = ("count_success", "count_error")


def dashboard_rollup(documents: DataFrame, bucket: str = "5 minutes") -> DataFrame:
    """All five panels in one pass: means of rates and latencies, peaks of counts."""
    return (
        documents.groupBy(F.window("window_end", bucket).alias("bucket"))
        .agg(
            *[F.avg(name).alias(name) for name in PANEL_MEANS],
            *[F.max(name).alias(name) for name in PANEL_PEAKS],
        )
        .select(
            F.col("bucket.start").alias("bucket_start"),
            F.col("bucket.end").alias("bucket_end"),
            *PANEL_MEANS,
            *PANEL_PEAKS,
        )
    )


def dashboard_recent(documents: DataFrame, as_of: float, minutes: int = 30) -> DataFrame:
    """Documents of the last minutes before ``as_of`` (epoch seconds)."""
    now_us = round(as_of * 1e6)
    end = F.col("window_end")
    since = F.timestamp_micros(F.lit(now_us - minutes * 60_000_000))
    return documents.where((end > since) & (end <= F.timestamp_micros(F.lit(now_us))))
