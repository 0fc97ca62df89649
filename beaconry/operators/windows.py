"""Event-time windows: counts, latency percentiles, rates, and the window document.

Every function takes metric events with ``event_time`` and works on a batch or
a streaming DataFrame, except the pane forms, which aggregate twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.functions import ratio
from beaconry.operators.events import success_latency
from beaconry.session import micros

SIZE = "1 minute"
SLIDE = "10 seconds"
WATERMARK = "30 seconds"

PERCENTILE_POINTS = {"latency_p50": 0.5, "latency_p95": 0.95, "latency_p99": 0.99}
PERCENTILE_ACCURACY = 10_000
# Rank error of a KLL sketch is about 1.65 / k: near that of PERCENTILE_ACCURACY.
SKETCH_K = 16_384


def _counters() -> dict[str, Column]:
    kind = F.col("event_type")
    return {
        "count_success": F.count_if(F.col("status") == "success"),
        "count_hit": F.count_if(F.col("cache_hit")),
        "count_miss": F.count_if(kind == "miss"),
        "count_recovery": F.count_if(kind == "recovery"),
        "count_retry": F.count_if(kind == "retry"),
        "count_dlq": F.count_if(kind == "dlq"),
        "count_error": F.count_if(kind == "error"),
        "count_events": F.count(F.lit(1)),
    }


def _percentile_sketch() -> Column:
    """All points from one sketch; a separate call per point would build three."""
    points = list(PERCENTILE_POINTS.values())
    return F.percentile_approx(success_latency(), points, PERCENTILE_ACCURACY)


def _named_percentiles(values: Column) -> list[Column]:
    return [values.getItem(i).alias(name) for i, name in enumerate(PERCENTILE_POINTS)]


def window_counts(events: DataFrame, size: str = SIZE, slide: str = SLIDE) -> DataFrame:
    counters = [c.alias(name) for name, c in _counters().items()]
    return events.groupBy(F.window("event_time", size, slide)).agg(*counters)


def window_latency(events: DataFrame, size: str = SIZE, slide: str = SLIDE) -> DataFrame:
    grouped = events.groupBy(F.window("event_time", size, slide)).agg(
        _percentile_sketch().alias("points"), F.avg(success_latency()).alias("latency_avg")
    )
    return grouped.select("window", *_named_percentiles(F.col("points")), "latency_avg")


def window_metrics(events: DataFrame, size: str = SIZE, slide: str = SLIDE) -> DataFrame:
    """The full document per window, in one aggregation."""
    counters = [c.alias(name) for name, c in _counters().items()]
    grouped = events.groupBy(F.window("event_time", size, slide)).agg(
        *counters,
        _percentile_sketch().alias("points"),
        F.avg(success_latency()).alias("latency_avg"),
    )
    return window_document(
        grouped.select("window", *_counters(), *_named_percentiles(F.col("points")), "latency_avg")
    )


def window_document(aggregated: DataFrame) -> DataFrame:
    """Window counts and latencies to the stored document with its rates."""
    start, end = F.col("window.start"), F.col("window.end")
    minutes = (F.unix_micros(end) - F.unix_micros(start)) / 60e6
    success, attempts = F.col("count_success"), F.col("count_success") + F.col("count_dlq")
    return aggregated.select(
        F.unix_seconds(start).cast("string").alias("window_id"),
        start.alias("window_start"),
        end.alias("window_end"),
        end.alias("@timestamp"),
        F.round(success / minutes, 2).alias("throughput_per_min"),
        *PERCENTILE_POINTS,
        "latency_avg",
        ratio(F.col("count_hit"), success).alias("hit_rate"),
        ratio(F.col("count_retry"), attempts).alias("retry_rate"),
        ratio(F.col("count_dlq"), attempts).alias("dlq_rate"),
        *_counters(),
    )


def _panes(events: DataFrame, size: str, slide: str) -> tuple[int, int, Column]:
    """Window width, slide, and the start of an event's pane: size and slide are whole numbers of panes."""
    width, step = micros(events.sparkSession, size, slide)
    length = math.gcd(width, step)
    at = F.unix_micros("event_time")
    return width, step, at - F.pmod(at, F.lit(length))


def _pane_to_windows(panes: DataFrame, width: int, step: int) -> DataFrame:
    """Each pane row once per window that contains it, with the window struct.

    Where the slide is longer than the window, panes between two windows are in none.
    """
    last = F.col("pane") - F.pmod("pane", F.lit(step))
    starts = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit((width - 1) // step)), lambda back: last - back * step),
        lambda start: start + width > F.col("pane"),
    )
    start = F.col("start_us")
    window = F.struct(
        F.timestamp_micros(start).alias("start"), F.timestamp_micros(start + width).alias("end")
    )
    return panes.select("*", F.explode(starts).alias("start_us")).withColumn("window", window)


def window_counts_panes(events: DataFrame, size: str = SIZE, slide: str = SLIDE) -> DataFrame:
    """Same result as ``window_counts``, without multiplying the events.

    Events are counted once per pane; only the pane rows, whose
    number depends on time and not on traffic, are spread over the windows.
    """
    width, step, pane = _panes(events, size, slide)
    counters = [c.alias(name) for name, c in _counters().items()]
    panes = events.groupBy(pane.alias("pane")).agg(*counters)
    sums = [F.sum(name).alias(name) for name in _counters()]
    return _pane_to_windows(panes, width, step).groupBy("window").agg(*sums)


def window_metrics_panes(events: DataFrame, size: str = SIZE, slide: str = SLIDE) -> DataFrame:
    """The window document from panes: the plan for batches over long histories.

    Percentiles come from KLL sketches, which merge across panes; they are exact
    up to a few thousand latencies per window and within about 1e-4 in rank beyond.
    """
    width, step, pane = _panes(events, size, slide)
    panes = events.groupBy(pane.alias("pane")).agg(*pane_columns())
    return merged_document(_pane_to_windows(panes, width, step).groupBy("window").agg(*merged_columns()))


def pane_columns() -> list[Column]:
    """Aggregates of the events of a pane, which merge into those of a window."""
    latency = success_latency()
    return [
        *[c.alias(name) for name, c in _counters().items()],
        F.sum(latency).alias("latency_sum"),
        F.count(latency).alias("latency_n"),
        F.kll_sketch_agg_double(latency, F.lit(SKETCH_K)).alias("sketch"),
    ]


def merged_columns() -> list[Column]:
    return [
        *[F.sum(name).alias(name) for name in _counters()],
        F.sum("latency_sum").alias("latency_sum"),
        F.sum("latency_n").alias("latency_n"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"),
    ]


def merged_document(windows: DataFrame) -> DataFrame:
    """The window document from merged panes."""
    some = F.col("latency_n") > 0
    points = F.array(*[F.lit(p) for p in PERCENTILE_POINTS.values()])
    values = F.when(some, F.kll_sketch_get_quantile_double("sketch", points))
    return window_document(
        windows.select(
            "window",
            *_counters(),
            *_named_percentiles(values),
            F.when(some, F.col("latency_sum") / F.col("latency_n")).alias("latency_avg"),
        )
    )


def pane_length(spark: SparkSession, size: str, slide: str) -> str:
    """The longest interval that window and slide are whole numbers of."""
    return f"{math.gcd(*micros(spark, size, slide))} microseconds"
