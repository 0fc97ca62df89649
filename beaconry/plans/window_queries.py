"""Queries on events: normalisation, windows and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.operators import dashboards, events, windows
from beaconry.plans import inputs
from beaconry.plans.shape import open_window, plain, rounded
from beaconry.session import scratch_path
from beaconry.sources import tables


def normalize_events(spark, sf_dir):
    return events.normalize_events(inputs.raw_events(spark, sf_dir), as_of=inputs.END_SECONDS)


def raw_event_intake(spark, sf_dir):
    """Raw events written as JSON lines, taken in, and split from what has no event."""
    folder = scratch_path(spark, "intake")
    rows = inputs.raw_events(spark, sf_dir).select("event", "query_type", "key", "latency_ms", "retry_count", "ts")
    unnamed = rows.select(F.lit(None).cast("string").alias("event"), *rows.columns[1:]).limit(5)
    rows.union(unnamed).write.json(folder)
    accepted, _ = events.accept_raw_events(tables.read_raw_events(spark, folder))
    return accepted.select(*rows.columns)


def decode_events(spark, sf_dir):
    return plain(events.decode_events(events.encode_events(normalize_events(spark, sf_dir))))


def window_counts(spark, sf_dir):
    return plain(open_window(windows.window_counts(inputs.metric_events(spark, sf_dir))))


def window_counts_panes(spark, sf_dir):
    return plain(open_window(windows.window_counts_panes(inputs.metric_events(spark, sf_dir))))


def window_latency(spark, sf_dir):
    return rounded(plain(open_window(windows.window_latency(inputs.metric_events(spark, sf_dir)))), latency_avg=9)


def window_metrics(spark, sf_dir):
    return rounded(plain(windows.window_metrics(inputs.metric_events(spark, sf_dir))), latency_avg=9)


def _documents(spark, sf_dir):
    return rounded(windows.window_metrics_panes(inputs.metric_events(spark, sf_dir)), latency_avg=9)


def window_metrics_panes(spark, sf_dir):
    return rounded(plain(windows.window_metrics_panes(inputs.metric_events(spark, sf_dir))), latency_avg=9)


def tumbling_window_metrics(spark, sf_dir):
    tumbling = windows.window_metrics(inputs.metric_events(spark, sf_dir), slide=windows.SIZE)
    return rounded(plain(tumbling), latency_avg=9)


def dashboard_rollup(spark, sf_dir):
    series = dashboards.dashboard_rollup(_documents(spark, sf_dir))
    return rounded(plain(series), **{name: 9 for name in dashboards.PANEL_MEANS})


def dashboard_recent(spark, sf_dir):
    return plain(dashboards.dashboard_recent(_documents(spark, sf_dir), inputs.END_SECONDS))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_events,
        raw_event_intake,
        decode_events,
        window_counts,
        window_counts_panes,
        window_latency,
        window_metrics,
        window_metrics_panes,
        tumbling_window_metrics,
        dashboard_rollup,
        dashboard_recent,
    )
}
