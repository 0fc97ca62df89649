"""Queries that summarise whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.operators import history, popularity, summary
from beaconry.operators.events import SUCCESS_EVENTS
from beaconry.plans import inputs
from beaconry.plans.shape import rounded


def _events(spark, sf_dir):
    return inputs.metric_events(spark, sf_dir, keep=("seq", "ts_us"))


def _answered(spark, sf_dir):
    return _events(spark, sf_dir).where(F.col("status") == "success")


def event_counters(spark, sf_dir):
    return summary.event_counters(_events(spark, sf_dir))


def run_summary(spark, sf_dir):
    return summary.run_summary(_events(spark, sf_dir))


def summary_latency(spark, sf_dir):
    return summary.summary_latency(_events(spark, sf_dir))


def last_n_per_class(spark, sf_dir):
    columns = _answered(spark, sf_dir).select("seq", "event_type", "query_type", "latency_ms")
    return history.last_n_per_class(columns, 500, "event_type", SUCCESS_EVENTS).select(
        "seq", "event_type", "query_type", "latency_ms"
    )


def throughput(spark, sf_dir):
    return summary.throughput(_events(spark, sf_dir), inputs.BASE_SECONDS, inputs.END_SECONDS)


def cache_efficiency(spark, sf_dir):
    return summary.cache_efficiency(_events(spark, sf_dir))


def eviction_rate(spark, sf_dir):
    return history.eviction_rate(inputs.cache_stats(spark, sf_dir), inputs.BASE_US)


def by_query_summary(spark, sf_dir):
    return summary.by_query_summary(_events(spark, sf_dir))


def consumer_lag(spark, sf_dir):
    offsets = inputs.consumer_offsets(spark, sf_dir)
    ends = offsets.select("topic", "partition", "end_offset")
    committed = offsets.where(F.col("committed").isNotNull()).select("topic", "partition", "committed")
    return summary.consumer_lag(ends, committed)


def recent_hit_rate(spark, sf_dir):
    return summary.recent_hit_rate(_answered(spark, sf_dir), F.col("cache_hit"))


def rolling_hit_rate(spark, sf_dir):
    return history.rolling_hit_rate(_answered(spark, sf_dir), "query_type", F.col("cache_hit"))


def trailing_throughput(spark, sf_dir):
    events = _answered(spark, sf_dir).select("query_type", "seq", "ts_us")
    return history.trailing_throughput(events, "query_type")


def popularity_vs_zipf(spark, sf_dir):
    counts = _events(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    profile = popularity.popularity_profile(counts, "key")
    return rounded(profile, observed_share=9, zipf_share=9, uniform_share=9)


QUERIES = {
    f.__name__: f
    for f in (
        event_counters,
        run_summary,
        summary_latency,
        last_n_per_class,
        throughput,
        cache_efficiency,
        eviction_rate,
        by_query_summary,
        consumer_lag,
        recent_hit_rate,
        rolling_hit_rate,
        trailing_throughput,
        popularity_vs_zipf,
    )
}
