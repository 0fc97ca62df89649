"""Queries that compare labelled runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry import sinks
from beaconry.functions import safe_label as safe_label_text
from beaconry.operators import history, scenarios, summary
from beaconry.plans import inputs
from beaconry.plans.shape import rounded
from beaconry.session import scratch_path
from beaconry.sources import tables


def _runs(events):
    """The labels of all runs: one row each."""
    return tuple(sorted(r["label"] for r in events.select("label").distinct().collect()))


def _extras(spark, sf_dir):
    """Run settings by label, with the backlog history of the run."""
    histories = scenarios.history_arrays(inputs.backlog_samples(spark, sf_dir))
    run_no = F.substring("label", 2, 9).cast("int")
    extra = F.struct(
        (run_no % 2 == 1).alias("use_kafka"),
        (1 + run_no % 3).cast("int").alias("scale"),
        F.lit(True).alias("simulated_failure"),
        F.concat(F.lit("run "), "label").alias("description"),
        F.lit(35.0).alias("spike_start_time"),
        F.lit(50.0).alias("spike_end_time"),
        F.col("backlog_history"),
    )
    return histories.select("label", extra.alias("extra"))


def _lags(spark, sf_dir):
    """Unread messages of each run's topics."""
    offsets = inputs.run_offsets(spark, sf_dir)
    ends = offsets.select("label", "topic", "partition", "end_offset")
    behind = summary.consumer_lag(ends, offsets.select("label", "topic", "partition", "committed"), by=("label",))
    return behind.where(F.col("topic").isNull()).select("label", F.col("backlog").alias("backlog_size"))


def _evictions(spark, sf_dir):
    """Evicted keys of each run, and the rate since the sample before."""
    rates = history.eviction_rate(inputs.run_cache_stats(spark, sf_dir), inputs.BASE_US, by="label")
    newest = [F.max_by(c, "sample_us").alias(c) for c in ("evicted_keys", "rate_per_min")]
    return rates.groupBy("label").agg(*newest).withColumnRenamed("evicted_keys", "total_evicted")


def snapshots(spark, sf_dir):
    events = inputs.metric_events(spark, sf_dir, keep=("seq", "label"))
    return scenarios.run_snapshots(
        events,
        _runs(events),
        inputs.BASE_SECONDS,
        inputs.END_SECONDS,
        extras=_extras(spark, sf_dir),
        lags=_lags(spark, sf_dir),
        evictions=_evictions(spark, sf_dir),
    )


def run_snapshots(spark, sf_dir):
    """Throughput, backlog and evictions of each run."""
    return snapshots(spark, sf_dir).select(
        "label",
        "elapsed_sec",
        "backlog_size",
        "throughput_qps_total",
        "throughput_qps_recent_10s",
        "eviction.total_evicted",
        "eviction.rate_per_min",
    )


def safe_label(spark, sf_dir):
    runs = inputs.raw_events(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("events"))
    named = runs.withColumn("label", F.concat(F.lit("run "), "label", F.lit("/kafka")))
    return named.select("label", safe_label_text(F.col("label")).alias("safe"), "events")


def snapshot_extras(spark, sf_dir):
    """Settings that no schema names, written, loaded, written again and loaded."""
    folder = scratch_path(spark, "extras")
    run_no = F.substring("label", 2, 9).cast("int")
    settings = F.to_json(F.struct((run_no % 2 == 1).alias("use_kafka"), F.concat(F.lit("lab "), "label").alias("site"), F.struct(run_no.alias("rack")).alias("place")))
    counts = inputs.raw_events(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("elapsed_sec"))
    rows = counts.select("label", F.lit(0.0).alias("snapshot_ts"), F.col("elapsed_sec").cast("double").alias("elapsed_sec"), F.parse_json(settings).alias("extra_all"))
    sinks.write_snapshots(rows, f"{folder}/once")
    sinks.write_snapshots(tables.load_snapshots(spark, f"{folder}/once"), f"{folder}/again")
    return tables.load_snapshots(spark, f"{folder}/again").select(
        "label",
        F.col("elapsed_sec").cast("long").alias("events"),
        "extra.use_kafka",
        tables.extra_value("site", "string").alias("site"),
        tables.extra_value("place.rack", "int").alias("rack"),
    )


def load_snapshots(spark, sf_dir):
    """Snapshots written as JSON and read back."""
    folder = scratch_path(spark, "snapshots")
    sinks.write_snapshots(snapshots(spark, sf_dir), folder)
    history = F.col("extra.backlog_history")
    return tables.load_snapshots(spark, folder).select(
        "label",
        "totals.hits",
        "totals.dlq",
        "totals.total_requests",
        "hit_rate",
        "retry_rate",
        "throughput_qps_total",
        F.col("latency_ms_all.p50").alias("all_p50"),
        F.col("latency_ms_all.p99").alias("all_p99"),
        "extra.use_kafka",
        F.size(history).cast("long").alias("backlog_points"),
        F.aggregate(history, F.lit(0).cast("long"), lambda total, p: total + p["backlog"]).alias("backlog_sum"),
    )


def scenario_comparison(spark, sf_dir):
    compared = scenarios.scenario_comparison(snapshots(spark, sf_dir), baseline="s0")
    return rounded(compared, hit_pct=2, retry_pct=2, dlq_pct=2)


def scenario_reliability(spark, sf_dir):
    return scenarios.scenario_reliability(snapshots(spark, sf_dir))


def recovery_time(spark, sf_dir):
    return scenarios.recovery_time(_extras(spark, sf_dir))


def backlog_by_phase(spark, sf_dir):
    return scenarios.backlog_by_phase(inputs.backlog_samples(spark, sf_dir), inputs.backlog_phases(spark))


QUERIES = {
    f.__name__: f
    for f in (
        safe_label,
        run_snapshots,
        snapshot_extras,
        load_snapshots,
        scenario_comparison,
        scenario_reliability,
        recovery_time,
        backlog_by_phase,
    )
}
