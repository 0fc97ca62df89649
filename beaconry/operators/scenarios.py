"""Snapshots of labelled runs, and what is compared between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.operators import summary
from beaconry.operators.events import SUCCESS_EVENTS
from beaconry.operators.history import last_n_per_class
from beaconry.schemas import SNAPSHOT
from beaconry.session import materialize


def _elements(name: str, fields: list[str]) -> Column:
    return F.struct(*fields).alias(name)


def _one_row_per_label(parts: list[DataFrame]) -> DataFrame:
    """Frames with one row per label side by side, in one shuffle instead of a chain of joins."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    values = [c for c in stacked.columns if c != "label"]
    merged = stacked.groupBy("label").agg(*[F.any_value(c, ignoreNulls=F.lit(True)).alias(c) for c in values])
    return merged.where(F.col(parts[0].columns[1]).isNotNull())


def _span(events: DataFrame, runs: tuple[str, ...], counted: DataFrame, as_of: float) -> DataFrame:
    """Per run, the time between the oldest and the newest of its last answers, and how many of them are of the last ten seconds."""
    answered = F.col("event_type").isin(*SUCCESS_EVENTS)
    recent = last_n_per_class(
        events.where(answered).select("label", "seq", "ts"),
        summary.TIME_SAMPLE,
        "label",
        runs,
        slices=counted.where(answered),
    )
    return recent.groupBy("label").agg(
        (F.max_by("ts", "seq") - F.min_by("ts", "seq")).alias("span"),
        F.count(F.lit(1)).alias("sample"),
        F.count_if(F.col("ts") >= float(as_of) - 10).alias("last_10s"),
    )


def run_snapshots(
    events: DataFrame,
    runs: tuple[str, ...],
    since: float,
    as_of: float,
    extras: DataFrame | None = None,
    lags: DataFrame | None = None,
    evictions: DataFrame | None = None,
    n: int = summary.LATENCY_SAMPLE,
) -> DataFrame:
    """One nested snapshot document per named run, all runs in one plan.

    ``extras`` adds (label, extra), ``lags`` (label, backlog_size) and
    ``evictions`` (label, total_evicted, rate_per_min). Everything put together
    here has one row per run. The counts that all parts start from, and the
    class latencies, are small and written out first (eagerly).
    """
    elapsed = float(as_of) - float(since)
    events = events.where(F.col("label").isin(*runs) & F.col("ts").between(float(since), float(as_of)))
    counted = summary.activity(events, runs)
    classes = materialize(summary.class_latency(events, n, runs, counted), "classes")
    totals = summary.run_summary(events, runs, counted)
    latency = summary.summary_latency(events, n, runs, classes).groupBy("label").agg(
        *[
            F.max_by(F.struct("p50", "p95", "p99"), F.when(F.col("class") == c, 1)).alias(f"latency_ms_{c}")
            for c in (*SUCCESS_EVENTS, "all")
        ]
    )
    per_type = summary.by_query_summary(events, n, runs, counted)
    value = F.struct(*[f.name for f in SNAPSHOT["by_query"].dataType.valueType.fields])
    by_query = per_type.groupBy("label").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("query_type", value)))).alias("by_query")
    )
    efficiency = summary.cache_efficiency(events, n, runs, counted, classes)
    parts = [totals, _span(events, runs, counted, as_of), latency, efficiency, by_query]
    parts += [frame for frame in (extras, lags, evictions) if frame is not None]
    joined = _one_row_per_label(parts)
    optional = {
        "extra": SNAPSHOT["extra"].dataType,
        "backlog_size": SNAPSHOT["backlog_size"].dataType,
        "total_evicted": SNAPSHOT["eviction"].dataType["total_evicted"].dataType,
        "rate_per_min": SNAPSHOT["eviction"].dataType["rate_per_min"].dataType,
    }
    for name, kind in optional.items():
        if name not in joined.columns:
            joined = joined.withColumn(name, F.lit(None).cast(kind))

    _, overall, recent = summary.throughput_columns(elapsed)
    return joined.select(
        "label",
        F.lit(float(as_of)).alias("snapshot_ts"),
        F.lit(round(elapsed, 2)).alias("elapsed_sec"),
        _elements("totals", [f.name for f in SNAPSHOT["totals"].dataType.fields]),
        "hit_rate",
        "miss_rate",
        "retry_rate",
        "recovery_rate",
        "dlq_rate",
        "backlog_size",
        overall,
        recent,
        *[f"latency_ms_{c}" for c in (*SUCCESS_EVENTS, "all")],
        "mean_t_cache_ms",
        "mean_t_db_ms",
        "cache_efficiency",
        _elements("eviction", ["total_evicted", "rate_per_min"]),
        "by_query",
        "extra",
    )


def _or_zero(path: str) -> Column:
    return F.coalesce(F.col(path), F.lit(0.0))


def scenario_comparison(snapshots: DataFrame, baseline: str) -> DataFrame:
    """One row per run: throughput, latencies, rates in percent, and throughput against a baseline run."""
    rate = _or_zero("throughput_qps_total")
    # All snapshots in one window: there is one row per run.
    base = F.max(F.when(F.col("label") == baseline, rate)).over(Window.partitionBy(F.lit(0)))
    return snapshots.select(
        "label",
        F.col("extra.scale").alias("consumers"),
        rate.alias("throughput_qps"),
        *[
            _or_zero(f"latency_ms_{c}.{p}").alias(f"{c}_{p}")
            for c in ("hit", "miss", "all")
            for p in ("p50", "p95")
        ],
        *[(_or_zero(f"{r}_rate") * 100).alias(f"{r}_pct") for r in ("hit", "retry", "dlq")],
        F.when(base > 0, F.round(rate / base, 4)).alias("throughput_vs_baseline"),
    )


def scenario_reliability(snapshots: DataFrame) -> DataFrame:
    """Requests completed, rescued by a retry, and lost.

    A run on the queue loses what reaches the dead-letter topic, a synchronous
    one what ends in an error.
    """
    queued = F.coalesce("extra.use_kafka", F.lit(False))
    total = {f: F.coalesce(f"totals.{f}", F.lit(0)) for f in ("hits", "misses", "recoveries", "dlq", "errors")}
    return snapshots.select(
        "label",
        queued.alias("queued"),
        (total["hits"] + total["misses"] + total["recoveries"]).alias("completed"),
        total["recoveries"].alias("recovered"),
        F.when(queued, total["dlq"]).otherwise(total["errors"]).alias("lost"),
    )


def recovery_time(snapshots: DataFrame, outage_end: float = 60.0) -> DataFrame:
    """Seconds from the end of an outage until the backlog is empty.

    Where it never empties, until the last sample. Reads each run's history in
    place, without a shuffle; runs without a history are left out.
    """
    history = F.col("extra.backlog_history")
    empty = F.filter(history, lambda p: (p["time_offset"] >= outage_end) & (p["backlog"] == 0))
    first_empty = F.try_element_at(empty, F.lit(1))["time_offset"]
    last = F.try_element_at(history, F.lit(-1))["time_offset"]
    end = F.coalesce(first_empty, last)
    return snapshots.where(F.size(history) > 0).select(
        "label", end.alias("recovered_at"), (end - outage_end).alias("recovery_sec")
    )


def backlog_history(snapshots: DataFrame) -> DataFrame:
    """The histories of all runs as one series."""
    points = snapshots.select("label", F.explode("extra.backlog_history").alias("point"))
    return points.select("label", "point.time_offset", "point.backlog")


# Phases meet the samples in slices of 2, 4, 8, ... seconds, up to two to this power.
WIDEST_LEVEL = 30


def _cell(at: str | Column, level: Column) -> Column:
    """The slice of a time on a level; times are held within what a slice number can be."""
    at = F.col(at) if isinstance(at, str) else at
    held = F.least(F.greatest(at, F.lit(-1e15)), F.lit(1e15))
    return F.floor(held / F.pow(F.lit(2.0), level)).cast("long")


def backlog_by_phase(samples: DataFrame, phases: DataFrame) -> DataFrame:
    """Peak and number of backlog samples of each run in each phase (both ends included).

    Any number of phases: one of a length up to 2^level lies in at most two slices of that
    level, so the join is on (level, slice). A sample is repeated for the levels in use,
    at most ``WIDEST_LEVEL`` (looked up eagerly). Phases longer than the widest slice cover more of them.
    """
    during = F.col("time_offset").between(F.col("phase_start"), F.col("phase_end"))
    length = F.least(F.greatest(F.col("phase_end") - F.col("phase_start"), F.lit(2.0)), F.lit(2.0**WIDEST_LEVEL))
    level = F.ceil(F.log2(length)).cast("int")
    placed = phases.where(F.col("phase_start") <= F.col("phase_end")).withColumn("_level", level)
    levels = sorted(r["_level"] for r in placed.select("_level").distinct().collect())
    cells = F.sequence(_cell("phase_start", F.col("_level")), _cell("phase_end", F.col("_level")))
    sliced = placed.withColumn("_cell", F.explode(cells))
    at = samples.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    return (
        at.withColumn("_cell", _cell("time_offset", F.col("_level")))
        .join(sliced, ["_level", "_cell"])
        .where(during)
        .groupBy("label", "phase")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.max("backlog").alias("peak_backlog"),
            F.max(F.col("phase_end") - F.col("phase_start")).alias("phase_sec"),
        )
    )


def history_arrays(samples: DataFrame) -> DataFrame:
    """(label, time_offset, backlog) samples as one ordered history per run.

    A history holds the samples one run was polled for, as in its snapshot.
    """
    point = F.struct("time_offset", "backlog")
    return samples.groupBy("label").agg(F.array_sort(F.collect_list(point)).alias("backlog_history"))
