"""Whole-run summaries of metric events (with ``seq``, the order of arrival).

Counters cover every event. Latency percentiles are exact over a bounded tail:
the newest rows of each class, as ``last_n_per_class`` finds them.

With ``runs`` (the labels of the runs to report) the functions that take it
answer per ``label``; without it the events are one run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions import ratio
from beaconry.operators.events import SUCCESS_EVENTS
from beaconry.operators.history import last_n, last_n_per_class, slice_counts
from beaconry.session import materialize

QUERY_TYPES = ("Q1", "Q2", "Q3", "Q4", "Q5")
LATENCY_SAMPLE = 5_000
TIME_SAMPLE = 20_000

# Counter name by event.
COUNTERS = {"hits": "hit", "misses": "miss", "recoveries": "recovery", "retries": "retry", "dlq": "dlq", "errors": "error"}

_POINTS = (0.5, 0.95, 0.99)


def _answered() -> Column:
    return F.col("event_type").isin(*SUCCESS_EVENTS)


def _keys(runs) -> list[str]:
    return [] if runs is None else ["label"]


def _wanted(events: DataFrame, runs, name: str, values: tuple[str, ...]) -> DataFrame:
    """One row per named value (and run)."""
    spark = events.sparkSession
    if runs is None:
        return spark.createDataFrame([(v,) for v in values], f"{name} string")
    return spark.createDataFrame([(run, v) for run in runs for v in values], f"label string, {name} string")


def _points(latency: str, names: tuple[str, str, str]) -> list[Column]:
    values = F.percentile(latency, F.array(*[F.lit(p) for p in _POINTS]))
    return [F.round(values.getItem(i), 3).alias(name) for i, name in enumerate(names)]


def event_counts(events: DataFrame, runs: tuple[str, ...] | None = None) -> DataFrame:
    """Events by event and query type (and run). All counters are sums over these few rows."""
    return events.groupBy(*_keys(runs), "event_type", "query_type").agg(F.count(F.lit(1)).alias("_rows"))


def activity(events: DataFrame, runs: tuple[str, ...] | None = None, **more: Column) -> DataFrame:
    """``event_counts`` per slice of arrival, written out: counters and cut-offs in one pass.

    ``more`` adds aggregates to the same pass.
    """
    keys = (*_keys(runs), "event_type", "query_type")
    added = [column.alias(name) for name, column in more.items()]
    return materialize(slice_counts(events, keys, more=added), "activity")


def _counters(names=tuple(COUNTERS)) -> list[Column]:
    """Counters from ``event_counts`` or ``activity``."""
    counted = {name: F.when(F.col("event_type") == COUNTERS[name], F.col("_rows")) for name in names}
    return [F.coalesce(F.sum(column), F.lit(0)).alias(name) for name, column in counted.items()]


def _recent(
    events: DataFrame, n: int, kind: str, kinds: tuple[str, ...], runs, counted: DataFrame | None
) -> DataFrame:
    """The newest ``n`` answered requests per kind (and run); a missing latency counts as zero."""
    latency = F.coalesce("latency_ms", F.lit(0.0)).alias("latency")
    answered = events.where(_answered()).select(*_keys(runs), kind, "seq", latency)
    slices = slice_counts(answered, (*_keys(runs), kind)) if counted is None else counted.where(_answered())
    if runs is None:
        return last_n_per_class(answered, n, kind, kinds, slices=slices)
    classes = tuple(f"{run}/{k}" for run in runs for k in kinds)
    by = F.concat_ws("/", "label", kind)
    recent = last_n_per_class(
        answered.withColumn("_class", by), n, "_class", classes, slices=slices.withColumn("_class", by)
    )
    return recent.drop("_class")


def event_counters(events: DataFrame) -> DataFrame:
    """Counters per query type and, in the row with null ``query_type``, in total.

    Errors are counted in total only. Unknown events are not counted.
    """
    return counters_of(event_counts(events))


def counters_of(counts: DataFrame) -> DataFrame:
    """``event_counters`` from one row or more (``_rows``) per event and query type."""
    named = [name for name in COUNTERS if name != "errors"]
    errors = F.when(F.grouping("query_type") == 1, _counters(("errors",))[0]).alias("errors")
    return counts.rollup("query_type").agg(*_counters(tuple(named)), errors)


def run_summary(
    events: DataFrame, runs: tuple[str, ...] | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """Totals and rates. Hit and miss rate are null where nothing was answered.

    Here and below ``counted`` may bring the ``activity`` of the events.
    """
    counts = event_counts(events, runs) if counted is None else counted
    counted = counts.groupBy(*_keys(runs)).agg(*_counters())
    total = F.col("hits") + F.col("misses") + F.col("recoveries")
    rescued = F.col("recoveries") + F.col("dlq")
    return counted.withColumn("total_requests", total).select(
        *_keys(runs),
        *COUNTERS,
        "total_requests",
        ratio(F.col("hits"), F.col("total_requests"), empty=None).alias("hit_rate"),
        ratio(F.col("misses"), F.col("total_requests"), empty=None).alias("miss_rate"),
        ratio(F.col("retries"), F.col("total_requests") + F.col("dlq")).alias("retry_rate"),
        ratio(F.col("recoveries"), rescued).alias("recovery_rate"),
        ratio(F.col("dlq"), F.col("total_requests") + F.col("dlq")).alias("dlq_rate"),
    )


def class_latency(
    events: DataFrame,
    n: int = LATENCY_SAMPLE,
    runs: tuple[str, ...] | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Percentiles, sum and number of the newest latencies per class and over all classes together."""
    recent = _recent(events, n, "event_type", SUCCESS_EVENTS, runs, counted)
    # At most n rows per class are left, so doubling them for "all" is cheap.
    both = recent.select(
        *_keys(runs), "latency", F.explode(F.array("event_type", F.lit("all"))).alias("class")
    )
    return both.groupBy(*_keys(runs), "class").agg(
        *_points("latency", ("p50", "p95", "p99")),
        F.sum("latency").alias("latency_sum"),
        F.count("latency").alias("latency_n"),
    )


def summary_latency(
    events: DataFrame,
    n: int = LATENCY_SAMPLE,
    runs: tuple[str, ...] | None = None,
    classes: DataFrame | None = None,
) -> DataFrame:
    """Exact p50, p95 and p99 per class and over all classes together.

    Every class has its row; percentiles of a class without requests are null.
    ``classes`` may bring the ``class_latency`` of the events.
    """
    wanted = _wanted(events, runs, "class", (*SUCCESS_EVENTS, "all"))
    found = (class_latency(events, n, runs) if classes is None else classes).drop("latency_sum", "latency_n")
    return wanted.join(found, wanted.columns, "left")


def throughput(events: DataFrame, since: float, as_of: float, n: int = TIME_SAMPLE) -> DataFrame:
    """Answered requests per second between ``since`` and ``as_of`` (epoch seconds).

    ``throughput_qps_total`` divides by the time the newest ``n`` answers span, in
    order of arrival; with fewer than two answers by the elapsed time.
    """
    elapsed = float(as_of) - float(since)
    run = events.where((F.col("ts") >= float(since)) & (F.col("ts") <= float(as_of)) & _answered()).select("seq", "ts")
    slices = slice_counts(run, ())
    total = slices.agg(F.coalesce(F.sum("_rows"), F.lit(0))).scalar()
    recent = last_n(run, n, slices=slices)
    spans = recent.agg(
        total.alias("total_requests"),
        F.count(F.lit(1)).alias("sample"),
        (F.max_by("ts", "seq") - F.min_by("ts", "seq")).alias("span"),
        F.count_if(F.col("ts") >= float(as_of) - 10).alias("last_10s"),
    )
    return spans.select("total_requests", F.lit(round(elapsed, 2)).alias("elapsed_sec"), *throughput_columns(elapsed))


def throughput_columns(elapsed: float) -> list[Column]:
    """Rates from (total_requests, sample, span, last_10s), where the last three are of the newest answers."""
    total = F.col("total_requests")
    overall = F.lit(0.0) if elapsed <= 0 else total / elapsed
    processing = F.when(F.coalesce("sample", F.lit(0)) < 2, overall).when(F.col("span") > 0, total / F.col("span"))
    return [
        F.round(overall, 2).alias("throughput_qps_elapsed"),
        F.round(F.coalesce(processing, F.lit(0.0)), 2).alias("throughput_qps_total"),
        F.round(F.coalesce("last_10s", F.lit(0)) / 10.0, 2).alias("throughput_qps_recent_10s"),
    ]


def cache_efficiency(
    events: DataFrame,
    n: int = LATENCY_SAMPLE,
    runs: tuple[str, ...] | None = None,
    counted: DataFrame | None = None,
    classes: DataFrame | None = None,
) -> DataFrame:
    """Mean latency with and without the cache, and the time it saved per request."""
    keys = _keys(runs)
    counted = activity(events, runs) if counted is None else counted
    classes = class_latency(events, n, runs, counted) if classes is None else classes
    kind, total, size = F.col("class"), F.col("latency_sum"), F.col("latency_n")

    def mean(names: tuple[str, ...]) -> Column:
        in_class = kind.isin(*names)
        summed, counted = F.sum(F.when(in_class, total)), F.sum(F.when(in_class, size))
        return F.when(counted > 0, summed / counted)

    means = classes.groupBy(*keys).agg(
        F.coalesce(mean(("hit",)), F.lit(0.0)).alias("mean_cache"),
        F.coalesce(mean(("miss", "recovery")), F.lit(0.0)).alias("mean_db"),
    )
    answered = run_summary(events, runs, counted).select(*keys, "hits", F.col("total_requests").alias("total"))
    if keys:
        joined = answered.join(means, keys, "left")  # one row per run on both sides
    else:
        joined = answered.withColumns({c: means.select(c).scalar() for c in ("mean_cache", "mean_db")})
    saved = F.col("hits") * (F.col("mean_db") - F.col("mean_cache"))
    worth = (F.col("total") > 0) & (F.col("mean_db") > 0)
    return joined.select(
        *keys,
        F.round("mean_cache", 3).alias("mean_t_cache_ms"),
        F.round("mean_db", 3).alias("mean_t_db_ms"),
        F.when(worth, F.round(saved / F.col("total"), 3)).alias("cache_efficiency"),
    )


def by_query_summary(
    events: DataFrame,
    n: int = LATENCY_SAMPLE,
    runs: tuple[str, ...] | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Counters, hit rate and exact percentiles for each of Q1 to Q5, also the unused ones."""
    keys = [*_keys(runs), "query_type"]
    counted = activity(events, runs) if counted is None else counted
    counts = counted.groupBy(*keys).agg(*_counters(("hits", "misses", "recoveries", "retries", "dlq")))
    recent = _recent(events, n, "query_type", QUERY_TYPES, runs, counted)
    latencies = recent.groupBy(*keys).agg(*_points("latency", ("p50_ms", "p95_ms", "p99_ms")))
    wanted = _wanted(events, runs, "query_type", QUERY_TYPES)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "misses", "recoveries", "retries", "dlq")]
    filled = wanted.join(counts, keys, "left").join(latencies, keys, "left").select(
        *keys, *zero, "p50_ms", "p95_ms", "p99_ms"
    )
    total = F.col("hits") + F.col("misses") + F.col("recoveries")
    return filled.withColumn("total", total).withColumn(
        "hit_rate", ratio(F.col("hits"), F.col("total"), empty=None)
    )


# The topics whose unread messages count as backlog.
BACKLOG_TOPICS = ("queries", "retry-queries")


def consumer_lag(
    end_offsets: DataFrame, committed: DataFrame, topics: tuple[str, ...] = BACKLOG_TOPICS, by: tuple[str, ...] = ()
) -> DataFrame:
    """Unread messages per topic and, in the row with null ``topic``, over the topics.

    A partition without a committed offset counts from zero; one that is ahead
    of the end counts zero. ``by`` names columns of both inputs, such as a sample
    time, to report separately.
    """
    keys = [*by, "topic", "partition"]
    watched = end_offsets.where(F.col("topic").isin(*topics))
    joined = watched.join(committed.select(*keys, "committed"), keys, "left")
    behind = F.greatest(F.lit(0), F.col("end_offset") - F.coalesce("committed", F.lit(0)))
    per_topic = joined.groupBy(*by, "topic").agg(F.sum(behind).alias("backlog"))
    overall = per_topic.groupBy(*by).agg(F.sum("backlog").alias("backlog"))
    total = overall.select(*by, F.lit(None).cast("string").alias("topic"), F.coalesce("backlog", F.lit(0)).alias("backlog"))
    return per_topic.unionByName(total)


def recent_hit_rate(results: DataFrame, hit: Column, n: int = 200, seq: str = "seq") -> DataFrame:
    """Hit rate of the newest ``n`` results: a top-n, of which each task sends on ``n`` rows."""
    newest = results.select(F.col(seq), hit.alias("hit")).orderBy(F.desc(seq)).limit(n)
    return newest.agg(
        ratio(F.count_if("hit"), F.count(F.lit(1)), empty=None).alias("hit_rate_window"),
        F.count(F.lit(1)).alias("window_size"),
    )


def run_throughput(results: DataFrame, failed: Column, sent_us: str = "created_us") -> DataFrame:
    """Sent and failed requests of a run and its rate."""
    counted = results.agg(
        F.count_if(~failed).alias("sent"),
        F.count_if(failed).alias("errors"),
        ((F.max(sent_us) - F.min(sent_us)) / 1e6).alias("elapsed"),
    )
    rate = F.col("sent") / F.greatest(F.col("elapsed"), F.lit(0.01))
    return counted.select(
        "sent",
        "errors",
        F.round("elapsed", 2).alias("elapsed_sec"),
        F.when(F.col("elapsed") > 0, F.round(rate, 2)).alias("throughput_qps"),
    )
