"""Queries that run a stream or a keyed table to its end and return what it holds."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from beaconry import sinks
from beaconry.operators import events, replay, requests, windows
from beaconry.plans import inputs
from beaconry.plans.shape import plain, rounded
from beaconry.plans.window_queries import normalize_events
from beaconry.session import materialize, scratch_path
from beaconry.operators.events import SUCCESS_EVENTS
from beaconry.plans.request_queries import _replay_input
from beaconry.sources import logs, messages
from beaconry.streaming import fills, jobs, lag, live, panes, tails
from beaconry.streaming import late as late_job

# Streams below are published in so many stretches of time, and read in as many micro-batches or more.
SLICES = 4
# Requests that a stretch has at most, if they are evenly spread: a join keeps some three stretches as its state.
STRETCH_ROWS = 500_000
SPAN_US = inputs.END_US - inputs.BASE_US
# Longer than a stretch, so that files of a stretch may come in any order.
DELAY = "15 minutes"
# Time at which a stream that has ended says so, long after its last row: what is open then closes.
CLOSING_US = inputs.END_US + 24 * 3_600_000_000


def publish_events(spark, sf_dir):
    """Events written as messages and read back."""
    folder = scratch_path(spark, "messages")
    sinks.publish_events(normalize_events(spark, sf_dir), folder)
    return plain(events.decode_events(messages.read_folder_once(spark, folder)))


def stream_window_metrics(spark, sf_dir):
    """Events published in stretches of time, aggregated as a stream, read from the keyed table."""
    folder = scratch_path(spark, "windows")
    _metric_messages(spark, sf_dir, f"{folder}/messages")
    query = jobs.start_window_job(
        _by_stretch(spark, f"{folder}/messages"),
        f"{folder}/table",
        f"{folder}/checkpoint",
        trigger=jobs.UNTIL_DONE,
        # The state is one row per window, whatever the traffic.
        partitions=spark.sparkContext.defaultParallelism,
        watermark=DELAY,
    )
    query.awaitTermination()
    return rounded(plain(jobs.window_table(spark, f"{folder}/table").latest()), latency_avg=9)


def _publish(rows, at_us, until_us, folder, slices=SLICES):
    """JSON messages in ``slices`` stretches of time, the last one open; the files of a stretch follow those of the one before.

    The rows are computed once, into a folder for each stretch, which are then appended one after the other.
    """
    spark, step = rows.sparkSession, (until_us - inputs.BASE_US) // slices
    stretch = F.least(F.greatest(F.floor((at_us - inputs.BASE_US) / step), F.lit(0)), F.lit(slices - 1))
    staged = scratch_path(spark, "staged")
    rows.select(F.to_json(F.struct("*")).alias("value"), stretch.cast("int").alias("stretch")).write.partitionBy("stretch").text(staged)
    there = {r["stretch"] for r in spark.read.schema("value string, stretch int").text(staged).select("stretch").distinct().collect()}
    for i in sorted(there):
        spark.read.schema("value string").text(f"{staged}/stretch={i}").write.mode("append").text(folder)


def _close(spark, folder, **row):
    names = ", ".join(f"{name} {'string' if isinstance(value, str) else 'double' if isinstance(value, float) else 'long'}" for name, value in row.items())
    last = spark.createDataFrame([tuple(row.values())], names)
    last.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(folder)


def _by_stretch(spark, folder, slices=SLICES):
    """The messages as a stream, about a stretch to a micro-batch."""
    files = len(messages.read_folder_once(spark, folder).inputFiles())
    return messages.read_folder(spark, folder, files_per_trigger=max(1, files // (slices + 1)))


def _metric_messages(spark, sf_dir, folder):
    rows = inputs.metric_events(spark, sf_dir, keep=("seq",)).drop("event_time")
    _publish(rows, F.col("ts") * 1e6, inputs.END_US, folder)
    return folder


def stream_window_panes(spark, sf_dir):
    """Events published in stretches of time, counted in panes and then in windows as a stream."""
    folder = scratch_path(spark, "panes")
    _metric_messages(spark, sf_dir, f"{folder}/messages")
    _close(spark, f"{folder}/messages", ts=CLOSING_US / 1e6, event_type="end")
    query = panes.start_pane_job(
        _by_stretch(spark, f"{folder}/messages"),
        f"{folder}/windows",
        f"{folder}/checkpoint",
        trigger=jobs.UNTIL_DONE,
        partitions=spark.sparkContext.defaultParallelism,
        watermark=DELAY,
    )
    query.awaitTermination()
    return rounded(plain(panes.read_closed_windows(spark, f"{folder}/windows")), latency_avg=9)


def stream_requests_to_fills(spark, sf_dir):
    """Requests and computed answers as two streams, joined as they arrive."""
    folder = scratch_path(spark, "fills")
    asked, given = f"{folder}/requests", f"{folder}/fills"
    wanted = materialize(_replay_input(spark, sf_dir).select("query_id", "key", "ttl_us", "created_us"), "wanted")
    answers = replay.fills_of(requests.route_attempts(inputs.attempts(spark, sf_dir)))
    last, n = wanted.agg(F.max("created_us"), F.count(F.lit(1))).first()
    slices = max(SLICES, -(-n // STRETCH_ROWS))
    last = last or inputs.BASE_US + slices
    _publish(wanted, F.col("created_us"), last, asked, slices)
    _publish(answers, F.col("fill_us"), last, given, slices)
    _close(spark, asked, query_id=-1, key="end", ttl_us=1, created_us=last + CLOSING_US)
    _close(spark, given, key="end", fill_us=last + CLOSING_US)
    step = (last - inputs.BASE_US) // slices
    query = fills.start_fills_job(
        events.parse_json(_by_stretch(spark, asked, slices), fills.REQUEST),
        events.parse_json(_by_stretch(spark, given, slices), fills.FILL),
        f"{folder}/served",
        f"{folder}/checkpoint",
        trigger=jobs.UNTIL_DONE,
        partitions=spark.sparkContext.defaultParallelism,
        watermark=f"{2 * step // 1_000_000 + 60} seconds",
    )
    query.awaitTermination()
    served = spark.read.schema(f"{fills.REQUEST}, fill_us long").parquet(f"{folder}/served")
    age = F.col("created_us") - F.col("fill_us")
    return served.select("query_id", "key", "created_us", "fill_us", age.alias("age_us"))


def stream_last_n_per_class(spark, sf_dir):
    """The newest answers of each class, kept as state while events arrive."""
    folder = scratch_path(spark, "tails")
    _metric_messages(spark, sf_dir, f"{folder}/messages")
    row = "seq long, event_type string, query_type string, latency_ms double, status string"
    arriving = events.parse_json(_by_stretch(spark, f"{folder}/messages"), row)
    answered = arriving.where(F.col("event_type").isin(*SUCCESS_EVENTS)).drop("status")
    query = tails.start_tail_job(
        answered, 500, "event_type", f"{folder}/table", f"{folder}/checkpoint", trigger=jobs.UNTIL_DONE, partitions=spark.sparkContext.defaultParallelism
    )
    query.awaitTermination()
    return tails.newest(spark, f"{folder}/table", 500, row).drop("status")


def stream_event_counters(spark, sf_dir):
    """Counters merged from what each micro-batch left."""
    folder = scratch_path(spark, "live")
    _metric_messages(spark, sf_dir, f"{folder}/messages")
    arriving = events.decode_events(_by_stretch(spark, f"{folder}/messages"))
    live.start_live_summary(arriving, f"{folder}/summary", f"{folder}/checkpoint", trigger=jobs.UNTIL_DONE).awaitTermination()
    summary = live.LiveSummary(spark, f"{folder}/summary")
    summary.fold(1)
    return summary.event_counters()


# Messages of each partition that a micro-batch of the log query reads at most, as a share of an average partition.
LOG_PARTITIONS, LOG_BATCHES = 3, 4


def _event_log(spark, sf_dir, folder):
    """The events as a message log, by user, and the messages of a partition that make a micro-batch."""
    rows = inputs.table(spark, sf_dir, "events").select("user_id", F.to_json(F.struct("event_id", "user_id")).alias("value"))
    logs.append(rows, folder, LOG_PARTITIONS, key="user_id", place=F.col("user_id") % LOG_PARTITIONS)
    total = sum(logs.end_offsets(folder).values())
    return max(1, -(-total // (LOG_PARTITIONS * LOG_BATCHES)))


def stream_log_messages(spark, sf_dir):
    """Events appended to a message log and read as a stream that is stopped half way and started again."""
    folder = scratch_path(spark, "log")
    path = f"{folder}/events"
    limit = str(_event_log(spark, sf_dir, path))
    options = {"startingOffsets": "earliest", "maxOffsetsPerTrigger": limit, "progress": f"{folder}/progress"}
    for _ in range(2):
        # A stream in this mode ends after one micro-batch of the limit.
        _run_log(spark, path, folder, options, jobs.UNTIL_DONE)
    _run_log(spark, path, folder, {**options, "maxOffsetsPerTrigger": str(1 << 62)}, jobs.UNTIL_DONE)
    back = spark.read.schema("partition int, offset long, value string").parquet(f"{folder}/read")
    event = F.from_json("value", "event_id long, user_id long")
    return back.select(event.alias("event"), "offset").select("event.*", (F.col("offset") >= 0).alias("placed"))


def _run_log(spark, path, folder, options, trigger):
    arriving = logs.read_log_stream(spark, path, **options)
    query = (
        arriving.writeStream.format("parquet")
        .option("path", f"{folder}/read")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**trigger)
        .start()
    )
    query.awaitTermination()


def stream_consumer_lag(spark, sf_dir):
    """Unread messages of a log after each micro-batch of the stream that reads it, from the stream's own progress."""
    folder = scratch_path(spark, "lag")
    path = f"{folder}/events"
    limit = str(_event_log(spark, sf_dir, path))
    name = f"reader-{folder[-12:]}"
    listener = lag.LagListener(spark, f"{folder}/samples", {name: ("events", path)})
    spark.streams.addListener(listener)
    try:
        arriving = logs.read_log_stream(spark, path, startingOffsets="earliest", maxOffsetsPerTrigger=limit, progress=f"{folder}/progress")
        query = (
            arriving.writeStream.format("noop")
            .queryName(name)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(processingTime="0 seconds")
            .start()
        )
        query.processAllAvailable()
        batches = {p.batchId for p in query.recentProgress if p.numInputRows}
        query.stop()
        # Progress is told in its own time.
        for _ in range(100):
            samples = lag.lag_samples(spark, f"{folder}/samples")
            if batches <= {r["batch_id"] for r in samples.select("batch_id").distinct().collect()}:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    return lag.lag_series(samples, ("events",)).select("batch_id", "topic", "backlog")


def stream_late_rows(spark, sf_dir):
    """Events that come out of order: those counted in tumbling windows, and those that were too late, by event."""
    folder = scratch_path(spark, "late")
    rows = inputs.metric_events(spark, sf_dir, keep=("seq",)).drop("event_time")
    # Every seventh event comes a whole range of time late.
    late = F.when(F.col("seq") % 7 == 0, F.lit(inputs.END_US)).otherwise(F.col("ts") * 1e6)
    _publish(rows, late, inputs.END_US, f"{folder}/messages")
    _close(spark, f"{folder}/messages", ts=CLOSING_US / 1e6, event_type="end")
    size, arriving = "10 seconds", events.decode_events(_by_stretch(spark, f"{folder}/messages"))
    # Windows close in the micro-batch after the one that ends the stream.
    for _ in range(2):
        counted = (
            arriving.withWatermark("event_time", DELAY)
            .groupBy(F.window("event_time", size), "event_type")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        with jobs.state_partitions(spark, spark.sparkContext.defaultParallelism), jobs.no_empty_batches(spark):
            query = (
                counted.writeStream.outputMode("append")
                .format("parquet")
                .option("path", f"{folder}/counted")
                .option("checkpointLocation", f"{folder}/counted-checkpoint")
                .trigger(**jobs.UNTIL_DONE)
                .start()
            )
            query.awaitTermination()
        _close(spark, f"{folder}/messages", ts=CLOSING_US / 1e6, event_type="end")
    late_job.start_late_job(arriving, f"{folder}/side", f"{folder}/side-checkpoint", size, DELAY, jobs.UNTIL_DONE).awaitTermination()
    kept = late_job.LateRows(spark, f"{folder}/side", arriving.schema, size, DELAY).read()
    both = spark.read.parquet(f"{folder}/counted").select("event_type", "n").union(kept.select("event_type", F.lit(1).cast("long")))
    return both.where("event_type <> 'end'").groupBy("event_type").agg(F.sum("n").alias("n"))


def upsert_latest(spark, sf_dir):
    """Documents of the first half of the time, compacted, then those the rest changes."""
    table = jobs.window_table(spark, scratch_path(spark, "documents"))
    timed = inputs.metric_events(spark, sf_dir)
    half = F.timestamp_micros(F.lit((inputs.BASE_US + inputs.END_US) // 2))
    table.write_batch(windows.window_metrics(timed.where(F.col("event_time") < half)), 0)
    table.compact(0)
    changed = windows.window_metrics(timed).where(F.col("window_end") > half)
    table.write_batch(changed, 1)
    return rounded(plain(table.latest()), latency_avg=9)


QUERIES = {
    f.__name__: f
    for f in (
        publish_events,
        stream_window_metrics,
        stream_window_panes,
        stream_requests_to_fills,
        stream_last_n_per_class,
        stream_event_counters,
        stream_log_messages,
        stream_consumer_lag,
        stream_late_rows,
        upsert_latest,
    )
}
