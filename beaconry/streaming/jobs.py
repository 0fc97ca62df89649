"""The streaming jobs: window documents and routing of attempts."""

from __future__ import annotations

import logging
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from beaconry import sinks
from beaconry.operators import requests, windows
from beaconry.operators.events import decode_events, parse_json
from beaconry.schemas import ATTEMPT, WINDOW_DOCUMENT
from beaconry.streaming.upsert import UpsertTable

log = logging.getLogger(__name__)

TRIGGER = {"processingTime": "10 seconds"}
UNTIL_DONE = {"availableNow": True}
# Keyed tables fold their batches this often, which bounds what a reader goes through.
COMPACT_EVERY = 100


@contextmanager
def state_partitions(spark: SparkSession, count: int | None):
    """Partitions of a stateful query, fixed when it first starts; ``None`` keeps the session's."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    if count:
        spark.conf.set(name, str(count))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def no_empty_batches(spark: SparkSession):
    """Queries started here move their watermark with data only, never in a micro-batch without rows."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def window_stream(
    messages: DataFrame,
    size: str = windows.SIZE,
    slide: str = windows.SLIDE,
    watermark: str = windows.WATERMARK,
) -> DataFrame:
    """Window documents of a message stream. Tumbling windows have slide = size."""
    timed = decode_events(messages).withWatermark("event_time", watermark)
    return windows.window_metrics(timed, size, slide)


def each_batch(write: Callable[[DataFrame, int], None], name: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch sink that skips empty batches and logs their size.

    The batch is kept while it is looked at and written, so that it is computed once.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            if kept.isEmpty():
                return
            rows = Observation()
            write(kept.observe(rows, F.count(F.lit(1)).alias("rows")), batch_id)
            log.info("%s: batch %s, %s rows", name, batch_id, rows.get["rows"])
        finally:
            kept.unpersist()

    return sink


def window_table(spark: SparkSession, path: str) -> UpsertTable:
    return UpsertTable(spark, path, WINDOW_DOCUMENT, "window_id")


def start_window_job(
    messages: DataFrame,
    table: str,
    checkpoint: str,
    trigger: dict | None = None,
    partitions: int | None = None,
    compact_every: int = COMPACT_EVERY,
    **window_options: str,
) -> StreamingQuery:
    """Windows that changed go to the keyed table, batch by batch (update mode)."""
    spark = messages.sparkSession
    documents = window_stream(messages, **window_options)
    target = window_table(spark, table)

    def write(batch: DataFrame, batch_id: int) -> None:
        target.write_batch(batch, batch_id)
        target.compact_every(compact_every, batch_id)

    with state_partitions(spark, partitions):
        return (
            documents.writeStream.outputMode("update")
            .foreachBatch(each_batch(write, "windows"))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or TRIGGER))
            .start()
        )


def decode_attempts(messages: DataFrame) -> DataFrame:
    return parse_json(messages, ATTEMPT).where(F.col("query_id").isNotNull())


def route_batch(routed: DataFrame, batch_id: int, path: str, servers: str | None = None) -> None:
    """One micro-batch to the retry topic, the dead-letter topic, the event feed and the log.

    Folders are named after the batch and replaced when it is replayed. With
    ``servers`` retries and dead letters go to Kafka topics instead, where a
    replayed batch sends them again.
    """
    part = f"batch_id={batch_id}"
    outgoing = {
        requests.RETRY_TOPIC: requests.retry_messages(routed),
        requests.DEAD_LETTER_TOPIC: requests.dead_letters(routed),
    }
    for topic, rows in outgoing.items():
        if servers:
            sinks.write_topic(rows, servers, topic)
        else:
            sinks.write_json_messages(rows, f"{path}/{topic}/{part}")
    sinks.write_json_messages(requests.attempt_events(routed), f"{path}/events/{part}")
    routed.write.mode("overwrite").parquet(f"{path}/routed/{part}")


def start_routing_job(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    max_retries: int = requests.MAX_RETRIES,
    trigger: dict | None = None,
    servers: str | None = None,
) -> StreamingQuery:
    """Route attempts as they arrive."""
    routed = requests.route_attempts(decode_attempts(messages), max_retries)

    def write(batch: DataFrame, batch_id: int) -> None:
        route_batch(batch, batch_id, path, servers)

    return (
        routed.writeStream.foreachBatch(each_batch(write, "routing"))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or TRIGGER))
        .start()
    )
