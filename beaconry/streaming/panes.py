"""Sliding windows on a stream by panes: two aggregations, one after the other.

Events are counted once, in the pane of one slide that they fall into. A pane is handed on when the
watermark has passed it, and only then spread over its windows; these are written once,
when they too are closed. The state is a row for each open pane and window, whatever the traffic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from beaconry.operators import windows
from beaconry.operators.events import decode_events
from beaconry.schemas import WINDOW_DOCUMENT
from beaconry.streaming.jobs import TRIGGER, state_partitions

DATE = "window_date"


def pane_window_stream(
    messages: DataFrame, size: str = windows.SIZE, slide: str = windows.SLIDE, watermark: str = windows.WATERMARK
) -> DataFrame:
    """Documents of closed windows of a message stream, each once (append mode).

    An event behind the watermark by more than its pane is dropped, as in Spark's own windows.
    """
    pane = windows.pane_length(messages.sparkSession, size, slide)
    timed = decode_events(messages).withWatermark("event_time", watermark)
    panes = timed.groupBy(F.window("event_time", pane)).agg(*windows.pane_columns())
    placed = panes.groupBy(F.window(F.window_time("window"), size, slide)).agg(*windows.merged_columns())
    return windows.merged_document(placed)


def start_pane_job(
    messages: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, partitions: int | None = None, **window_options: str
) -> StreamingQuery:
    """Closed windows to a folder of parquet files, by date of the window's start; readers see only whole batches."""
    documents = pane_window_stream(messages, **window_options).withColumn(DATE, F.to_date("window_start"))
    with state_partitions(messages.sparkSession, partitions):
        return (
            documents.writeStream.outputMode("append")
            .format("parquet")
            .partitionBy(DATE)
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or TRIGGER))
            .start()
        )


def read_closed_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{WINDOW_DOCUMENT.toDDL()}, {DATE} date").parquet(path).drop(DATE)
