"""Rows that a windowed stream drops because they come too late, kept beside it.

Spark drops a row whose window ends at or before the watermark that the micro-batch before it had, and only counts it. That
is the latest event time of all batches before that one, less the delay. Here each batch notes its own latest
time, so a batch that is replayed sees the same watermark, and the rows behind it are written to a folder of the batch.

Start the windows under ``jobs.no_empty_batches``: a micro-batch without rows would move their watermark on by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from beaconry.operators import windows
from beaconry.session import micros
from beaconry.streaming.jobs import TRIGGER, each_batch

_MARK = "latest_ms long"


class LateRows:
    def __init__(self, spark: SparkSession, path: str, schema, window: str, watermark: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.window_us, self.delay_ms = micros(spark, window)[0], micros(spark, watermark)[0] // 1000
        # A first mark and an empty batch make a new folder readable.
        spark.createDataFrame([], _MARK).write.mode("ignore").parquet(f"{self.path}/marks/batch_id=-1")
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/late/batch_id=-1")

    def watermark_ms(self, batch_id: int) -> int:
        """The watermark behind which rows of a batch are late, in whole milliseconds as Spark keeps it; 0 before any row."""
        marks = self.spark.read.schema(f"{_MARK}, batch_id long").parquet(f"{self.path}/marks")
        latest = marks.where(F.col("batch_id") < batch_id - 1).agg(F.max("latest_ms")).first()[0]
        return 0 if latest is None else max(0, latest - self.delay_ms)

    def write_batch(self, rows: DataFrame, batch_id: int) -> None:
        at = F.unix_micros("event_time")
        end = at - F.pmod(at, F.lit(self.window_us)) + self.window_us
        late = rows.where(end <= F.lit(self.watermark_ms(batch_id) * 1000))
        late.write.mode("overwrite").parquet(f"{self.path}/late/batch_id={batch_id}")
        latest = rows.agg(F.max(F.unix_millis("event_time")).alias("latest_ms")).where("latest_ms is not null")
        latest.write.mode("overwrite").parquet(f"{self.path}/marks/batch_id={batch_id}")

    def read(self) -> DataFrame:
        """All late rows."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/late/*")


def start_late_job(
    events: DataFrame,
    path: str,
    checkpoint: str,
    window: str = windows.SLIDE,
    watermark: str = windows.WATERMARK,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Late rows of a stream with ``event_time``: those that tumbling windows of that length drop under the same watermark.

    For sliding windows take the slide as the length: a row is late when its pane is closed.
    """
    target = LateRows(events.sparkSession, path, events.schema, window, watermark)
    return (
        events.writeStream.foreachBatch(each_batch(target.write_batch, "late rows"))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or TRIGGER))
        .start()
    )
