"""What a stopped or running stateful stream holds, read from its checkpoint by Spark's state data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def state_operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(operatorId, operatorName, stateStoreName, numPartitions, minBatchId, maxBatchId) of the checkpoint's stateful operators."""
    names = ("operatorId", "operatorName", "stateStoreName", "numPartitions", "minBatchId", "maxBatchId")
    return spark.read.format("state-metadata").load(checkpoint).select(*names)


def state_rows(spark: SparkSession, checkpoint: str, operator: int = 0, batch_id: int | None = None) -> DataFrame:
    """(key, value, partition_id) of an operator after a micro-batch, the last one if none is named."""
    reader = spark.read.format("statestore").option("operatorId", operator)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(checkpoint)


# The counters of a window come first in its state, in the document's order; this one counts all events.
_COUNT_EVENTS = 7


def open_windows(spark: SparkSession, checkpoint: str, operator: int = 0, batch_id: int | None = None) -> DataFrame:
    """(window_start, window_end, count_events) of the windows, or panes, that a windowed stream of this package keeps open."""
    rows = state_rows(spark, checkpoint, operator, batch_id)
    # Spark names several values alike, so they are taken by place.
    fields = rows.schema["value"].dataType.fields
    named = ",".join(f"v{i}:{f.dataType.simpleString()}" for i, f in enumerate(fields))
    value = F.col("value").cast(f"struct<{named}>")
    window = rows.schema["key"].dataType.fieldNames()[0]
    return rows.select(
        F.col(f"key.`{window}`.start").alias("window_start"),
        F.col(f"key.`{window}`.end").alias("window_end"),
        value[f"v{_COUNT_EVENTS}"].alias("count_events"),
    )
