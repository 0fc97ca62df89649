"""Consumer lag from a streaming job's own progress: offsets after every micro-batch, beside the ends of its logs."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from beaconry.operators.summary import consumer_lag
from beaconry.sources.logs import end_offsets

log = logging.getLogger(__name__)

SAMPLE = "query string, batch_id long, sample_us long, topic string, partition int, committed long, end_offset long"


class LagListener(StreamingQueryListener):
    """Writes a row per partition for each micro-batch of the queries it is told of.

    ``topics``: by name of a query, the name and path of the log it reads. Samples are JSON files in ``path``; a
    batch of a query has one, so a batch that runs again replaces its sample.
    """

    def __init__(self, spark: SparkSession, path: str, topics: dict[str, tuple[str, str]], ends: Callable[[str], dict[int, int]] = end_offsets):
        self.spark, self.path, self.topics, self.ends = spark, path, topics, ends
        # An empty sample makes a new folder readable.
        spark.createDataFrame([], SAMPLE).write.mode("ignore").json(f"{path}/none")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name not in self.topics:
            return
        try:
            topic, path = self.topics[progress.name]
            at = int(self.spark.sql(f"SELECT unix_micros(TIMESTAMP '{progress.timestamp}')").first()[0])
            latest = self.ends(path)
            rows = []
            for source in progress.sources:
                for partition, committed in json.loads(source.endOffset or "{}").items():
                    end = latest.get(int(partition), committed)
                    rows.append((progress.name, progress.batchId, at, topic, int(partition), int(committed), end))
            if rows:
                sample = self.spark.createDataFrame(rows, SAMPLE).coalesce(1)
                sample.write.mode("overwrite").json(f"{self.path}/query={progress.name}/batch={progress.batchId}")
        except Exception:
            # A listener must not stop the query it watches.
            log.exception("no lag sample for batch %s of %s", progress.batchId, progress.name)


def lag_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE).option("recursiveFileLookup", True).json(path)


def lag_series(samples: DataFrame, topics: tuple[str, ...]) -> DataFrame:
    """(query, batch_id, sample_us, topic, backlog) after every micro-batch; a null topic is the total."""
    by = ("query", "batch_id", "sample_us")
    ends = samples.select(*by, "topic", "partition", "end_offset")
    return consumer_lag(ends, samples.select(*by, "topic", "partition", "committed"), topics, by)


def throughput_series(samples: DataFrame) -> DataFrame:
    """(query, batch_id, read): messages each micro-batch moved on by, per query."""
    total = samples.groupBy("query", "batch_id").agg(F.sum("committed").alias("committed"))
    before = total.select("query", (F.col("batch_id") + 1).alias("batch_id"), F.col("committed").alias("before"))
    moved = F.col("committed") - F.coalesce("before", F.lit(0))
    return total.join(before, ["query", "batch_id"], "left").select("query", "batch_id", moved.alias("read"))
