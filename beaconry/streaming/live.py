"""A run's summary while it runs: partial aggregates of each micro-batch, merged when they are read.

A batch leaves one row per query type and event with counts and a latency sketch, in a folder of its own number; a
batch that is replayed replaces it. Counters come out exact, percentiles from merged sketches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from beaconry.functions import ratio
from beaconry.operators import summary
from beaconry.operators.events import success_latency
from beaconry.operators.windows import SKETCH_K
from beaconry.streaming.jobs import TRIGGER, each_batch

PARTIAL = "query_type string, event_type string, n long, latency_sum double, latency_n long, sketch binary"
POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
# Batches are folded into one this often, which bounds what a reader lists.
FOLD_EVERY = 100


def partials(events: DataFrame) -> DataFrame:
    """Mergeable aggregates of metric events, one row per query type and event."""
    latency = success_latency()
    return events.groupBy("query_type", "event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(latency).alias("latency_sum"),
        F.count(latency).alias("latency_n"),
        F.kll_sketch_agg_double(latency, F.lit(SKETCH_K)).alias("sketch"),
    )


def merge(parts: DataFrame, *by: str) -> DataFrame:
    return parts.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("latency_sum").alias("latency_sum"),
        F.sum("latency_n").alias("latency_n"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"),
    )


class LiveSummary:
    """Partials under ``batches/batch_id=<n>``. ``fold`` merges those up to one into ``folded/upto=<n>``; readers take the
    newest finished fold and the batches after it, so a fold that dies half way changes nothing."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        none = spark.createDataFrame([], PARTIAL)
        none.write.mode("ignore").parquet(f"{self.path}/batches/batch_id=-1")
        spark.createDataFrame([], "upto long").write.mode("ignore").parquet(f"{self.path}/folds")

    def write_batch(self, events: DataFrame, batch_id: int) -> None:
        partials(events).write.mode("overwrite").parquet(f"{self.path}/batches/batch_id={batch_id}")
        if batch_id - 1 - self.folded_upto() >= FOLD_EVERY:
            self.fold(batch_id - 1)

    def folded_upto(self) -> int:
        folds = self.spark.read.schema("upto long").parquet(f"{self.path}/folds")
        return folds.agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]

    def parts(self, upto: int | None = None) -> DataFrame:
        """All partials, or those up to a batch."""
        folded = self.folded_upto()
        if upto is not None and upto < folded:
            raise ValueError(f"batches up to {folded} have been folded together")
        rows = self.spark.read.schema(f"{PARTIAL}, batch_id long").parquet(f"{self.path}/batches").where(F.col("batch_id") > folded)
        if upto is not None:
            rows = rows.where(F.col("batch_id") <= upto)
        rows = rows.drop("batch_id")
        if folded >= 0:
            rows = rows.unionByName(self.spark.read.schema(PARTIAL).parquet(f"{self.path}/folded/upto={folded}"))
        return rows

    def fold(self, upto: int) -> None:
        if self.folded_upto() >= upto:
            return
        merge(self.parts(upto), "query_type", "event_type").write.mode("overwrite").parquet(f"{self.path}/folded/upto={upto}")
        self.spark.range(1).select(F.lit(upto).cast("long").alias("upto")).write.mode("append").parquet(f"{self.path}/folds")

    def event_counters(self, upto: int | None = None) -> DataFrame:
        """What ``summary.event_counters`` gives for all events so far."""
        return summary.counters_of(self.parts(upto).withColumnRenamed("n", "_rows"))

    def latency(self, upto: int | None = None) -> DataFrame:
        """(class, n, mean, p50, p95, p99) of answered requests per event and over ``all``."""
        answered = self.parts(upto).where("latency_n > 0")
        both = answered.withColumn("class", F.explode(F.array("event_type", F.lit("all"))))
        merged = merge(both, "class")
        values = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p) for p in POINTS.values()]))
        return merged.withColumn("values", values).select(
            "class",
            F.col("latency_n").alias("n"),
            (F.col("latency_sum") / F.col("latency_n")).alias("mean"),
            *[F.col("values").getItem(i).alias(name) for i, name in enumerate(POINTS)],
        )

    def by_query(self, upto: int | None = None) -> DataFrame:
        """(query_type, hits, total, hit_rate) per query type."""
        counts = self.event_counters(upto).where(F.col("query_type").isNotNull())
        total = F.col("hits") + F.col("misses") + F.col("recoveries")
        return counts.select("query_type", "hits", total.alias("total"), ratio(F.col("hits"), total, empty=None).alias("hit_rate"))


def start_live_summary(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Partials of a stream of metric events, batch by batch."""
    target = LiveSummary(events.sparkSession, path)
    return (
        events.writeStream.foreachBatch(each_batch(target.write_batch, "summary"))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or TRIGGER))
        .start()
    )
