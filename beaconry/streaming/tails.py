"""The newest N answers of each class, kept across micro-batches.

A class is spread over lanes by a hash of the sequence number, so that a class with most of the traffic
has many tasks. Each lane keeps its own newest N as list state, and a reader takes the newest N of a class's lanes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from beaconry.streaming.jobs import TRIGGER, each_batch, state_partitions
from beaconry.streaming.upsert import UpsertTable

LANES = 8
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"

KEPT = T.StructType([T.StructField("seq", T.LongType()), T.StructField("row", T.StringType())])
TAIL = T.StructType(
    [
        T.StructField("tail_id", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("lane", T.LongType()),
        T.StructField("rows", T.ArrayType(KEPT)),
    ]
)


class Tail(StatefulProcessor):
    """List state of a lane: its newest ``n`` rows, newest first."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", KEPT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        newest = {int(seq): row for seq, row in (self.kept.get() or ())}
        for part in rows:
            # Of each part only what may stay is looked at, so memory is bounded by n and a part.
            part = part.nlargest(self.n, "seq")
            newest.update(zip(part["seq"].astype(int), part["row"]))
            if len(newest) > self.n:
                newest = {seq: newest[seq] for seq in sorted(newest, reverse=True)[: self.n]}
        kept = [(seq, newest[seq]) for seq in sorted(newest, reverse=True)]
        self.kept.put(kept)
        name, lane = key
        tail = {"tail_id": [f"{name}/{lane}"], "class": [name], "lane": [lane], "rows": [[{"seq": s, "row": r} for s, r in kept]]}
        yield pd.DataFrame(tail)

    def close(self) -> None:
        pass


def tails_stream(rows: DataFrame, n: int, by: str, seq: str = "seq", lanes: int = LANES) -> DataFrame:
    """The tail of every lane that a batch changes (update mode). ``seq``: unique integers; a row that comes again changes nothing.

    Rows without a class or number are left out. The columns of a row are kept as JSON.
    """
    packed = rows.where(F.col(by).isNotNull() & F.col(seq).isNotNull()).select(
        F.col(by).alias("class"),
        F.pmod(F.xxhash64(seq), F.lit(lanes)).alias("lane"),
        F.col(seq).cast("long").alias("seq"),
        F.to_json(F.struct(*rows.columns)).alias("row"),
    )
    return packed.groupBy("class", "lane").transformWithStateInPandas(
        statefulProcessor=Tail(n), outputStructType=TAIL, outputMode="Update", timeMode="None"
    )


def tail_table(spark: SparkSession, path: str) -> UpsertTable:
    return UpsertTable(spark, path, TAIL, "tail_id")


def start_tail_job(
    rows: DataFrame,
    n: int,
    by: str,
    table: str,
    checkpoint: str,
    seq: str = "seq",
    lanes: int = LANES,
    trigger: dict | None = None,
    partitions: int | None = None,
) -> StreamingQuery:
    """Tails to a keyed table. Sets the session's state store to the one that keeps lists outside the heap."""
    spark = rows.sparkSession
    spark.conf.set(STATE_STORE, ROCKS)
    target = tail_table(spark, table)
    with state_partitions(spark, partitions):
        return (
            tails_stream(rows, n, by, seq, lanes)
            .writeStream.outputMode("update")
            .foreachBatch(each_batch(target.write_batch, "tails"))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or TRIGGER))
            .start()
        )


def newest(spark: SparkSession, table: str, n: int, schema: T.StructType | str) -> DataFrame:
    """The newest ``n`` rows of each class: of at most ``n`` rows of each of its lanes."""
    rows = tail_table(spark, table).latest().select("class", F.inline("rows"))
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("seq")))
    last = rows.withColumn("rank", rank).where(F.col("rank") <= n)
    return last.select(F.from_json("row", schema).alias("row")).select("row.*")
