"""Session settings and shared scratch folders."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# The registered queries put these on any session they are given.
QUERY_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Last-N per class keeps thousands of rows: let the limit run before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
    # A task meets some hundred windows. Their sketches fit in memory; the default
    # of 128 groups makes it sort every event instead.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "512",
}

# Set when a session is built here; a cluster's own settings win over them.
BUILD_CONF = {
    **QUERY_CONF,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**BUILD_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Put the settings of the registered queries onto an existing session."""
    for key, value in QUERY_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder every executor can reach, below ``spark.checkpoint.dir``.

    Where all tasks run in the driver's process the warehouse does as well. On a cluster its default
    is a folder of one machine, so there the setting must be made.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[.*\])?$", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read from there.

    For small results that several branches of a plan use: each branch would
    otherwise prune and compute its own copy. The files survive lost executors,
    and their size tells the optimizer when a broadcast is safe. ``options`` are the writer's.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def micros(spark: SparkSession, *intervals: str) -> list[int]:
    """Microseconds of intervals as Spark reads them, such as ``1 minute 30 seconds``."""
    epoch = "timestamp_micros(0)"
    return list(spark.sql("SELECT " + ", ".join(f"unix_micros({epoch} + INTERVAL '{i}')" for i in intervals)).first())
