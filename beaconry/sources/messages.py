"""Message streams: a Kafka topic, or a folder of JSON lines with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def topic_options(servers: str, topic: str, starting_offsets: str = "latest", **extra: str) -> dict[str, str]:
    """Options of a topic source. Offsets apply to a first start; a restart goes on from its checkpoint."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        "failOnDataLoss": "false",
        **extra,
    }


def read_topic(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Streaming messages of a topic; needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**options).load().select("value")


def read_folder(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Streaming messages from text files, one JSON document per line."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def read_folder_once(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
