"""Writers: message topics, CSV, snapshots, and the options of an external document index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.functions import safe_label
from beaconry.operators.events import encode_events
from beaconry.schemas import METRIC_EVENT


def publish_events(events: DataFrame, path: str) -> None:
    """Metric events as JSON lines in a folder."""
    encode_events(events).write.mode("append").text(path)


def publish_events_to_topic(events: DataFrame, servers: str, topic: str) -> None:
    """Metric events to a Kafka topic."""
    write_topic(events.select(*METRIC_EVENT.fieldNames()), servers, topic)


def topic_sink_options(servers: str, topic: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.acks": "1",
        "kafka.linger.ms": "50",
    }


def write_topic(rows: DataFrame, servers: str, topic: str) -> None:
    """Rows as JSON messages to a Kafka topic; needs Spark's Kafka connector on the class path."""
    messages = rows.select(F.to_json(F.struct("*")).alias("value"))
    messages.write.format("kafka").options(**topic_sink_options(servers, topic)).save()


def write_json_messages(rows: DataFrame, path: str) -> None:
    """Rows as JSON messages; replaces what an earlier run of the same batch left."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_buildings(buildings: DataFrame, path: str, compression: str | None = None) -> None:
    """Buildings as CSV files, each with a header; ``gzip`` compresses them."""
    buildings.write.mode("append").option("header", True).csv(path, compression=compression)


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """One folder ``file=<epoch>_<label>`` with one JSON document per snapshot. ``extra_all`` (a variant), where it is
    there, is written as ``extra``."""
    if "extra_all" in snapshots.columns:
        snapshots = snapshots.withColumn("extra", F.col("extra_all")).drop("extra_all")
    name = F.concat_ws("_", F.floor("snapshot_ts").cast("string"), safe_label(F.col("label")))
    named = snapshots.withColumn("file", name)
    named.repartition("file").write.mode("append").partitionBy("file").json(path)


def index_options(nodes: str, port: int = 9200, key: str = "window_id") -> dict[str, str]:
    """Options of an Elasticsearch writer that replaces documents by their key."""
    return {
        "es.nodes": nodes,
        "es.port": str(port),
        "es.nodes.wan.only": "true",
        "es.mapping.id": key,
        "es.write.operation": "upsert",
    }


def write_index(documents: DataFrame, index: str, options: dict[str, str]) -> None:
    """Documents to an Elasticsearch index; needs its Spark connector on the class path."""
    documents.write.format("org.elasticsearch.spark.sql").options(**options).mode("append").save(index)
