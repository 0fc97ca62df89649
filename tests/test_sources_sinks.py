import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconry import sinks
from beaconry.functions import cache_key, safe_label, ttl_seconds
from beaconry.operators import scenarios
from beaconry.schemas import SNAPSHOT
from beaconry.session import materialize, scratch_path
from beaconry.sources import messages, tables
from beaconry.streaming.upsert import UpsertTable

HEADER = "latitude,longitude,area_in_meters,confidence"


def test_buildings_from_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text(f"{HEADER}\n-33.4,-70.6,12.5,0.9\n-33.5,-70.7,,\n")
    rows = tables.read_buildings(spark, str(tmp_path / "b.csv")).collect()
    assert [tuple(r) for r in rows] == [(-33.4, -70.6, 12.5, 0.9), (-33.5, -70.7, None, None)]


def test_buildings_from_gzip_with_more_columns(spark, tmp_path):
    header = ("latitude", "longitude", "area_in_meters", "confidence", "geometry", "code")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as out:
        out.write(",".join(header) + '\n-33.4,-70.6,12.5,0.9,"POLYGON((1 2, 3 4))",x\n')
    rows = tables.read_buildings(spark, str(tmp_path / "b.csv.gz"), header, spread=3)
    assert rows.rdd.getNumPartitions() == 3
    assert [tuple(r) for r in rows.collect()] == [(-33.4, -70.6, 12.5, 0.9)]


def test_buildings_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "b.csv").write_text("longitude,latitude,area_in_meters,confidence\n-70.6,-33.4,12.5,0.9\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_buildings(spark, str(tmp_path / "b.csv")).collect()


def test_csv_round_trip_has_a_header_per_file(spark, tmp_path):
    rows = spark.createDataFrame([(-33.4, -70.6, 1.0, 0.5), (-33.5, -70.7, 2.0, 0.6)], "latitude double, longitude double, area_in_meters double, confidence double")
    path = str(tmp_path / "out")
    sinks.write_buildings(rows.repartition(2), path)
    sinks.write_buildings(rows, path)
    assert tables.read_buildings(spark, path).count() == 4


def test_raw_events_from_json(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"event":"hit","ts":1.5,"extra":1}\n{"query_type":"q1"}\n')
    rows = tables.read_raw_events(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r["event"], r["ts"], r["query_type"]) for r in rows] == [(None, None, "q1"), ("hit", 1.5, None)]
    assert tables.read_raw_events(spark, str(tmp_path), streaming=True).isStreaming


def snapshot(label=None, **fields):
    return {**({"label": label} if label else {}), "totals": {"hits": 3}, "throughput_qps_total": 2.5, **fields}


def test_snapshots_wrapped_plain_and_named_by_file(spark, tmp_path):
    (tmp_path / "snap_one.json").write_text(json.dumps({"path": "x", "summary": snapshot("first")}, indent=2))
    (tmp_path / "snap_two.json").write_text(json.dumps(snapshot(), indent=2))
    rows = {r["label"]: r for r in tables.load_snapshots(spark, str(tmp_path)).collect()}
    assert set(rows) == {"first", "two"}
    assert {r["totals"]["hits"] for r in rows.values()} == {3}
    assert rows["two"]["latency_ms_hit"] is None


def test_snapshot_files_carry_time_and_label(spark, tmp_path):
    empty = spark.createDataFrame([], SNAPSHOT)
    one = spark.createDataFrame([(None,) * len(SNAPSHOT)], SNAPSHOT).withColumns(
        {"label": F.lit("a b/c"), "snapshot_ts": F.lit(1700000000.75)}
    )
    sinks.write_snapshots(empty.unionByName(one), str(tmp_path / "s"))
    assert [p.name for p in (tmp_path / "s").iterdir() if p.is_dir()] == ["file=1700000000_a_b_c"]
    assert tables.load_snapshots(spark, str(tmp_path / "s")).first()["label"] == "a b/c"


def test_topic_and_index_options():
    assert messages.topic_options("k:9092", "metrics-topic", "earliest", maxOffsetsPerTrigger="5") == {
        "kafka.bootstrap.servers": "k:9092",
        "subscribe": "metrics-topic",
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
        "maxOffsetsPerTrigger": "5",
    }
    assert sinks.topic_sink_options("k:9092", "t")["topic"] == "t"
    options = sinks.index_options("es")
    assert options["es.mapping.id"] == "window_id" and options["es.write.operation"] == "upsert"


def test_scalar_texts(spark):
    row = spark.range(1).select(
        safe_label(F.lit("a b/c d")).alias("label"),
        ttl_seconds(F.lit("q4")).alias("q4"),
        ttl_seconds(F.lit("other")).alias("other"),
        ttl_seconds(F.lit(None).cast("string")).alias("none"),
        cache_key(
            F.lit("q4"),
            {"zone_id": F.lit(None), "zone_a": F.lit("Z1"), "zone_b": F.lit("Z2"), "confidence_min": F.lit(0.35), "bins": F.lit(1)},
        ).alias("key"),
    ).first()
    assert tuple(row) == ("a_b_c_d", 120, 300, 300, "compare:density:Z1:Z2:conf=0.35")


SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.LongType()), T.StructField("note", T.StringType())])


def content(table, **at):
    return {r["key"]: r["value"] for r in table.latest(**at).collect()}


def test_keyed_table(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), SCHEMA, "key")
    assert content(table) == {}

    def batch(n, **rows):
        table.write_batch(spark.createDataFrame([(v, k) for k, v in rows.items()], "value int, key string"), n)

    batch(0, a=1, b=1)
    batch(1, b=2, c=2)
    assert content(table) == {"a": 1, "b": 2, "c": 2}
    batch(1, b=2, c=2)  # the same batch once more
    assert content(table) == {"a": 1, "b": 2, "c": 2} and content(table, upto=0) == {"a": 1, "b": 1}
    batch(2, a=3)
    table.compact(1)
    assert table.compacted_upto() == 1 and content(table) == {"a": 3, "b": 2, "c": 2}
    batch(1, b=99)  # folded already: the base stands for it
    batch(3, b=4)
    assert content(table) == {"a": 3, "b": 4, "c": 2}
    table.compact(3)
    assert content(UpsertTable(spark, str(tmp_path / "t"), SCHEMA, "key")) == {"a": 3, "b": 4, "c": 2}
    with pytest.raises(ValueError):
        table.latest(upto=0)


def test_keyed_table_without_commit_ignores_the_base(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), SCHEMA, "key")
    table.write_batch(spark.createDataFrame([("a", 1)], "key string, value long"), 0)
    junk = spark.createDataFrame([("a", 7, None, 0)], T.StructType([*SCHEMA.fields, T.StructField("batch_id", T.LongType())]))
    junk.write.parquet(str(tmp_path / "t" / "base" / "upto=0"))
    assert content(table) == {"a": 1}


def test_rows_without_key_are_refused(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), SCHEMA, "key")
    with pytest.raises(ValueError):
        table.write_batch(spark.createDataFrame([(1,)], "value long"), 0)
    with pytest.raises(Exception, match="key is null"):
        table.write_batch(spark.createDataFrame([(None, 1)], "key string, value long"), 0)


def test_recovery_time(spark):
    def run(label, *points):
        return (label, {"backlog_history": [{"time_offset": float(t), "backlog": b} for t, b in points]})

    rows = [run("empties", (30, 0), (61, 5), (64, 0), (70, 0)), run("never", (30, 0), (90, 7)), run("none")]
    frame = spark.createDataFrame(rows, f"label string, extra {SNAPSHOT['extra'].dataType.simpleString()}")
    got = {r["label"]: r["recovery_sec"] for r in scenarios.recovery_time(frame).collect()}
    assert got == {"empties": 4.0, "never": 30.0}
    assert scenarios.backlog_history(frame).count() == 6


def test_scratch_paths_are_new_and_follow_the_session(spark, monkeypatch):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        assert scratch_path(spark, "x").startswith(shared)
    assert materialize(spark.range(3).toDF("n"), "numbers").count() == 3
