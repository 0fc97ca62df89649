"""Message logs: offsets, restarts, lost segments, limits, lag; and late rows beside a windowed stream."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from beaconry.operators.events import decode_events
from beaconry.operators.summary import consumer_lag
from beaconry.sources import logs, messages
from beaconry.streaming import jobs, lag, late
from tests.test_streaming import event, put


def add(spark, path, low, high, partitions=2):
    rows = spark.range(low, high).select((F.col("id") % 5).alias("key"), F.col("id").alias("value"))
    logs.append(rows.repartition(3), path, partitions)


def read(spark, path, folder, **options):
    query = (
        logs.read_log_stream(spark, path, **options)
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(120)
    return [p.numInputRows for p in query.recentProgress if p.numInputRows]


def values(spark, folder):
    return sorted(int(r["value"]) for r in spark.read.parquet(f"{folder}/out").collect())


def test_offsets_follow_each_other_and_keys_keep_their_partition(spark, tmp_path):
    path = f"{tmp_path}/topic"
    add(spark, path, 0, 100)
    add(spark, path, 100, 130)
    rows = logs.read_log(spark, path).collect()
    assert sorted(int(r["value"]) for r in rows) == list(range(130))
    for partition, end in logs.end_offsets(path).items():
        assert sorted(r["offset"] for r in rows if r["partition"] == partition) == list(range(end))
    assert all(len({r["partition"] for r in rows if int(r["value"]) % 5 == k}) == 1 for k in range(5))
    later = logs.read_log(spark, path, startingOffsets='{"0": 5, "1": 7}', endingOffsets='{"0": 9, "1": 8}').collect()
    assert sorted((r["partition"], r["offset"]) for r in later) == [(0, 5), (0, 6), (0, 7), (0, 8), (1, 7)]


def test_a_restart_goes_on_at_the_stored_offsets(spark, tmp_path):
    path, folder = f"{tmp_path}/topic", str(tmp_path)
    add(spark, path, 0, 50)
    read(spark, path, folder, startingOffsets="earliest")
    add(spark, path, 50, 80)
    # Where a stream first starts does not matter any more.
    assert sum(read(spark, path, folder, startingOffsets="latest")) == 30
    assert read(spark, path, folder) == []
    assert values(spark, folder) == list(range(80))


def test_latest_skips_what_is_there(spark, tmp_path):
    path, folder = f"{tmp_path}/topic", str(tmp_path)
    add(spark, path, 0, 10)
    assert read(spark, path, folder, startingOffsets="latest") == []
    add(spark, path, 10, 14)
    read(spark, path, folder, startingOffsets="latest")
    assert values(spark, folder) == [10, 11, 12, 13]


def test_lost_segments_fail_or_are_passed_over(spark, tmp_path):
    path, folder = f"{tmp_path}/topic", str(tmp_path)
    add(spark, path, 0, 40, partitions=1)
    add(spark, path, 40, 60, partitions=1)
    os.remove(logs.segments(path)[0][0][2])
    with pytest.raises(PySparkException, match="are gone"):
        logs.read_log(spark, path, startingOffsets='{"0": 0}').count()
    assert logs.read_log(spark, path, startingOffsets='{"0": 0}', failOnDataLoss="false").count() == sum(s[1] for s in logs.segments(path)[0])


def test_limit_holds_in_a_batch_and_after_a_restart(spark, tmp_path):
    path, folder = f"{tmp_path}/topic", str(tmp_path)
    add(spark, path, 0, 60)
    options = {"startingOffsets": "earliest", "maxOffsetsPerTrigger": "10", "progress": f"{folder}/progress"}
    sizes = [sum(read(spark, path, folder, **options)) for _ in range(6)]
    assert sizes[0] == 20 and max(sizes) <= 20 and sum(sizes) == 60
    assert values(spark, folder) == list(range(60))


def test_lag_series_from_samples(spark):
    rows = [("q", b, 1000 * b, "t", p, min(10 * (b + 1), 25), 25 + p) for b in range(3) for p in range(2)]
    samples = spark.createDataFrame(rows, lag.SAMPLE)
    got = {(r["batch_id"], r["topic"]): r["backlog"] for r in lag.lag_series(samples, ("t",)).collect()}
    assert got == {(b, t): 2 * max(0, 25 - 10 * (b + 1)) + 1 for b in range(3) for t in ("t", None)}
    one = samples.where("batch_id = 1")
    plain = consumer_lag(one.select("topic", "partition", "end_offset"), one.select("topic", "partition", "committed"), ("t",))
    assert {r["topic"]: r["backlog"] for r in plain.collect()} == {t: got[1, t] for t in ("t", None)}
    assert sorted(r["read"] for r in lag.throughput_series(samples).collect()) == [10, 20, 20]


def test_lag_listener_writes_a_sample_for_each_batch(spark, tmp_path):
    from beaconry.plans import stream_queries as S

    rows = S.stream_consumer_lag(spark, "/root/testdata/sf0.001").where("topic is null").sort("batch_id").collect()
    backlog = [r["backlog"] for r in rows]
    assert len(rows) >= S.LOG_BATCHES and backlog == sorted(backlog, reverse=True) and backlog[-1] == 0


def test_late_rows_are_kept_over_a_restart_and_a_replay(spark, tmp_path):
    folder = str(tmp_path)
    for number, times in enumerate(([5, 6], [200], [201, 150], [7, 202, 165], [8, 203])):
        put(f"{folder}/in", number, [event(t) for t in times])

    def run():
        arriving = decode_events(messages.read_folder(spark, f"{folder}/in", files_per_trigger=1))
        query = late.start_late_job(arriving, f"{folder}/side", f"{folder}/checkpoint", trigger=jobs.UNTIL_DONE)
        assert query.awaitTermination(120)
        return late.LateRows(spark, f"{folder}/side", arriving.schema, "10 seconds", "30 seconds")

    target = run()
    # The watermark of the batch before: none, none, 0, 170, 171.
    assert sorted(r["ts"] for r in target.read().collect()) == [7.0, 8.0, 165.0]
    put(f"{folder}/in", 5, [event(9), event(300)])
    target = run()
    target.write_batch(decode_events(spark.read.text(f"{folder}/in/005.txt")), 5)
    assert sorted(r["ts"] for r in target.read().collect()) == [7.0, 8.0, 9.0, 165.0]
