import json
import os
import time

import pytest
from pyspark.sql import functions as F

from beaconry.operators import requests as Q
from beaconry.operators import windows as W
from beaconry.operators.events import decode_events
from beaconry.schemas import ATTEMPT
from beaconry.sources import messages
from beaconry.streaming import jobs

KINDS = ["hit", "miss", "recovery", "retry", "dlq", "error"]
STATUS = {"retry": "pending", "dlq": "failed", "error": "failed"}


def event(ts, i=0):
    kind = KINDS[i % 6]
    return {
        "ts": float(ts),
        "event_type": kind,
        "latency_ms": float(i % 97) if kind in KINDS[:3] else None,
        "cache_hit": {"hit": True, "miss": False, "recovery": False}.get(kind),
        "status": STATUS.get(kind, "success"),
    }


def put(folder, number, events):
    """One file; the stream takes files by modification time."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{number:03d}.txt")
    with open(path, "w") as out:
        out.writelines(json.dumps(e) + "\n" for e in events)
    os.utime(path, (1_700_000_000 + 10 * number, 1_700_000_000 + 10 * number))


def run(spark, folder, **options):
    query = jobs.start_window_job(
        messages.read_folder(spark, f"{folder}/in", files_per_trigger=1),
        f"{folder}/table",
        f"{folder}/checkpoint",
        trigger=jobs.UNTIL_DONE,
        partitions=2,
        compact_every=2,
        **options,
    )
    assert query.awaitTermination(180)
    return query


def stored(spark, folder):
    return sorted(jobs.window_table(spark, f"{folder}/table").latest().collect())


def batch(spark, folder, **options):
    return sorted(W.window_metrics(decode_events(messages.read_folder_once(spark, f"{folder}/in")), **options).collect())


def test_stream_in_pieces_equals_batch_also_after_a_restart(spark, tmp_path):
    folder = str(tmp_path)
    events = [event(1000 + i * 0.7, i * i + i // 5) for i in range(300)]
    put(f"{folder}/in", 0, events[:120])
    put(f"{folder}/in", 1, events[120:180] + [{"ts": "x"}])
    first = run(spark, folder)
    assert sum(p.numInputRows for p in first.recentProgress) == 181
    put(f"{folder}/in", 2, events[180:])
    second = run(spark, folder)
    assert sum(p.numInputRows for p in second.recentProgress) == 120
    assert jobs.window_table(spark, f"{folder}/table").compacted_upto() > 0
    assert stored(spark, folder) == batch(spark, folder)


def test_tumbling_stream(spark, tmp_path):
    folder = str(tmp_path)
    put(f"{folder}/in", 0, [event(1000 + i, i) for i in range(150)])
    run(spark, folder, size="30 seconds", slide="30 seconds")
    assert stored(spark, folder) == batch(spark, folder, size="30 seconds", slide="30 seconds")


def test_late_events_are_dropped_one_batch_after_the_watermark_moved(spark, tmp_path):
    folder = str(tmp_path)
    for number, times in enumerate(([5, 6], [200], [201], [7, 202])):
        put(f"{folder}/in", number, [event(t) for t in times])
    query = run(spark, folder)
    dropped = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    assert dropped > 0
    counts = {d["window_id"]: d["count_events"] for d in stored(spark, folder)}
    assert counts["0"] == 2


def test_empty_batches_are_skipped_and_batches_are_replaced(spark, tmp_path):
    calls = []
    sink = jobs.each_batch(lambda rows, n: calls.append((n, rows.count())), "test")
    sink(spark.range(0), 0)
    sink(spark.range(3), 1)
    assert calls == [(1, 3)]


ATTEMPTS = [
    # id, type, zone, retries, mode, cached, failed -> route, event, next retry count
    ((1, "q1", "Z1", 0, "queue", True, False), ("done", "hit", None)),
    ((2, "q1", "Z1", 0, "queue", False, False), ("done", "miss", None)),
    ((3, "q1", "Z1", 2, "queue", True, False), ("done", "recovery", None)),
    ((4, "q2", "Z1", 1, "queue", False, False), ("done", "recovery", None)),
    ((5, "q3", "Z1", 2, "queue", False, True), ("retry", "retry", 3)),
    ((6, "q3", "Z1", 3, "queue", False, True), ("dlq", "dlq", 3)),
    ((7, "q3", None, 0, "queue", False, True), ("dropped", None, None)),
    ((8, "q9", "Z1", 0, "sync", False, False), ("rejected", None, None)),
    ((9, "q1", "Z1", 0, "sync", False, True), ("failed", "error", None)),
    ((10, "q1", "Z1", 0, "queue", True, True), ("done", "hit", None)),
]


@pytest.fixture(scope="module")
def attempts(spark):
    rows = [
        (i, kind, (zone, None, None, 0.5, None), retries, 1_000_000 * i, 1_000_000 * i + 2_500, mode, cached, failed, "boom" if failed else None, 0.5, 40.0)
        for (i, kind, zone, retries, mode, cached, failed), _ in ATTEMPTS
    ]
    return spark.createDataFrame(rows, ATTEMPT)


def test_routes(attempts):
    got = {r["query_id"]: r for r in Q.route_attempts(attempts).collect()}
    for (i, *_), want in ATTEMPTS:
        assert (got[i]["route"], got[i]["event"], got[i]["next_retry_count"]) == want
    assert got[1]["latency_ms"] == 2.5 and got[1]["ttl"] is None and got[4]["ttl"] == 300
    events = Q.attempt_events(Q.route_attempts(attempts)).collect()
    assert len(events) == 8
    timed = {(e["event"], e["lookup_ms"], e["compute_ms"]) for e in events}
    assert {("hit", 0.5, None), ("miss", 0.5, 40.0), ("recovery", 0.5, 40.0), ("retry", None, None), ("dlq", None, None)} <= timed


def test_routing_stream_writes_each_topic_and_survives_a_replay(spark, attempts, tmp_path):
    folder = str(tmp_path)
    attempts.repartition(1).select(F.to_json(F.struct("*")).alias("value")).write.text(f"{folder}/in")
    source = messages.read_folder(spark, f"{folder}/in")
    query = jobs.start_routing_job(source, f"{folder}/out", f"{folder}/checkpoint", trigger=jobs.UNTIL_DONE)
    assert query.awaitTermination(120)
    # The batch once more, as after a crash between write and commit.
    jobs.route_batch(Q.route_attempts(attempts), 0, f"{folder}/out")

    def topic(name):
        return [json.loads(r["value"]) for r in spark.read.text(f"{folder}/out/{name}").collect()]

    (again,), (dead,) = topic(Q.RETRY_TOPIC), topic(Q.DEAD_LETTER_TOPIC)
    assert (again["query_id"], again["retry_count"], again["params"]["zone_id"]) == (5, 3, "Z1")
    assert (dead["query_id"], dead["retry_count"], dead["failed_us"], dead["error"]) == (6, 3, 6_002_500, "boom")
    assert len(topic("events")) == 8
    assert spark.read.parquet(f"{folder}/out/routed").count() == len(ATTEMPTS)
