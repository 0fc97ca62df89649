"""Streams that keep panes, joins, tails and partial sums: several micro-batches, restarts, late and repeated rows."""

import contextlib
import io
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from beaconry.operators import history, replay, summary
from beaconry.operators import windows as W
from beaconry.operators.events import decode_events, parse_json
from beaconry.plans import inputs, request_queries, stream_queries
from beaconry.sources import messages
from beaconry.streaming import fills, jobs, live, panes, state, tails
from tests.test_streaming import event, put


def stream(spark, folder):
    return messages.read_folder(spark, folder, files_per_trigger=1)


def done(query):
    assert query.awaitTermination(180)
    return [p for p in query.recentProgress if p.numInputRows]


def pane_job(spark, folder, **options):
    return panes.start_pane_job(
        stream(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint", trigger=jobs.UNTIL_DONE, partitions=2, **options
    )


END = {"ts": 50_000.0, "event_type": "end"}


@pytest.mark.parametrize("options", [{}, {"size": "45 seconds", "slide": "30 seconds"}])
def test_panes_over_batches_and_a_restart_equal_the_batch_windows(spark, tmp_path, options):
    folder = str(tmp_path)
    events = [event(1000 + i * 0.7, i * i + i // 5) for i in range(300)]
    put(f"{folder}/in", 0, events[:120])
    put(f"{folder}/in", 1, events[120:180] + [{"ts": "x"}])
    assert len(done(pane_job(spark, folder, **options))) == 2
    early = panes.read_closed_windows(spark, f"{folder}/out").count()
    put(f"{folder}/in", 2, events[180:])
    put(f"{folder}/in", 3, [END])
    assert len(done(pane_job(spark, folder, **options))) == 2
    got = panes.read_closed_windows(spark, f"{folder}/out").sort("window_start").collect()
    whole = decode_events(messages.read_folder_once(spark, f"{folder}/in")).where(F.col("event_type") != "end")
    want = W.window_metrics_panes(whole, **options).sort("window_start").collect()
    assert got == want and 0 < early < len(want)


def test_state_before_and_after_a_restart_is_the_open_windows(spark, tmp_path):
    folder = str(tmp_path)

    def run():
        query = jobs.start_window_job(
            stream(spark, f"{folder}/in"), f"{folder}/table", f"{folder}/checkpoint", trigger=jobs.UNTIL_DONE, partitions=2
        )
        done(query)

    def open_now(behind):
        """Windows of all events so far that the watermark has not passed."""
        whole = decode_events(messages.read_folder_once(spark, f"{folder}/in"))
        counted = W.window_counts(whole).select("window.start", "window.end", "count_events")
        return sorted(tuple(r) for r in counted.where(F.col("end") > F.timestamp_seconds(F.lit(behind))).collect())

    put(f"{folder}/in", 0, [event(1000 + i, i) for i in range(100)])
    run()
    before = sorted(tuple(r) for r in state.open_windows(spark, f"{folder}/checkpoint").collect())
    assert before == open_now(1099 - 30) and before
    put(f"{folder}/in", 1, [event(1090 + i, i) for i in range(60)])
    run()
    after = sorted(tuple(r) for r in state.open_windows(spark, f"{folder}/checkpoint").collect())
    assert after == open_now(1149 - 30) and after != before
    last = state.state_operators(spark, f"{folder}/checkpoint").first()
    assert (last["operatorName"], last["numPartitions"]) == ("stateStoreSave", 2)
    # The state of an earlier micro-batch can still be read.
    assert state.open_windows(spark, f"{folder}/checkpoint", batch_id=0).count() > 0


def test_events_are_not_expanded(spark, tmp_path):
    folder = str(tmp_path)
    put(f"{folder}/in", 0, [event(1000 + i, i) for i in range(40)])
    query = pane_job(spark, folder)
    done(query)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        query.explain()
    plan = out.getvalue()
    # From the sink down: windows, the panes spread over them, and the panes, whose input is the events.
    spread, saves = plan.index("Expand"), [m.start() for m in re.finditer("StateStoreSave", plan)]
    assert plan.count("Expand") == 1 and len(saves) == 2 and saves[0] < spread < saves[1]


def test_fills_over_batches_and_a_restart_equal_the_batch_join(spark, tmp_path):
    folder = str(tmp_path)
    second = 1_000_000
    # Two keys; answers live for a minute, some overlap, some have run out.
    filled = [(f"k{i % 2}", i * 50 * second) for i in range(1, 13)] + [("k0", 130 * second), ("k0", 130 * second), (None, 1)]
    asked = [(i, ("k0", "k1", "k2", None)[i % 4], 60 * second, i * 13 * second) for i in range(1, 50)]
    asked += [(100, "k0", 60 * second, 100 * second), (101, "k0", 60 * second, 160 * second)]

    def write(low, high, number, last=False):
        rows = [dict(zip(("query_id", "key", "ttl_us", "created_us"), r)) for r in asked if low <= r[3] < high]
        given = [dict(zip(("key", "fill_us"), r)) for r in filled if low <= r[1] < high]
        if last:
            rows.append({"query_id": -1, "key": "end", "ttl_us": 1, "created_us": 10**6 * second})
            given.append({"key": "end", "fill_us": 10**6 * second})
        put(f"{folder}/asked", number, rows)
        put(f"{folder}/given", number, given)

    def run():
        query = fills.start_fills_job(
            parse_json(stream(spark, f"{folder}/asked"), fills.REQUEST),
            parse_json(stream(spark, f"{folder}/given"), fills.FILL),
            f"{folder}/out",
            f"{folder}/checkpoint",
            trigger=jobs.UNTIL_DONE,
            partitions=2,
        )
        return done(query), query.recentProgress[-1]

    for number in range(3):
        write(number * 100 * second, (number + 1) * 100 * second, number)
    assert len(run()[0]) == 3
    write(300 * second, 10**5 * second, 3)
    write(10**5 * second, 10**5 * second, 4, last=True)
    # When both sides have moved on, their last rows are all that is left.
    batches, last = run()
    assert len(batches) == 2 and 0 < sum(s.numRowsTotal for s in last.stateOperators) <= 4
    got = spark.read.parquet(f"{folder}/out").sort("query_id").collect()
    requests = spark.createDataFrame(asked, fills.REQUEST)
    want = replay.requests_to_fills(requests, spark.createDataFrame(filled, fills.FILL)).sort("query_id")
    assert got == want.select(*spark.read.parquet(f"{folder}/out").columns).collect()
    assert {r["fill_us"] is None for r in got} == {True, False}


ROW = "seq long, event_type string, latency_ms double"


def test_tails_over_batches_and_a_restart(spark, tmp_path):
    folder = str(tmp_path)
    rows = [{"seq": (i * 37) % 400, "event_type": ("hit", "hit", "hit", "miss")[i % 4], "latency_ms": i / 2} for i in range(400)]

    def run():
        arriving = parse_json(stream(spark, f"{folder}/in"), ROW)
        query = tails.start_tail_job(
            arriving, 20, "event_type", f"{folder}/table", f"{folder}/checkpoint", trigger=jobs.UNTIL_DONE, partitions=2
        )
        return done(query)

    put(f"{folder}/in", 0, rows[:150])
    put(f"{folder}/in", 1, rows[150:300] + [{"seq": 7}, {"event_type": "hit"}])
    assert len(run()) == 2
    # The rest, and rows that came before.
    put(f"{folder}/in", 2, rows[300:] + rows[200:320])
    assert len(run()) == 1
    got = tails.newest(spark, f"{folder}/table", 20, ROW)
    want = history.last_n_per_class(spark.createDataFrame([tuple(r.values()) for r in rows], ROW), 20, "event_type", ("hit", "miss"))
    assert sorted(got.collect()) == sorted(want.select("seq", "event_type", "latency_ms").collect())
    kept = tails.tail_table(spark, f"{folder}/table").latest().select(F.size("rows").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert kept[0] <= 20 and kept[1] <= 2 * tails.LANES
    # What Spark's own state holds, after the restart: no more than the newest of each lane.
    state = (
        spark.read.format("statestore")
        .option("stateVarName", "kept")
        .option("path", f"{folder}/checkpoint")
        .load()
    )
    sizes = state.groupBy("key").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 20 and sizes[1] == kept[1]


def test_live_summary_after_every_batch(spark, tmp_path):
    folder = str(tmp_path)
    batches = [[{**event(1000 + i, i + 7 * n), "query_type": f"Q{i % 3}"} for i in range(60)] for n in range(3)]
    for n, rows in enumerate(batches):
        put(f"{folder}/in", n, rows)
        arriving = decode_events(stream(spark, f"{folder}/in"))
        done(live.start_live_summary(arriving, f"{folder}/live", f"{folder}/checkpoint", trigger=jobs.UNTIL_DONE))
        target = live.LiveSummary(spark, f"{folder}/live")
        whole = decode_events(messages.read_folder_once(spark, f"{folder}/in"))
        want = sorted(summary.event_counters(whole).collect(), key=str)
        assert sorted(target.event_counters().collect(), key=str) == want
        # The batch again, as after a crash between write and commit.
        target.write_batch(decode_events(spark.read.text(os.path.join(folder, "in", f"{n:03d}.txt"))), n)
        assert sorted(target.event_counters().collect(), key=str) == want
        target.fold(n - 1)
        assert sorted(target.event_counters().collect(), key=str) == want
    assert target.folded_upto() == 1
    with pytest.raises(ValueError):
        target.parts(upto=0)
    answered = whole.where("status = 'success'")
    exact = {r["event_type"]: r for r in answered.groupBy("event_type").agg(F.percentile_approx("latency_ms", 0.5).alias("p50"), F.avg("latency_ms").alias("mean"), F.count("*").alias("n")).collect()}
    for row in target.latency().where(F.col("class") != "all").collect():
        assert (row["n"], row["p50"], round(row["mean"], 9)) == (exact[row["class"]]["n"], exact[row["class"]]["p50"], round(exact[row["class"]]["mean"], 9))
    assert {r["query_type"]: r["total"] for r in target.by_query().collect()} == {
        r["query_type"]: r["count"] for r in answered.groupBy("query_type").count().collect()
    }


def test_registered_streams_take_several_batches(spark, tmp_path):
    from beaconry.plans import stream_queries as S

    folder = S._metric_messages(spark, "/root/testdata/sf0.001", f"{tmp_path}/messages")
    query = S._by_stretch(spark, folder).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert len(done(query)) >= S.SLICES
    assert json.loads(spark.read.text(folder).first()["value"])["ts"]


def test_state_of_requests_beside_fills_is_bounded_where_there_are_many(spark, tmp_path, monkeypatch):
    orders = spark.range(2400).selectExpr("7 * id AS o_orderkey", "id % 70 AS o_custkey")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    started, start = [], fills.start_fills_job
    monkeypatch.setattr(stream_queries, "STRETCH_ROWS", 200)
    monkeypatch.setattr(fills, "start_fills_job", lambda *a, **k: started.append(start(*a, **k)) or started[0])
    got = stream_queries.stream_requests_to_fills(spark, str(tmp_path)).sort("query_id").collect()
    assert got == request_queries.requests_to_fills(spark, str(tmp_path)).sort("query_id").collect()
    assert {r["fill_us"] is None for r in got} == {True, False}
    progress = started[0].recentProgress
    held = max(s.numRowsTotal for p in progress for s in p.stateOperators if s.operatorName == "symmetricHashJoin")
    assert held < 0.7 * sum(p.numInputRows for p in progress)


def test_messages_are_computed_once(spark, tmp_path):
    computed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    rows = spark.range(1000).mapInArrow(count, "id long")
    at = F.lit(inputs.BASE_US) + F.col("id") * 1000
    stream_queries._publish(rows, at, inputs.BASE_US + 1_000_000, f"{tmp_path}/out")
    back = messages.read_folder_once(spark, f"{tmp_path}/out").collect()
    assert sorted(json.loads(r["value"])["id"] for r in back) == list(range(1000))
    assert computed.value == 1000
