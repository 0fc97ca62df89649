import math

import pytest
from pyspark.sql import functions as F

from beaconry.operators import events as E
from beaconry.operators import windows as W
from beaconry.schemas import METRIC_EVENT, RAW_EVENT


def messages(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def raw(spark, rows):
    names = RAW_EVENT.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RAW_EVENT)


def test_messages_that_do_not_parse_are_dropped(spark):
    decoded = E.decode_events(messages(spark, "{bad", "[]", '{"ts":"x","status":"ok"}', '{"status":"ok"}'))
    assert decoded.count() == 0


def test_fraction_in_integer_field_is_null_but_kept(spark):
    row = E.decode_events(messages(spark, '{"ts":1,"retry_count":1.5}')).first()
    assert row["retry_count"] is None and row["ts"] == 1.0


def test_unusable_times_are_dropped(spark):
    rows = [(math.nan,), (math.inf,), (1e300,), (None,), (1.5,)]
    timed = E.with_event_time(spark.createDataFrame(rows, "ts double"))
    assert [r["us"] for r in timed.select(F.unix_micros("event_time").alias("us")).collect()] == [1_500_000]


def test_normalised_defaults(spark):
    rows = [
        {"event": "hit", "query_type": "q1", "ts": 0.0},
        {"event": "retry", "query_type": "", "ts": 2.25},
        {"event": "dlq", "ts": 2.0},
        {"event": "recovery", "retry_count": 2, "ts": 2.0},
        {"event": "other", "ts": 2.0},
    ]
    out = E.normalize_events(raw(spark, rows), as_of=100.0).collect()
    hit, retry, dlq, recovery, other = out
    assert (hit["ts"], hit["timestamp"], hit["query_type"]) == (100.0, "1970-01-01T00:01:40.000000+00:00", "Q1")
    assert (hit["cache_hit"], hit["retry_count"], hit["status"]) == (True, 0, "success")
    assert (retry["query_type"], retry["retry_count"], retry["status"], retry["is_retry_event"]) == ("UNK", 1, "pending", True)
    assert (dlq["retry_count"], dlq["status"], dlq["cache_hit"]) == (None, "failed", None)
    assert (recovery["cache_hit"], recovery["was_retried"], recovery["retry_count"]) == (False, True, 2)
    assert (other["status"], other["event_type"]) == ("pending", "other")


def test_round_trip_of_messages(spark):
    rows = [{"event": e, "ts": 1.25 + i, "latency_ms": 0.1 * i, "key": "k"} for i, e in enumerate(("hit", "dlq", "x"))]
    metric = E.normalize_events(raw(spark, rows))
    back = E.decode_events(E.encode_events(metric)).select(*METRIC_EVENT.fieldNames())
    assert sorted(back.collect()) == sorted(metric.collect())


def test_intake_rejects_events_without_name(spark):
    df = spark.createDataFrame([("hit",), (None,)], "event string")
    accepted, rejected = E.accept_raw_events(df)
    assert accepted.count() == 1 and rejected.count() == 1


def timed_events(spark, rows):
    """rows: (seconds, event, latency)."""
    return E.with_event_time(
        E.normalize_events(raw(spark, [{"event": e, "ts": float(t), "latency_ms": lat} for t, e, lat in rows]))
    )


def test_only_retries_leave_rates_at_zero(spark):
    doc = W.window_metrics(timed_events(spark, [(5, "retry", None)]), slide=W.SIZE).first()
    assert (doc["count_success"], doc["hit_rate"], doc["retry_rate"], doc["dlq_rate"]) == (0, 0.0, 0.0, 0.0)
    assert doc["latency_p50"] is None and doc["latency_avg"] is None and doc["throughput_per_min"] == 0.0
    panes = W.window_metrics_panes(timed_events(spark, [(5, "retry", None)]), slide=W.SIZE).first()
    assert panes == doc


def test_throughput_follows_the_window_size(spark):
    events = timed_events(spark, [(60 + t, "hit", 1.0) for t in range(30)])
    doc = W.window_metrics(events, "30 seconds", "30 seconds").first()
    assert (doc["count_success"], doc["throughput_per_min"], doc["window_id"]) == (30, 60.0, "60")


@pytest.fixture(scope="module")
def mixed(spark):
    kinds = ["hit", "miss", "recovery", "retry", "dlq", "error"]
    rows = [(60 + (i * 7919) % 600 / 3, kinds[i * i % 6], float((i * 37) % 101)) for i in range(1, 900)]
    return timed_events(spark, rows)


def test_each_event_is_in_every_window_that_holds_it(spark, mixed):
    total = W.window_counts(mixed).agg(F.sum("count_events")).first()[0]
    assert total == 6 * mixed.count()


def test_panes_give_the_sliding_result(spark, mixed):
    assert sorted(W.window_counts_panes(mixed).collect()) == sorted(W.window_counts(mixed).collect())
    columns = [c for c in W.window_metrics(mixed).columns if c != "latency_avg"]
    sliding = W.window_metrics(mixed).select(*columns, F.round("latency_avg", 9).alias("avg"))
    panes = W.window_metrics_panes(mixed).select(*columns, F.round("latency_avg", 9).alias("avg"))
    assert sorted(panes.collect()) == sorted(sliding.collect())


@pytest.mark.parametrize(
    "size,slide", [("1 minute", "25 seconds"), ("10 seconds", "25 seconds"), ("1 minute 30 seconds", "7 seconds"), ("1 minute", "1 minute")]
)
def test_panes_of_any_size(spark, mixed, size, slide):
    if size == "10 seconds":  # sliding windows may not be shorter than their slide
        assert W.window_counts_panes(mixed, size, slide).count() > 0
    else:
        assert sorted(W.window_counts_panes(mixed, size, slide).collect()) == sorted(W.window_counts(mixed, size, slide).collect())



def test_pane_percentiles_stay_close_beyond_the_exact_range(spark):
    n = 200_000
    events = spark.range(n).select(
        F.timestamp_seconds(F.col("id") % 60).alias("event_time"),
        F.lit("success").alias("status"),
        F.lit("hit").alias("event_type"),
        F.lit(True).alias("cache_hit"),
        (F.col("id") * 7919 % n).cast("double").alias("latency_ms"),
    )
    doc = W.window_metrics_panes(events).where(F.col("window_id") == "0").first()
    for column, p in W.PERCENTILE_POINTS.items():
        assert abs(doc[column] / n - p) < 1e-3
