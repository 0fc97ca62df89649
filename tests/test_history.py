import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from beaconry.operators import history as H
from beaconry.operators import popularity as P
from beaconry.operators import summary as S


@pytest.fixture(scope="module")
def skewed():
    """One group holds most rows; sequence numbers have long gaps."""
    rng, rows, seq, ts = random.Random(5), [], 0, 0
    for _ in range(4000):
        seq += 1 if rng.random() < 0.99 else rng.randint(2, 5000)
        ts += rng.choice([0, 0, 1, 50_000, 400_000, 30_000_000 if rng.random() < 0.02 else 0])
        rows.append((rng.choices(["hot", "warm", "rare"], [0.9, 0.095, 0.005])[0], seq, ts, rng.random() < 0.6))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def frame(spark, skewed):
    return spark.createDataFrame(skewed, "kind string, seq long, ts_us long, hit boolean").repartition(6).cache()


def grouped(rows):
    out = defaultdict(list)
    for row in sorted(rows, key=lambda r: r[1]):
        out[row[0]].append(row)
    return out


@pytest.mark.parametrize("n,width", [(1, 10), (50, 10), (50, 1000), (10_000, 100)])
def test_last_n(frame, skewed, n, width):
    want = sorted(r[1] for r in skewed)[-n:]
    assert sorted(r["seq"] for r in H.last_n(frame, n, width=width).collect()) == want


@pytest.mark.parametrize("n,width", [(3, 10), (40, 64), (5000, 1000)])
def test_last_n_per_class(frame, skewed, n, width):
    got = H.last_n_per_class(frame, n, "kind", ("hot", "rare"), width=width).collect()
    want = {r[1] for k, rows in grouped(skewed).items() if k != "warm" for r in rows[-n:]}
    assert {r["seq"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("width", [7, 1000, 10**6])
def test_positions(frame, skewed, width):
    got = {r["seq"]: r["position"] for r in H.positions(frame, "kind", width=width).collect()}
    assert got == {r[1]: i for rows in grouped(skewed).values() for i, r in enumerate(rows)}


@pytest.mark.parametrize("n,width", [(1, 1), (20, 20), (20, 64), (200, 10**6)])
def test_rolling_hit_rate(frame, skewed, n, width):
    got = {
        r["seq"]: (r["hit_rate"], r["window_size"])
        for r in H.rolling_hit_rate(frame, "kind", F.col("hit"), n, width=width).collect()
    }
    want = {}
    for rows in grouped(skewed).values():
        last = deque(maxlen=n)
        for row in rows:
            last.append(row[3])
            want[row[1]] = (pytest.approx(sum(last) / len(last), abs=5.1e-5), len(last))
    assert got == want


@pytest.mark.parametrize("seconds,width", [(10, 1), (10, 60), (1, 3600)])
def test_trailing_throughput(frame, skewed, seconds, width):
    rates = H.trailing_throughput(frame, "kind", seconds=seconds, slice_seconds=width)
    got = {r["seq"]: r["throughput"] for r in rates.collect()}
    want = {}
    for rows in grouped(skewed).values():
        for row in rows:
            near = sum(1 for r in rows if row[2] - seconds * 1_000_000 <= r[2] <= row[2])
            want[row[1]] = near / seconds
    assert got == want


def test_a_frame_wider_than_a_slice(frame):
    def rows(**how):
        return sorted(H.rolling_hit_rate(frame, "kind", F.col("hit"), 200, **how).collect())

    assert rows(width=100) == rows()


@pytest.mark.parametrize("width", [1, 50, 10**9])
def test_previous_row(frame, skewed, width):
    got = {r["seq"]: r["previous_ts_us"] for r in H.previous_row(frame, "kind", "seq", ("ts_us",), width).collect()}
    want = {}
    for rows in grouped(skewed).values():
        for before, row in zip([None, *rows], rows):
            want[row[1]] = before and before[2]
    assert got == want


def test_eviction_rate_per_source(spark):
    minute = 60_000_000
    rows = [("a", minute, 6), ("a", 3 * minute, 6), ("a", 4 * minute, 9), ("b", 0, 5)]
    samples = spark.createDataFrame(rows, "policy string, sample_us long, evicted_keys long")
    got = {(r["policy"], r["sample_us"]): r["rate_per_min"] for r in H.eviction_rate(samples, 0, width_us=minute).collect()}
    assert got == {("a", minute): 6.0, ("a", 3 * minute): 0.0, ("a", 4 * minute): 3.0, ("b", 0): None}


def test_popularity_ranks_ties_once(spark):
    counts = {f"i{k}": 5 if k % 3 else 1 + k // 30 for k in range(200)}
    frame = spark.createDataFrame(list(counts.items()), "item string, n long")
    rows = P.popularity_profile(frame, "item", s=1.0).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 201))
    assert [r["n"] for r in rows] == sorted(counts.values(), reverse=True)
    assert sum(r["zipf_share"] for r in rows) == pytest.approx(1)
    assert rows[0]["zipf_share"] == pytest.approx(2 * rows[1]["zipf_share"])
    assert rows[0]["uniform_share"] == pytest.approx(1 / 200)
    assert sum(r["observed_share"] for r in rows) == pytest.approx(1)


def metric_rows(spark, rows):
    """rows: (seq, event, query type, latency)."""
    data = [(s, e, q, lat, float(s)) for s, e, q, lat in rows]
    return spark.createDataFrame(data, "seq long, event_type string, query_type string, latency_ms double, ts double")


def test_summary_of_nothing(spark):
    nothing = metric_rows(spark, [])
    row = S.run_summary(nothing).first()
    assert row["total_requests"] == 0 and row["hit_rate"] is None and row["retry_rate"] == 0.0
    assert {tuple(r)[1:] for r in S.summary_latency(nothing).collect()} == {(None, None, None)}
    assert S.cache_efficiency(nothing).first()[:] == (0.0, 0.0, None)
    assert S.throughput(nothing, 0, 10).first()["throughput_qps_total"] == 0.0
    assert all(r["total"] == 0 and r["hit_rate"] is None for r in S.by_query_summary(nothing).collect())


def test_summary_counts_missing_latency_as_zero_and_ignores_unknown_events(spark):
    events = metric_rows(
        spark,
        [(1, "hit", "Q1", None), (2, "hit", "Q1", 4.0), (3, "miss", "UNK", 10.0), (4, "what", "Q1", 9.0), (5, "error", "Q1", None)],
    )
    row = S.run_summary(events).first()
    assert (row["hits"], row["misses"], row["errors"], row["total_requests"]) == (2, 1, 1, 3)
    points = {r["class"]: r["p50"] for r in S.summary_latency(events).collect()}
    assert points == {"hit": 2.0, "miss": 10.0, "recovery": None, "all": 4.0}
    assert tuple(S.cache_efficiency(events).first()) == (2.0, 10.0, 5.333)
    totals = {r["query_type"]: r for r in S.event_counters(events).collect()}
    assert totals[None]["errors"] == 1 and totals["Q1"]["errors"] is None and totals["Q1"]["hits"] == 2
    assert set(r["query_type"] for r in S.by_query_summary(events).collect()) == set(S.QUERY_TYPES)


def test_latency_sample_is_bounded_per_class(spark):
    events = metric_rows(spark, [(i, "hit" if i % 2 else "miss", "Q1", float(i)) for i in range(100)])
    points = {r["class"]: r["p50"] for r in S.summary_latency(events, n=3).collect()}
    assert points == {"hit": 97.0, "miss": 96.0, "recovery": None, "all": 96.5}


def test_throughput_spans_the_newest_answers_in_order_of_arrival(spark):
    rows = [(1, "hit", 100.0), (2, "miss", 50.0), (3, "retry", 60.0), (4, "hit", 90.0)]
    events = spark.createDataFrame(rows, "seq long, event_type string, ts double")
    row = S.throughput(events, 0, 100, n=2).first()
    assert (row["total_requests"], row["throughput_qps_total"], row["throughput_qps_recent_10s"]) == (3, 0.08, 0.1)
    single = S.throughput(events.where("seq = 1"), 0, 100).first()
    assert single["throughput_qps_total"] == 0.01


def test_consumer_lag_per_sample(spark):
    ends = spark.createDataFrame(
        [(t, topic, p, 10 * t + p) for t in (1, 2) for topic in ("queries", "retry-queries", "dlq-queries") for p in (0, 1)],
        "t int, topic string, partition int, end_offset long",
    )
    committed = spark.createDataFrame(
        [(1, "queries", 0, 4), (1, "queries", 1, 99), (2, "retry-queries", 0, 20)],
        "t int, topic string, partition int, committed long",
    )
    got = {(r["t"], r["topic"]): r["backlog"] for r in S.consumer_lag(ends, committed, by=("t",)).collect()}
    assert got == {
        (1, "queries"): 6,
        (1, "retry-queries"): 21,
        (1, None): 27,
        (2, "queries"): 41,
        (2, "retry-queries"): 21,
        (2, None): 62,
    }


def test_recent_hit_rate_and_run_rate_of_nothing(spark):
    empty = spark.createDataFrame([], "seq long, hit boolean, failed boolean, created_us long")
    assert tuple(S.recent_hit_rate(empty, F.col("hit")).first()) == (None, 0)
    assert S.run_throughput(empty, F.col("failed")).first()["throughput_qps"] is None
