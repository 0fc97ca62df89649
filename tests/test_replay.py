import random

import pytest
from pyspark.sql import functions as F

from beaconry.functions.scalar import two_digits
from beaconry.operators import replay as R

REQUEST = "query_id long, key string, ttl_us long, created_us long"
FILL = "key string, fill_us long"


def looked_up(rows, fills):
    """Each request beside all fills of its key."""
    out = {}
    for query_id, key, ttl, at in rows:
        newest = max((f for k, f in fills if k == key and k is not None and f <= at), default=None)
        out[query_id] = newest if newest is not None and (ttl <= 0 or at < newest + ttl) else None
    return out


@pytest.mark.parametrize("seed,length", [(1, 1), (2, 7), (3, 100), (4, 10_000_000)])
def test_lookup_equals_brute_force(spark, monkeypatch, seed, length):
    """A hot key, ties, overlapping fills, requests before any fill, keys without one, null keys."""
    monkeypatch.setattr(R, "SLICE_US", length)
    rng = random.Random(seed)
    ttl = {"hot": 40, "cold": 300, "ever": 0, "unfilled": 50, None: 50}
    keys = lambda: rng.choices(list(ttl), [0.6, 0.1, 0.1, 0.1, 0.1])[0]
    rows = [(i, k := keys(), ttl[k], rng.randrange(2000)) for i in range(800)]
    fills = [(k, rng.randrange(100, 2000)) for _ in range(120) if (k := keys()) != "unfilled"]
    got = R.requests_to_fills(spark.createDataFrame(rows, REQUEST).repartition(5), spark.createDataFrame(fills, FILL))
    assert got.columns == ["query_id", "key", "ttl_us", "created_us", "fill_us"]
    found = got.collect()
    assert len(found) == len(rows)
    assert {r["query_id"]: r["fill_us"] for r in found} == looked_up(rows, fills)


def test_bounds_and_clashing_columns(spark):
    fills = spark.createDataFrame([("k", 20)], FILL).withColumn("ttl_us", F.lit(1))
    rows = [(i, "k", 10, at) for i, at in enumerate((19, 20, 29, 30))]
    asked = spark.createDataFrame(rows, REQUEST).withColumn("fill_us", F.lit(5))
    got = {r["created_us"]: r["fill_us"] for r in R.requests_to_fills(asked, fills).collect()}
    assert got == {19: None, 20: 20, 29: 20, 30: None}


def test_without_fills_or_requests(spark):
    asked, fills = spark.createDataFrame([(1, "k", 10, 5)], REQUEST), spark.createDataFrame([("k", 1)], FILL)
    assert [r["fill_us"] for r in R.requests_to_fills(asked, fills.limit(0)).collect()] == [None]
    assert R.requests_to_fills(asked.limit(0), fills).collect() == []


def test_corrupt_payloads_are_not_served(spark):
    rows = [("a", '{"count":1}'), ("b", "{bad"), ("c", None), ("d", "null"), ("e", "3")]
    entries = spark.createDataFrame(rows, "key string, payload string")
    assert sorted(r["key"] for r in R.usable_entries(entries).collect()) == ["a", "e"]


def test_two_digits_round_the_exact_value(spark):
    rng = random.Random(5)
    values = [i / 1000 for i in range(-1100, 2101)] + [i / 8 for i in range(40)] + [-0.0, 1e15 + 0.125, 2.0**52 + 0.5]
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 12) for _ in range(20_000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double").select("v", two_digits(F.col("v")).alias("text"))
    wrong = [(r["v"], r["text"]) for r in frame.collect() if r["text"] != f"{r['v']:.2f}"]
    assert not wrong
