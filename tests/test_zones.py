import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.operators import answers as A
from beaconry.operators import zones as Z
from beaconry.schemas import BUILDING, REQUEST_PARAMS, ZONE


def points(spark, rows):
    return spark.createDataFrame(rows, BUILDING)


@pytest.fixture(scope="module")
def zone_df(spark):
    return Z.zone_table(spark)


@pytest.fixture(scope="module")
def scattered(spark):
    rng = random.Random(7)
    special = [0.0, 1.0, 0.15, 0.7, 0.05 * 3, -0.1, 1.1, math.nan, None, math.nextafter(1, 2)]
    rows = []
    for _ in range(3000):
        conf = rng.choice(special) if rng.random() < 0.5 else rng.random()
        area = None if rng.random() < 0.05 else rng.uniform(10, 400)
        rows.append((rng.uniform(-33.55, -33.38), rng.uniform(-70.82, -70.54), area, conf))
    return rows


def test_overlap_and_edges(spark, zone_df):
    found = Z.assign_zones(points(spark, [(-33.44, -70.635, 1.0, 1.0), (-33.42, -70.6, 2.0, 1.0)]), zone_df)
    got = sorted((r["area_in_meters"], r["zone_id"]) for r in found.collect())
    assert got == [(1.0, "Z1"), (1.0, "Z4"), (2.0, "Z1"), (2.0, "Z2")]


def test_missing_coordinates_are_in_no_zone(spark, zone_df):
    rows = points(spark, [(math.nan, -70.6, 1.0, 1.0), (None, -70.6, 1.0, 1.0)])
    assert Z.assign_zones(rows, zone_df).count() == 0
    assert Z.assign_zones_grid(rows, zone_df).count() == 0


def test_filter_keeps_or_drops_copies(spark, zone_df):
    rows = points(spark, [(-33.44, -70.635, 1.0, 1.0)] * 2 + [(0.0, 0.0, 1.0, 1.0)])
    assert Z.filter_to_zones(rows, zone_df).count() == 4
    assert Z.filter_to_zones(rows, zone_df, keep_multiplicity=False).count() == 2


def test_grid_equals_broadcast_for_zones_of_any_size(spark, scattered, monkeypatch):
    rng = random.Random(3)
    zones = [("world", "w", -90.0, 90.0, -180.0, 180.0), ("point", "p", *[scattered[0][0]] * 2, *[scattered[0][1]] * 2)]
    for i in range(40):
        lat, lon, size = rng.uniform(-33.6, -33.3), rng.uniform(-70.9, -70.5), 10 ** rng.uniform(-3, 0.5)
        zones.append((f"r{i}", "r", lat, lat + size, lon, lon + size * rng.random()))
    zone_rows = spark.createDataFrame(zones, ZONE)
    buildings = points(spark, scattered).select("latitude", "longitude", "area_in_meters")
    near = sorted(map(str, Z.assign_zones(buildings, zone_rows).collect()))
    assert sorted(map(str, Z.assign_zones_grid(buildings, zone_rows).collect())) == near
    once = sorted(map(str, Z.filter_to_zones(buildings, zone_rows, keep_multiplicity=False).collect()))
    monkeypatch.setattr(Z, "MAX_BROADCAST_ZONES", 5)
    assert sorted(map(str, Z.assign_zones(buildings, zone_rows).collect())) == near
    assert sorted(map(str, Z.filter_to_zones(buildings, zone_rows, keep_multiplicity=False).collect())) == once


def test_zone_counts_exceed_buildings_only_by_the_overlap(spark, zone_df, scattered):
    buildings = points(spark, scattered)
    stats = {r["zone_id"]: r["n_buildings"] for r in Z.zone_stats(buildings, zone_df).collect()}
    total = stats.pop(None)
    inside = Z.filter_to_zones(buildings, zone_df, keep_multiplicity=False).count()
    overlap = Z.assign_zones(buildings, zone_df.where(F.col("zone_id").isin("Z1", "Z4")))
    twice = overlap.groupBy("latitude", "longitude").count().where("count > 1").count()
    assert total == sum(stats.values()) == inside + twice


def in_zone(rows, zone):
    _, _, lat_min, lat_max, lon_min, lon_max = next(z for z in Z.ZONES if z[0] == zone)
    return [r for r in rows if lat_min <= r[0] <= lat_max and lon_min <= r[1] <= lon_max]


THRESHOLDS = (-1.0, 0.0, 0.15, 0.5, 0.7, 1.0, 1.05, 2.0)


def expected(rows, zone, minimum):
    kept = [r for r in in_zone(rows, zone) if minimum <= 0 or (r[3] is not None and r[3] >= minimum)]
    areas = [r[2] for r in kept if r[2] is not None]
    return len(kept), round(sum(areas), 6), round(sum(areas) / len(areas), 6) if areas else 0.0


@pytest.mark.parametrize("cuts", [True, False])
def test_thresholds_equal_a_direct_filter(spark, zone_df, scattered, cuts):
    zoned = Z.assign_zones(points(spark, scattered), zone_df)
    profile = Z.zone_profile(zoned, tuple(t for t in THRESHOLDS if t > 0) if cuts else None)
    totals = Z.threshold_totals(profile, Z._ask(zone_df, THRESHOLDS)).select("zone_id", "confidence_min", *Z.area_answer())
    got = {
        (r["zone_id"], r["confidence_min"]): (r["n"], round(r["total_area"], 6), round(r["avg_area"], 6))
        for r in totals.collect()
    }
    assert got == {(z[0], t): expected(scattered, z[0], t) for z in Z.ZONES for t in THRESHOLDS}


def test_empty_zone(spark, zone_df):
    nothing = points(spark, [(0.0, 0.0, 1.0, 1.0)])
    assert {r["count"] for r in Z.q1_count(nothing, zone_df, (0.0, 0.5)).collect()} == {0}
    assert {tuple(r)[2:] for r in Z.q2_area(nothing, zone_df).collect()} == {(0.0, 0.0, 0)}
    assert {r["density_per_km2"] for r in Z.q3_density(nothing, zone_df).collect()} == {0.0}


@pytest.mark.parametrize("cuts", [True, False])
def test_histogram_equals_numpy(spark, zone_df, scattered, cuts):
    sizes = (1, 3, 5, 6, 10, 20)
    zoned = Z.assign_zones(points(spark, scattered), zone_df)
    profile = Z.zone_profile(zoned, Z.histogram_cuts(sizes) if cuts else None)
    asked = zone_df.select("zone_id", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("bins"))
    nested = {(r["zone_id"], r["bins"]): r["buckets"] for r in Z.q5_buckets_nested(Z.histogram(profile, asked)).collect()}
    for zone in (z[0] for z in Z.ZONES):
        values = [r[3] for r in in_zone(scattered, zone) if r[3] is not None and not math.isnan(r[3])]
        for size in sizes:
            counts, edges = np.histogram(values, bins=size, range=(0.0, 1.0))
            buckets = nested[zone, size]
            assert [b["count"] for b in buckets] == counts.tolist()
            assert [b["bucket"] for b in buckets] == list(range(size))
            assert [b["min"] for b in buckets] + [buckets[-1]["max"]] == edges.tolist()


def test_value_on_an_inexact_edge(spark, zone_df):
    row = points(spark, [(-33.43, -70.61, 1.0, 0.15)])
    counts = Z.q5_confidence_dist(row, zone_df, (20,)).where("zone_id = 'Z1' AND count > 0").collect()
    assert [(r["bucket"], r["count"]) for r in counts] == [(2, 1)]


def test_requests_of_every_kind(spark, zone_df, scattered):
    asked = [
        (1, "q1", ("Z1", None, None, 0.33, None)),
        (2, "Q1", ("Z1", None, None, None, None)),
        (3, "q2", ("Z2", None, None, 0.7, None)),
        (4, "q4", (None, "Z3", "Z5", 9.0, None)),
        (5, "q4", (None, "Z3", None, 0.5, None)),
        (6, "q5", ("Z4", None, None, None, 7)),
        (7, "q5", ("Z4", None, None, None, 0)),
        (8, "q7", ("Z4", None, None, None, 0)),
        (9, "q3", ("Z9", None, None, 0.1, None)),
        (10, None, ("Z1", None, None, 0.1, None)),
        (11, "q1", ("Z1", None, None, 0.33, None)),
    ]
    schema = f"query_id long, query_type string, params {REQUEST_PARAMS.simpleString()}"
    answers = A.answer_requests(spark.createDataFrame(asked, schema), points(spark, scattered), zone_df)
    got = {r["query_id"]: r for r in answers.collect()}
    assert len(got) == len(asked)
    assert got[1]["count"] == got[11]["count"] == expected(scattered, "Z1", 0.33)[0]
    assert got[2]["count"] == expected(scattered, "Z1", 0)[0]
    assert got[3]["n"] == expected(scattered, "Z2", 0.7)[0] and got[3]["count"] is None
    assert (got[4]["density_a"], got[4]["density_b"], got[4]["winner"]) == (0.0, 0.0, "Z5")
    values = [r[3] for r in in_zone(scattered, "Z4") if r[3] is not None and not math.isnan(r[3])]
    assert got[6]["bucket_counts"] == ",".join(map(str, np.histogram(values, bins=7, range=(0, 1))[0]))
    reasons = {i: got[i]["error_reason"] for i in (5, 7, 8, 9, 10)}
    assert reasons == {
        5: "missing_parameter",
        7: "invalid_bins",
        8: "unknown_query_type",
        9: "unknown_zone",
        10: "unknown_query_type",
    }
