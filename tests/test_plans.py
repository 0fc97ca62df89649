"""What the plans of the queries must look like."""

import re

import pytest

from beaconry.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def lazy_names():
    eager = {"publish_events", "upsert_latest", "load_snapshots"}  # these read what they wrote
    return [n for n in QUERIES if not n.startswith("stream_") and n not in eager]


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(QUERIES[name](spark, SF_DIR)) for name in lazy_names()}


def test_no_plan_runs_python(plans):
    assert not {name for name, text in plans.items() if re.search(r"Python|Pandas", text)}


def test_no_cartesian_products(plans):
    assert not [name for name, text in plans.items() if "CartesianProduct" in text]


def test_loop_joins_only_against_checked_dimensions(plans):
    looping = {name for name, text in plans.items() if "BroadcastNestedLoopJoin" in text}
    assert looping <= {
        "assign_zones",
        "filter_to_zones",
        "filter_to_zones_dedup",
        "zone_area",
        "zone_stats",
        "q1_count",
        "q2_area",
        "q3_density",
        "q5_confidence_dist",
        "backlog_by_phase",
    }


def test_windows_are_partitioned(plans):
    """Window operators over data rows have a partition key."""
    for name in ("rolling_hit_rate", "trailing_throughput", "last_n_per_class", "eviction_rate"):
        windows = re.findall(r"Window \[.*", plans[name])
        assert windows
        for text in windows:
            keys = re.findall(r"\], \[([^\]]*)\]", text)
            assert keys and keys[0], text


def test_limit_runs_before_the_shuffle(plans):
    assert "WindowGroupLimit" in plans["last_n_per_class"] and "Partial" in plans["last_n_per_class"]


def test_columns_are_pruned_at_the_scan(plans):
    def read(name):
        return re.findall(r"ReadSchema: struct<([^>]*)>", plans[name])

    assert all("value" not in s and "props" not in s for s in read("rolling_hit_rate"))
    assert all("l_extendedprice" not in s for s in read("q1_count"))
    assert all("props" not in s for s in read("window_metrics"))


def test_cut_off_reaches_the_scan(spark):
    from beaconry.operators.history import last_n
    from beaconry.plans import inputs

    rows = inputs.table(spark, SF_DIR, "events").select("event_id")
    assert "GreaterThanOrEqual(event_id" in plan(last_n(rows, 10, seq="event_id"))


def test_one_percentile_sketch_per_window(plans):
    partial = [line for line in plans["window_metrics"].splitlines() if "partial_percentile_approx" in line]
    assert partial and all(line.count("partial_percentile_approx") == 1 for line in partial)


def test_messages_are_parsed_once(plans):
    assert len(re.findall(r"from_json\(", plans["decode_events"].split("== Initial Plan")[0])) == 1
