import random

import pytest

from beaconry.operators import scenarios as S

PHASE = "phase string, phase_start double, phase_end double"
SAMPLE = "label string, time_offset double, backlog long"


def brute(samples, phases):
    out = {}
    for label, at, backlog in samples:
        for name, start, end in phases:
            if start is not None and end is not None and start <= at <= end:
                n, peak, longest = out.get((label, name), (0, backlog, 0.0))
                out[label, name] = (n + 1, max(peak, backlog), max(longest, end - start))
    return out


@pytest.mark.parametrize("widest", [3, 30])
def test_phases_of_any_number_and_length(spark, monkeypatch, widest):
    monkeypatch.setattr(S, "WIDEST_LEVEL", widest)
    rng = random.Random(3)
    samples = [(f"s{rng.randrange(3)}", rng.choice([rng.randrange(300), rng.uniform(-5, 300)]) * 1.0, rng.randrange(50)) for _ in range(500)]
    phases = [(f"p{i}", a := rng.randrange(-20, 300) * 1.0, a + rng.choice([0, 1, 2, 7.5, 64, 250])) for i in range(90)]
    phases += [("backwards", 9.0, 3.0), ("open", None, 8.0), ("spike", 5.0, 20.0), ("spike", 10.0, 30.0)]
    got = S.backlog_by_phase(spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(phases, PHASE)).collect()
    assert {(r["label"], r["phase"]): (r["samples"], r["peak_backlog"], r["phase_sec"]) for r in got} == brute(samples, phases)


def test_without_phases(spark):
    samples = spark.createDataFrame([("s0", 1.0, 2)], SAMPLE)
    assert S.backlog_by_phase(samples, spark.createDataFrame([], PHASE)).collect() == []
