"""Confirmed anomalies, monitors and alerts against hand-worked rows and plain loops, split over many blocks."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts as A
from tidewatch.operators import ordered as O


def small_blocks(monkeypatch):
    monkeypatch.setattr(O, "BLOCK_ROWS", 19)
    monkeypatch.setattr(O, "FRAME_ROWS", 60)


def test_outliers_are_confirmed_in_a_row(spark, monkeypatch):
    """Forty even values, then three far ones: the first is not confirmed, the second and third are."""
    small_blocks(monkeypatch)
    rng = random.Random(2)
    keys = {"a": [100.0 + i % 3 for i in range(60)] + [1000.0, 1100.0, 900.0, 101.0, 1000.0], "same": [0.1] * 50, "spike": [1.0, 2.0, 1e15] + [1.0 + i % 5 for i in range(140)] + [40.0, 41.0], "short": [1.0] * 20 + [50.0, 50.0], "b": [rng.expovariate(1) + 1e6 for _ in range(300)], None: [None, float("nan"), 3.0]}
    rows = [(k, i, v) for k, values in keys.items() for i, v in enumerate(values)]
    rng.shuffle(rows)
    found = A.confirmed_outliers(spark.createDataFrame(rows, "k string, i long, v double"), "k", ["i"], "v", window=50, consecutive=2)
    got = {(r.k, r.i): r for r in found.collect()}
    assert len(got) == sum(1 for _, _, v in rows if v is not None and v == v)
    for k, values in keys.items():
        run = 0
        for i, v in enumerate(values):
            if v is None or v != v:
                continue
            last = [x for x in values[: i + 1] if x is not None and x == x][-50:]
            sd = statistics.stdev(last) if len(last) > 1 else 0.0
            z = (v - statistics.fmean(last)) / sd if sd > 1e-9 else 0.0
            run = run + 1 if len(last) >= 30 and abs(z) > 3 else 0
            r = got[k, i]
            assert r.z == pytest.approx(z, rel=1e-6, abs=1e-9) and r.run == run and (r.level is None) == (run < 2)
            if run >= 2:
                assert r.level == (3 if abs(z) > 5 else 2 if abs(z) > 4 else 1)
                assert r.confidence == pytest.approx(max(0.6, min(1, abs(z) / 5)) * max(0.7, min(1, run / 4)))
    assert [got["a", i].level is not None for i in range(59, 65)] == [False, False, True, True, False, False]


def test_volume_and_error_levels(spark):
    times = [60 * m + s for m in range(40) for s in range(10 if m != 30 else 25)] + [60 * 40]
    df = spark.createDataFrame([("m", t) for t in times], "k string, t long")
    found = {r.slot: (r.n, round(r.change, 3), r.level) for r in A.volume_anomalies(df, "k", "t").collect()}
    assert found[30] == (25, 1.5, 3) and found[40] == (1, round((1 - 10.5) / 10.5, 3), 2) and len(found) == 2
    levels = spark.createDataFrame([(0.05,), (0.06,), (0.11,), (0.21,), (None,)], "r double").select(A.level_above(F.col("r"), 0.05, 0.1, 0.2).alias("l")).collect()
    assert [r.l for r in levels] == [None, 1, 2, 3, None]


def test_collective_anomalies(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(20_000), rng.randrange(1, 4)) for _ in range(300)] + [("c", 299, 1), ("c", 300, 3), ("c", 599, 1), ("c", 600, 1)]
    got = sorted((r.k, r.t, r.n, r.l) for r in A.collective_anomalies(spark.createDataFrame(rows, "k string, t long, l int"), "k", "t", "l").collect())
    expected = []
    for k, t, _ in rows:
        near = [lv for kk, tt, lv in rows if kk == k and t - 300 <= tt <= t]
        if len(near) >= 3:
            expected.append((k, t, len(near), max(near)))
    assert got == sorted(expected) and ("c", 599, 3, 3) in got and ("c", 600, 3, 3) in got


@pytest.mark.parametrize("operator, expected", [(">", [False, False, True]), (">=", [False, True, True]), ("<", [True, False, False]), ("<=", [True, True, False]), ("=", [False, True, False]), ("!=", [True, False, True])])
def test_operators(spark, operator, expected):
    rows = spark.createDataFrame([(i, float(i)) for i in (4, 5, 6)], "i long, x double").orderBy("i")
    assert [r.m for r in rows.select(A.meets(F.col("x"), operator, 5.0).alias("m")).collect()] == expected


def test_unknown_names_are_refused(spark):
    with pytest.raises(ValueError):
        A.meets(F.col("x"), "~", 1.0)
    with pytest.raises(ValueError):
        A.threshold_alerts(spark.createDataFrame([], "k string, i long, v double"), "k", ["i"], "v", A.Limits(drift="other"))


def test_threshold_alerts_by_preset(spark):
    """A hard limit silences the warning of the same row; quality has no upper warning; drift by ADWIN after a step."""
    values = [0.9] * 60 + [0.65, 0.4, 1.2] + [0.72] * 60 + [None]
    df = spark.createDataFrame([("q", i, v) for i, v in enumerate(values)], "k string, i long, v double")
    found = A.threshold_alerts(df, "k", ["i"], "v", A.quality_limits()).collect()
    assert sorted((r.i, r.level) for r in found if r.kind == "threshold") == [(60, 1), (61, 3), (62, 3)]
    assert {60, 61} <= {r.i for r in found if r.kind == "anomaly"} and all(r.i >= 60 for r in found)
    cost = A.threshold_alerts(spark.createDataFrame([("c", i, v) for i, v in enumerate([1.0] * 20 + [8.5, 11.0, -1.0] + [4.0] * 10)], "k string, i long, v double"), "k", ["i"], "v", A.cost_limits(10.0)).collect()
    assert sorted((r.i, r.level) for r in cost if r.kind == "threshold") == [(20, 1), (21, 3), (22, 3)]
    assert {r.level for r in cost if r.kind == "drift"} == {3} or {r.level for r in cost if r.kind == "drift"} == {1, 3}
    assert min(r.i for r in cost if r.kind == "drift" and r.level == 3) == 21  # 7.5 - .005 * 21 is a warning, with 10 more it is over 10
    latency = A.threshold_alerts(spark.createDataFrame([("l", i, 0.5 + (i >= 10)) for i in range(20)], "k string, i long, v double"), "k", ["i"], "v", A.latency_limits(100.0)).collect()
    assert sorted((r.i, r.level) for r in latency if r.kind == "drift") == [(13, 1), (14, 1), *((i, 3) for i in range(15, 20))]


def spans_of(spark, rows):
    samples = spark.createDataFrame(rows, "s string, t long, v double")
    rule = A.Rule("high", F.col("v"), ">", 5.0, 300, 3)
    return A.alert_spans(A.rule_samples(samples, "s", "t", [rule]), "s", "t")


def test_spans_and_states(spark, monkeypatch):
    """One scope a state; 300 seconds to hold, a sample a minute."""
    small_blocks(monkeypatch)
    high, low = 9.0, 1.0
    series = {
        "resolved": [high] * 8 + [low] * 12, "never": [high] * 3 + [low] * 17, "pending": [low] * 18 + [high] * 2, "firing": [low] * 5 + [high] * 15,
        "acked": [low] * 5 + [high] * 15, "silenced": [low] * 5 + [high] * 15, "unknown": [None] * 20, "twice": [high] * 7 + [low] + [high] * 12,
    }
    rows = [(s, 60 * i, v) for s, values in series.items() for i, v in enumerate(values)]
    spans = spans_of(spark, rows)
    found = {(r.s, r.started): r for r in spans.collect()}
    assert (found["resolved", 0].last_met, found["resolved", 0].ended, found["resolved", 0].n) == (420, 480, 8)
    assert found["firing", 300].ended is None and len([k for k in found if k[0] == "twice"]) == 2
    silences = spark.createDataFrame([("high", "silenced", 1000, 1200), ("high", "firing", 0, 1140), ("other", None, 0, 9999), ("high", "pending", 5000, 6000)], "rule string, s string, starts long, ends long")
    acks = spark.createDataFrame([(None, "acked", 700), ("high", "firing", 500), (None, "silenced", 700), ("high", "twice", 2000)], "rule string, s string, at long")
    states = {(r.s, r.started): (r.state, r.fired_at) for r in A.alert_states(spans, "s", 1140, silences, acks).collect()}
    assert states == {
        ("resolved", 0): ("resolved", 300), ("pending", 1080): ("pending", None), ("firing", 300): ("firing", 600), ("acked", 300): ("acknowledged", 600),
        ("silenced", 300): ("silenced", 600), ("twice", 0): ("resolved", 300), ("twice", 480): ("firing", 780),
    }
    every = spark.createDataFrame([(None, None, 0, 9999)], "rule string, s string, starts long, ends long")
    assert {r.state for r in A.alert_states(spans, "s", 1140, every, acks).collect()} == {"resolved", "pending", "silenced"}
    earlier = {r.s: r.state for r in A.alert_states(spans, "s", 420, every.limit(0), acks.limit(0)).collect()}
    assert earlier == {"resolved": "firing", "twice": "resolved", "firing": "pending", "acked": "pending", "silenced": "pending"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, i long, v double")
    assert A.confirmed_outliers(none, "k", ["i"], "v").collect() == [] and A.volume_anomalies(none, "k", "i").collect() == []
    assert A.collective_anomalies(none.withColumn("l", F.lit(1)), "k", "i", "l").collect() == [] and A.threshold_alerts(none, "k", ["i"], "v", A.latency_limits(1.0)).collect() == []
    assert spans_of(spark, []).collect() == []
