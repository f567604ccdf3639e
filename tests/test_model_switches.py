"""Model switches against hand-worked decisions, and the best model against the frontier."""

from __future__ import annotations

import random

import pytest

from tidewatch.operators import decisions as D
from tidewatch.operators import selection

POINTS = "s string, model string, n long, success double, cost double, latency double, quality double"
CURRENT = "s string, model string, evaluated_at long"


def test_decisions(spark):
    now, old = ("now", 1000, 0.9, 10.0, 1000.0, 4.0), None
    better = {"switch": ("new", 500, 1.0, 10.5, 500.0, 4.5), "dear": ("new", 2000, 1.0, 12.0, 100.0, 5.0), "slow": ("new", 10, 1.0, 1.0, 1200.0, 4.5), "poor": ("new", 10, 1.0, 0.0, 100.0, 3.0), "soon": ("new", 10, 1.0, 1.0, 100.0, 4.5), "keep": ("new", 10, 1.0, 50.0, 3000.0, 2.0)}
    points = [(s, *p) for s, new in better.items() for p in (now, new)] + [("gone", *now), ("free", "now", 1, 1.0, 0.0, 4000.0, 3.0), ("free", "new", 1, 1.0, 0.1, 10.0, 5.0), (None, *now)]
    current = [(s, "now", 9_000 if s == "soon" else old) for s in (*better, "free", "nothing", None)] + [("gone", "other", old)]
    limits = D.SwitchLimits(most_latency_ms=100.0, least_quality=3.5)
    got = {r.s: r for r in D.model_switches(spark.createDataFrame(points, POINTS), spark.createDataFrame(current, CURRENT), "s", 10_000, limits).collect()}
    assert {s: (r.decision, r.failed) for s, r in got.items() if r.decision != "keep"} == {"switch": ("switch", []), "dear": ("blocked", ["cost"]), "slow": ("blocked", ["latency"]), "poor": ("blocked", ["quality"]), "soon": ("blocked", ["period"]), "free": ("blocked", ["cost"])}
    assert {s for s, r in got.items() if r.decision == "keep"} == {"keep", "nothing", "gone", None}
    r = got["switch"]
    assert (r.best, r.cost_change, r.cost_change_all, r.latency_change, r.quality_change) == ("new", 0.5, 500.0, -500.0, 0.5)
    assert r.confidence == pytest.approx(0.75) and r.score == pytest.approx(0.4 * 0.895 + 0.3 * 0.9 + 0.3 * 0.9)
    assert got["dear"].confidence == 1.0


def test_best_is_on_the_frontier(spark):
    """Also where ranges cut costs and latencies off, so that many models score alike."""
    rng = random.Random(3)
    points = [("x", f"m{i}", 1, 1.0, float(rng.randrange(90, 130)), float(rng.randrange(4900, 5200)), float(rng.randrange(1, 4))) for i in range(60)]
    df = spark.createDataFrame(points, POINTS)
    best = D.model_switches(df, spark.createDataFrame([("x", "m0", None)], CURRENT), "s", 0).head().best
    assert best in {r.model for r in selection.skyline(df, "model", ["quality"], ["cost", "latency"]).collect()}


def test_refusal_and_empty(spark):
    none = spark.createDataFrame([], POINTS)
    with pytest.raises(ValueError):
        D.model_switches(none, spark.createDataFrame([], CURRENT), "s", 0, D.SwitchLimits(cost_weight=-1.0))
    assert D.model_switches(none, spark.createDataFrame([], CURRENT), "s", 0).collect() == []
