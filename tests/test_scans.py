"""Balanced blocks and linear recursions as scans: against plain loops, on orders that do not lie evenly."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import decisions, ordered, scans, selection, series


def sizes(df, *order):
    return [r["count"] for r in ordered.in_blocks(df, *order).groupBy("_block").count().collect()]


def test_blocks_are_balanced(spark):
    """One value of 1e15, powers of ten, a constant with a second order column, many ties, nulls and NaN."""
    n = 100_000
    df = spark.range(n).select(
        "id",
        F.when(F.col("id") == 7, 1e15).otherwise(F.col("id").cast("double")).alias("outlier"),
        F.pow(F.lit(10.0), F.col("id") % 300).alias("powers"),
        F.lit(5).alias("constant"),
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("tied"),
        F.timestamp_seconds(F.col("id")).alias("ts"),
    )
    for order in (["outlier"], ["powers"], ["constant", "id"], ["tied", "id"], ["constant", "ts"], ["ts"]):
        found = sizes(df, *order)
        assert len(found) >= 8 and max(found) < 2 * max(ordered.BLOCK_ROWS, n / len(found)), (order, found)
    assert len(sizes(df, "constant")) == 1  # nothing to cut along
    assert len(sizes(df.limit(100), "id")) == 1
    odd = df.limit(1000).withColumn("x", F.when(F.col("id") < 10, None).when(F.col("id") < 20, float("nan")).otherwise(F.col("id").cast("double")))
    blocks = {r["id"]: r["_block"] for r in ordered.in_blocks(odd, "x", "id").collect()}
    assert {blocks[i] for i in range(10)} == {-1} and len({blocks[i] for i in range(10, 20)}) == 1 and blocks[10] > max(blocks[i] for i in range(20, 1000))


def test_blocks_follow_the_order(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 50)
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 2, 2, 9]), rng.choice([None, *range(500)]), i) for i in range(3000)]
    found = ordered.in_blocks(spark.createDataFrame(rows, "a int, b int, i int"), "a", "b").collect()
    found.sort(key=lambda r: (r.a, r.b is not None, r.b or 0))
    blocks = [r["_block"] for r in found]
    assert blocks == sorted(blocks) and len(set(blocks)) > 30


def test_no_job_runs_while_a_plan_is_built(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    spark.sparkContext.setJobGroup("building", "plans")
    plans = [ordered.percentiles(df, ["k"], "v", {"p": 0.5}), series.exponential_average_by_row(df, "k", "id", "v", 0.2), ordered.numbered(df, "k", ["id"])]
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [p.count() for p in plans] == [3, 1000, 1000]


def average(values, alpha, first=1.0):
    mean, weight, out = None, 1.0, []
    for x in values:
        if mean is None:
            mean = None if x is None or x != x else first * x
        else:
            weight *= 1 - alpha
            if x is not None and x == x:
                mean, weight = (weight * mean + alpha * x) / (weight + alpha), 1.0
        out.append(mean)
    return out


@pytest.mark.parametrize("block", [8192, 7])
def test_exponential_average_is_a_scan(spark, monkeypatch, block):
    """Nulls and NaN at the start, in the middle and alone, null and NaN keys, blocks of a few rows."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
    rng = random.Random(9)
    rows = [(rng.choice([1.0, 2.0, None, float("nan"), 5.0]), i, None if rng.random() < 0.2 else float("nan") if rng.random() < 0.1 else rng.uniform(-5, 5)) for i in range(400)] + [(7.0, 1000 + i, None) for i in range(3)]
    rng.shuffle(rows)
    found = {r.i: r.ema for r in series.exponential_average_by_row(spark.createDataFrame(rows, "k double, i long, v double"), "k", "i", "v", 0.3).collect()}
    groups: dict = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(str(k), []).append((i, v))
    expected = {i: e for own in groups.values() for (i, _), e in zip(own, average([v for _, v in own], 0.3), strict=True)}
    assert found.keys() == expected.keys()
    assert all((found[i] is None) == (e is None) and (e is None or math.isclose(found[i], e, rel_tol=1e-9, abs_tol=1e-12)) for i, e in expected.items())


def test_one_key_is_many_tasks(spark):
    """A million rows of one key go through more than four tasks, and no exchange of them is by the key alone."""
    df = spark.range(1_000_000).select(F.lit("k").alias("k"), "id", (F.col("id") % 97).cast("double").alias("v"))
    out = scans.affine_scan(df, "k", ["id"], F.lit(0.9), 0.1 * F.col("v"), "y")
    last = out.where("id = 999999").first().y
    y = 0.0
    for i in range(999_000, 1_000_000):
        y = 0.9 * y + 0.1 * (i % 97)
    assert math.isclose(last, y, rel_tol=1e-9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_block" in plan
    assert ordered.in_blocks(df, "id").select("k", "_block").distinct().count() > 4


def test_gradient_fold_equals_steps(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice("xy"), i, [1.0, rng.random(), float(rng.random() < 0.5)]) for i in range(500)]
    expected: dict = {}
    for p, a, _, (f0, f1, r) in rows:
        t, n, total = expected.get((p, a), ([0.0, 0.0], 0, 0.0))
        e = r - (t[0] * f0 + t[1] * f1)
        expected[p, a] = ([t[0] + 0.1 * e * f0, t[1] + 0.1 * e * f1], n + 1, total + r)
    for block in (8192, 20):
        monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
        for r in selection.contextual_thompson(spark.createDataFrame(rows, "p string, a string, i long, v array<double>"), ["p", "a"], "i", "v").collect():
            t, n, total = expected[r.p, r.a]
            assert r.n == n and all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(r.theta, t, strict=True)) and math.isclose(r.mean_reward, total / n) and math.isclose(r.variance, max(0.01, 0.99**n))


def test_ten_thousand_days_stay_finite(spark):
    """Weights that grow by 1 / (1 - alpha) a day would be infinite after 3,180 days."""
    days = spark.range(10_000).select(F.lit("m").alias("m"), "id", (F.col("id") % 10 + 1).cast("double").alias("c"))
    last = decisions.cost_insights(days, "m", "id", "c").where("id = 9999").first()
    assert math.isclose(last.ema, average([i % 10 + 1 for i in range(9_000, 10_000)], 0.2)[-1], rel_tol=1e-9)
    steady = decisions.traffic_volatility(days, "m", "id", "c", 0.1).where("id = 9999").first()
    assert 4 < steady.mean_rate < 8 and 0 < steady.volatility < 1 and steady.peak_rate == 10


def test_draws_of_a_batch_equal_draws_of_a_row(spark):
    """Null and negative keys, rows with no arm; choices draw by batches: F5, F6."""
    df = spark.createDataFrame([(i - 50 if i % 7 else None, i % 4) for i in range(300)], "k long, n int")
    row = df.withColumn("z", selection.normal_draws(F.col("n"), 7, F.col("k"), ((3,), (4,))))
    for i in range(3):
        for j, tail in enumerate((3, 4)):
            at = F.get("z", F.lit(2 * i + j))
            one = selection.normal_draw(7, F.col("k"), i + 1, tail)
            assert row.where(F.when(F.col("n") > i, F.when(F.col("k").isNull(), at.isNotNull()).otherwise(at.isNull() | (F.abs(at - one) > 1e-12))).otherwise(at.isNotNull())).count() == 0
    assert row.where(F.size("z") != 2 * F.col("n")).count() == 0
    arms = spark.createDataFrame([("a", 5, 9), ("b", 3, 4)], "arm string, wins long, n long")
    plan = selection.thompson_choice(df, arms, "arm", "k", 7)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
