"""Frames, running values and ranks that are cut into many blocks equal their SQL; no task holds a whole key."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from test_oracles import plain, sql  # noqa: F401
from tidewatch.operators import ordered as O
from tidewatch.plans import registry

SPLIT = ["n01_rolling_z", "n02_expanding_z", "n03_rolling_iqr", "n04_rolling_mad", "n05_mahalanobis", "n06_group_outliers", "n07_adwin", "n08_page_hinkley", "n09_cusum", "n10_welch_drift", "n18_threshold_monitor", "n22_monitor_with_drift", "z26_performance_report", "w06_global_window", "w07_count_window", "w11_watermark_replay", "w13_punctuated_watermark", "a03_nearest_rank", "a04_quartiles", "a07_percentile_kinds", "j02_asof_join", "f02_point_in_time", "x09_health_checks", "z01_performance_insights"]


@pytest.mark.parametrize("name", SPLIT)
def test_many_blocks_equal_sql(spark, small, sql, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(O, "BLOCK_ROWS", 23)
    monkeypatch.setattr(O, "FRAME_ROWS", 110)
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    result = sql.execute(registry.ORACLES[name])
    given = [x[0] for x in result.description]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[given.index(c)]) for c in columns) for r in result.fetchall())
    windows = re.findall(r"Window \[.*?\], \[(.*?)\]", df._jdf.queryExecution().optimizedPlan().toString())
    raw = [w for w in windows if "_block" not in w and "_frame" not in w]
    # windows over a key alone are over rows of (key, block) only: their plans read an aggregate
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(raw) <= plan.count("Aggregate [")


def test_running_values_of_odd_rows(spark):
    """Nulls and NaN in the order, null keys, ties and an empty table."""
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), *map(float, range(30))]), i, rng.choice([None, 1.0, 2.5])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t double, i long, v double")
    old = O.BLOCK_ROWS
    O.BLOCK_ROWS = 11
    try:
        got = O.running(O.in_blocks(df, "t"), "k", ["t", "i"], [("s", "sum", F.col("v")), ("l", "last", F.col("v")), ("n", "count", F.lit(1), True), ("top", "max", F.col("i"), True)]).collect()
        places = {r.i: r._rn for r in O.numbered(df, "k", ["t", "i"]).collect()}
        assert O.numbered(df.limit(0), "k", ["t", "i"]).count() == 0
    finally:
        O.BLOCK_ROWS = old
    order = lambda r: (0, 0.0) if r[1] is None else (2, 0.0) if r[1] != r[1] else (1, r[1])
    for k in ("a", "b", None):
        total, last, n, top = None, None, 0, None
        found = {r.i: r for r in got if r.k == k}
        for _, _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: (order(r), r[2])):
            r = found[i]
            assert ((r.n or 0), r.top, places[i]) == (n, top, n + 1)
            total = total if v is None else (total or 0) + v
            last = last if v is None else v
            assert (r.s, r.l) == (total, last)
            n, top = n + 1, i if top is None else max(top, i)


def test_ranks_of_one_hot_value(spark):
    df = spark.range(5000).selectExpr("'k' as k", "cast(if(id % 3 = 0, id, 7) as double) as v")
    values = sorted(float(i) if i % 3 == 0 else 7.0 for i in range(5000))
    r = O.percentiles(df, ["k"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).first()
    at = lambda p: values[int(p * 4999)] + (p * 4999 % 1) * (values[min(4999, int(p * 4999) + 1)] - values[int(p * 4999)])
    assert [round(x, 6) for x in (r.p0, r.p50, r.p95, r.p100)] == [round(at(p), 6) for p in (0.0, 0.5, 0.95, 1.0)]


def test_choices_need_no_shuffle_of_requests(spark, small):
    plan = registry.QUERIES["e08_linucb_choice"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(request_id" not in plan and "collect_list" in plan


def test_nested_sums_equal_plain_recursion(spark):
    """Groups of sixteen on every level, chunks that are just full, nulls, a null key; the same places whatever the blocks."""
    rng = random.Random(6)
    sizes = {"a": 70_000, "b": O.CHUNK, "c": O.CHUNK * 2 + 272, "d": 1, None: 300}
    rows = [(k, i, None if rng.random() < 0.05 or i < 3 else rng.uniform(-1e6, 1e6)) for k, n in sizes.items() for i in range(n)]
    found = {(r.k, r.i): (r.s, r.s_low) for r in O.nested_sums(spark.createDataFrame(rows, "k string, i long, v double"), "k", ["i"], {"s": F.col("v")}).collect()}
    assert len(found) == len(rows)
    for k, n in sizes.items():
        levels = [[v or 0.0 for key, _, v in rows if key == k]]
        values = [v for key, _, v in rows if key == k]
        while len(levels[-1]) >= 16:
            at, sums = levels[-1], []
            for g in range(len(at) // 16):
                t = at[16 * g]
                for v in at[16 * g + 1 : 16 * g + 16]:
                    t += v
                sums.append(t)
            levels.append(sums)
        low, any_yet = math.inf, False
        for i in range(n):
            end, parts = i + 1, []
            for level in levels:
                parts.append(level[end // 16 * 16 : end])
                end //= 16
            total = 0.0
            for part in reversed(parts):
                for v in part:
                    total += v
            any_yet |= values[i] is not None
            if any_yet:
                low = min(low, total)
            assert found[k, i] == ((total, low) if any_yet else (None, None)), (k, i)


def test_scores_at_the_limit_equal_sql(spark, tmp_path):
    """Scores of exactly 5000, where the last digit of the running sum decides: F2."""
    import duckdb

    path = str(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"copy (select event_id + i * 100000 as event_id, ts, user_id, event_type, value, props from '/root/testdata/sf0.1/events.parquet', range(5) r(i)) to '{path}'")
    con.execute(f"create view events as select * from '{path}'")
    for name in ("n09_cusum", "n08_page_hinkley"):
        out = str(tmp_path / name)
        registry.QUERIES[name](spark, str(tmp_path)).write.parquet(out)
        con.execute(f"create table {name} as {registry.ORACLES[name]}")
        columns = ", ".join(r[0] for r in con.execute(f"describe {name}").fetchall())
        for a, b in ((name, f"'{out}/*.parquet'"), (f"'{out}/*.parquet'", name)):
            assert not con.execute(f"select {columns} from {a} except all select {columns} from {b}").fetchall()


def test_range_totals_equal_plain_frames(spark, small):
    """Dense seconds, nulls in the key, the number and the value; no window slides over the rows of a key: F3."""
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-40, 60)]), rng.choice([None, 1.0, 2.5]), i) for i in range(800)]
    totals = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "m": ("max", F.col("v"))}
    found = {r.i: (r.n, r.s, r.m) for r in O.range_totals(spark.createDataFrame(rows, "k string, t long, v double, i long"), "k", "t", 7, totals).collect()}
    assert len(found) == len(rows)
    for k, t, _, i in rows:
        near = [r[2] for r in rows if r[0] == k and (r[1] is None if t is None else r[1] is not None and t - 7 <= r[1] <= t)]
        known = [v for v in near if v is not None]
        assert found[i] == (len(near), sum(known) if known else None, max(known, default=None))
    assert "RangeFrame" not in registry.QUERIES["sql_range_frame"](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_outliers_of_frames_equal_plain_windows(spark, monkeypatch):
    """Scores over many frames and chunks, against plain windows; a frame is scored at once: F7."""
    from tidewatch.operators import alerts

    monkeypatch.setattr(O, "FRAME_ROWS", 37)
    rng = random.Random(5)
    rows = [(k, i, 3.0 if i < 20 else rng.uniform(0, 10)) for k in ("a", None) for i in range(300)]
    df = alerts.confirmed_outliers(spark.createDataFrame(rows, "k string, i long, v double"), "k", ["i"], "v", window=11, threshold=1.5, least=5)
    assert "FlatMapGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString()
    found = {(r.k, r.i): r for r in df.collect()}
    assert len(found) == len(rows)
    for k in ("a", None):
        values, run = [v for key, _, v in rows if key == k], 0
        for i, v in enumerate(values):
            w = values[max(0, i - 10) : i + 1]
            m = sum(w) / len(w)
            sd = math.sqrt(sum((y - m) ** 2 for y in w) / (len(w) - 1)) if len(w) > 1 else 0.0
            z = (v - m) / sd if sd > 1e-9 else 0.0
            run = run + 1 if len(w) >= 5 and abs(z) > 1.5 else 0
            assert math.isclose(found[k, i].z, z, rel_tol=1e-9, abs_tol=1e-9) and found[k, i].run == run


def test_rows_keep_their_columns(spark):
    """A column of the rows named as the key is held in running values and places: F1 of round 4."""
    df = spark.createDataFrame([("a", i, 7 * i) for i in range(30)] + [(None, i, -i) for i in range(5)], "k string, i long, _k long")
    got = O.running(O.in_blocks(df, "i"), "k", ["i"], [("s", "sum", F.col("_k"))])
    assert sorted((r.k or "", r.i, r._k, r.s) for r in got.collect()) == sorted([("a", i, 7 * i, 7 * i * (i + 1) // 2) for i in range(30)] + [("", i, -i, -i * (i + 1) // 2) for i in range(5)])
    assert sorted((r.k or "", r.i, r._k, r._rn, r._total) for r in O.numbered(df, "k", ["i"]).collect()) == sorted([("a", i, 7 * i, i + 1, 30) for i in range(30)] + [("", i, -i, i + 1, 5) for i in range(5)])


def test_punctuated_watermark_equals_plain_walk(spark, monkeypatch):
    """Null sources and times, events that share a place, many blocks: F1 of round 4."""
    from tidewatch.operators import windows as W

    monkeypatch.setattr(O, "BLOCK_ROWS", 11)
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-500, 500)]), rng.randrange(200)) for _ in range(500)] + [("c", 5, i) for i in range(9)]
    found = W.punctuated_watermark(spark.createDataFrame(rows, "k string, t long, i long"), "k", "t", "i", 10)
    assert found.columns == ["k", "t", "i", "watermark"]
    expected, state = [], {}
    for k, t, i in sorted(rows, key=lambda r: (r[2], r[1] is not None, r[1] or 0)):
        n, top, watermark = state.get(k, (0, None, None))
        n, top = n + 1, max((x for x in (top, t) if x is not None), default=None)
        watermark = top if n % 10 == 0 else watermark
        state[k] = n, top, watermark
        expected.append((k, t, i, watermark))
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in found.collect())
