"""Plans over small tables that are made to reach past what the given tables hold."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from tidewatch.operators import series
from tidewatch.plans import registry


def events(folder, rows):
    """An events table of (seconds since 2024-01-01, user_id) in order."""
    start = datetime(2024, 1, 1)
    columns = {"event_id": range(len(rows)), "ts": [start + timedelta(seconds=s) for s, _ in rows], "user_id": [u for _, u in rows], "event_type": ["click"] * len(rows), "value": [1.0] * len(rows), "props": ["{}"] * len(rows)}
    kinds = {"event_id": pa.int64(), "ts": pa.timestamp("us"), "user_id": pa.int64(), "event_type": pa.string(), "value": pa.float64(), "props": pa.string()}
    pq.write_table(pa.table({c: pa.array(list(v), kinds[c]) for c, v in columns.items()}), folder / "events.parquet")
    return str(folder)


def test_ordered_lists_keep_hot_users(spark, tmp_path):
    path = events(tmp_path, [(i, 7 if i % 6 else 8) for i in range(3000)])
    found = {r.user_id: r for r in registry.QUERIES["a06_ordered_lists"](spark, path).collect()}
    assert {u: r.ids for u, r in found.items()} == {u: [i for i in range(3000) if (7 if i % 6 else 8) == u] for u in (7, 8)}
    assert found[7].n_models == 4 and len(found[7].models.split(",")) == 2500


def test_bursts_look_back_across_any_hour(spark, tmp_path):
    start = 473352  # hours from 1970 to 2024; multiples of 720 hours follow at 408, 1128 and 1848
    per_hour = {h: 1 for h in range(370, 440, 3)} | {408: 9, 410: 2, 411: 5, 1128: 7, 1129: 8, 1848: 20}
    path = events(tmp_path, [(h * 3600 + i, 1) for h, n in sorted(per_hour.items()) for i in range(n)])
    hours, expected = sorted(per_hour.items()), []
    for k, (h, n) in enumerate(hours):
        before = [m for _, m in hours[max(0, k - 10) : k]]
        if before and n > 2 * sum(before) / len(before):
            expected.append((start + h, n, round(sum(before) / len(before), 6)))
    assert len({408, 1128, 1848} & {t - start for t, _, _ in expected}) == 3
    assert sorted(tuple(r) for r in registry.QUERIES["z06_bursts"](spark, path).collect()) == expected


def test_keys_are_walked_in_pieces(spark, tmp_path):
    path = events(tmp_path, [(i * 5003 % 700 * 600, 7 if i % 6 else 8) for i in range(700)])
    names = ["t03_exponential_average_rows", "t08_outlier_drop", "w05_capped_sessions", "x06_token_bucket"]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    try:
        plans = {n: registry.QUERIES[n](spark, path) for n in names}
        found = {n: {r.request_id: r for r in df.collect()} for n, df in plans.items()}
    finally:
        spark.conf.set(batch, usual)
    rows = sorted(((i * 5003 % 700 * 600, i, 7 if i % 6 else 8) for i in range(700)))
    for user in (7, 8):
        number, first, last, level, at = -1, None, None, 2.0, None
        for t, i, _ in (r for r in rows if r[2] == user):
            if last is None or t - last > 12 * 3600 or t - first >= 48 * 3600:
                number, first = number + 1, t
            last = t
            level = 2.0 if at is None else min(2.0, level + (t - at) / 43200)
            at = t
            assert (found["w05_capped_sessions"][i].session_no, found["x06_token_bucket"][i].passed) == (number, level >= 1)
            level -= level >= 1
    assert {i: round(r.ema, 9) for i, r in found["t03_exponential_average_rows"].items()} == dict.fromkeys(range(700), 20.0)
    assert len(found["t08_outlier_drop"]) == 700
    for n, df in plans.items():  # no operator that takes a key's rows as one piece
        assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString(), n


def test_walks_treat_missing_values_and_keys_as_groups_do(spark):
    rows = [(k, i, v) for k in ("a", None) for i, v in enumerate([None, 3.0, None, 1.0, 4.0, None, None, 9.0])]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    mean = pd.Series([v for _, _, v in rows[:8]]).ewm(alpha=0.3, adjust=False).mean()
    expected = sorted((str(k), i, None if math.isnan(x) else round(x, 9)) for k in ("a", None) for i, x in enumerate(mean))
    assert sorted((str(r.k), r.i, None if r.ema is None else round(r.ema, 9)) for r in series.exponential_average_by_row(df, "k", "i", "v", 0.3).collect()) == expected
