"""Streams joined with streams and tables, triggers that keep every event, late rows as a side output, dead letters."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import windows as W
from tidewatch.sources.tables import stream_files
from tidewatch.streaming import pipeline as S

SCHEMA = "k string, s long, v double"


def add_files(spark, path, batches, start=0):
    """One file a batch of (key, seconds, value)."""
    for i, rows in enumerate(batches, start):
        df = spark.createDataFrame(rows, SCHEMA).select("k", F.timestamp_seconds("s").alias("ts"), "v")
        df.coalesce(1).write.parquet(f"{path}/b{i:02d}")
    return df.schema


def stream(spark, path, schema):
    return stream_files(spark, "parquet", f"{path}/*", schema, 1)


def run(df, path, mode="append"):
    """All that is there, through a sink of files that outlives a restart; returns the query."""
    q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return q


def run_until(df, path, done):
    """A query with processing-time timers never ends by itself: run it until its files show what is waited for."""
    q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            assert q.exception() is None
            if done():
                break
        time.sleep(2)  # one batch more, after which the state is as it stays
        return state_rows(q)
    finally:
        q.stop()


def state_rows(q):
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_streams_are_joined_within_bounds(spark, tmp_path, how):
    """A match, one in another batch, one too late, one of another key, a left row that nothing follows, then a restart."""
    left, right = f"{tmp_path}/l", f"{tmp_path}/r"
    schema = add_files(spark, left, [[("a", 100, 1.0), ("b", 100, 2.0)], [("a", 200, 3.0)]])
    add_files(spark, right, [[("a", 105, 10.0), ("b", 131, 20.0)], [("a", 229, 30.0), ("c", 200, 40.0)]])

    def go():
        a, b = stream(spark, left, schema), stream(spark, right, schema).select("k", F.col("ts").alias("ts2"), F.col("v").alias("w"))
        q = run(S.joined_within(a, b, "k", "ts", "ts2", "10 seconds", "30 seconds", how), tmp_path)
        rows = spark.read.parquet(f"{tmp_path}/out").collect()
        return q, sorted((r.k, r.v, -1.0 if r.w is None else r.w) for r in rows)

    _, found = go()
    matched = [("a", 1.0, 10.0), ("a", 3.0, 30.0)]
    assert [x for x in found if x[2] > 0] == matched
    # both inputs move on: the watermark passes all that is held; the late rows of second 110 can match no more
    add_files(spark, left, [[("z", 900, 0.0)], [("z", 950, 0.0), ("a", 110, 9.0)]], 2)
    add_files(spark, right, [[("y", 900, 0.0)], [("y", 950, 0.0), ("a", 112, 99.0)]], 2)
    q, found = go()
    assert [x for x in found if x[2] > 0] == matched
    assert (("b", 2.0, -1.0) in found) == (how == "left") and not [x for x in found if x[2] == 99.0]
    assert state_rows(q)[-1] < max(state_rows(q))


def test_slower_input_holds_the_watermark(spark, tmp_path):
    """With the policy min, Spark's own, no row is lost while the other side is hours ahead."""
    schema = add_files(spark, f"{tmp_path}/l", [[("a", 100, 1.0)], [("a", 9000, 2.0)], [("a", 9001, 3.0)]])
    add_files(spark, f"{tmp_path}/r", [[("x", 90, 0.0)], [("x", 91, 0.0)], [("a", 110, 10.0)]])
    a, b = stream(spark, f"{tmp_path}/l", schema), stream(spark, f"{tmp_path}/r", schema).select("k", F.col("ts").alias("ts2"), F.col("v").alias("w"))
    run(S.joined_within(a, b, "k", "ts", "ts2", "10 seconds", "30 seconds"), tmp_path)
    assert [(r.v, r.w) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1.0, 10.0)]


def test_stream_is_enriched_by_a_table(spark, tmp_path):
    schema = add_files(spark, f"{tmp_path}/in", [[("a", 1, 1.0), ("q", 2, 2.0)]])
    table = spark.createDataFrame([("a", "alpha"), ("b", "beta")], "k string, name string")
    run(S.chain(stream(spark, f"{tmp_path}/in", schema), lambda d: S.enriched(d, table, "k"), lambda d: d.where("v > 0")), tmp_path)
    assert sorted((r.k, r.name or "") for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", "alpha"), ("q", "")]


def test_window_state_is_evicted(spark, tmp_path):
    """Closed windows leave the state once the watermark has passed them."""
    schema = add_files(spark, f"{tmp_path}/in", [[("a", 60 * i, 1.0) for i in range(20)], [("a", 5000, 1.0)], [("a", 9000, 1.0)], [("a", 9001, 1.0)]])
    q = run(S.windowed(stream(spark, f"{tmp_path}/in", schema), "ts", "0 seconds", ["k"], W.tumbling("ts", "60 seconds"), [("count", "v", "n")]), tmp_path)
    held = state_rows(q)
    assert max(held) >= 20 and held[-1] <= 2


EVENTS = [[("a", 10, 1.0), ("a", 20, 1.0)], [("a", 200, 1.0)], [("a", 30, 1.0), ("a", 40, 1.0)], [("a", 400, 1.0)], [("a", 900, 1.0)], [("a", 2000, 1.0)], [("a", 4000, 1.0)]]


@pytest.mark.parametrize("mode", ["any", "all"])
def test_triggers_keep_every_event_and_end_their_state(spark, tmp_path, mode):
    """Two events of a window that never reach the count, two that come after its time; each is in exactly one last row."""
    schema = add_files(spark, f"{tmp_path}/in", EVENTS)
    rows = S.event_time(stream(spark, f"{tmp_path}/in", schema), "ts")
    q = run(S.triggered(rows, "k", "ts", "v", 60_000, count=3, after_ms=0, mode=mode, delay="0 seconds"), tmp_path)
    out = [(r.opened // 1000, r.n, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    first = sorted(x for x in out if x[0] == 0)
    if mode == "any":  # the first late event still finds the window, the second fires alone
        assert first == [(0, 1, "element"), (0, 3, "count")]
    else:  # the late events join the two that wait, the third makes the count fit, the fourth waits and expires
        assert first == [(0, 1, "expired"), (0, 3, "count")]
    assert {(180, 1), (360, 1), (900, 1)} <= {x[:2] for x in out}
    assert state_rows(q)[-1] <= 4


def test_late_rows_are_a_side_output(spark, tmp_path):
    """Counts and lateness equal a plain loop over the batches; a second run goes on; a repeated batch changes nothing."""
    batches = [[("a", 100, 1.0), ("a", 50, 2.0)], [("b", 80, 3.0), ("b", 95, 4.0), ("a", 300, 5.0)], [("a", 100, 6.0), ("c", 295, 7.0)]]
    more = [[("a", 289, 8.0), ("a", 290, 9.0), ("a", 500, 10.0)]]
    expected, latest = [], None
    for rows in batches + more:
        for _, s, v in rows:
            expected.append((v, 0 if latest is None or s >= latest - 10 else latest - 10 - s))
        latest = max([s for _, s, _ in rows] + ([latest] if latest is not None else []))
    schema = add_files(spark, f"{tmp_path}/in", batches)
    for part in (None, more):
        if part:
            add_files(spark, f"{tmp_path}/in", part, len(batches))
        S.late_to_files(stream(spark, f"{tmp_path}/in", schema), "ts", 10, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(240)
    late = {r.v: r.late_by_s for r in spark.read.parquet(f"{tmp_path}/out/late").collect()}
    assert late == {v: float(by) for v, by in expected if by} and len(late) == 3
    assert {r.v for r in spark.read.parquet(f"{tmp_path}/out/accepted").collect()} == {v for v, by in expected if not by}
    got = S.lateness(spark, f"{tmp_path}/out").first()
    assert (got.accepted, got.late, round(got.mean_late_s, 6)) == (len(expected) - len(late), len(late), round(sum(late.values()) / len(late), 6))


def test_dead_letters_are_replayed_and_purged(spark, tmp_path):
    """Over two runs a letter succeeds at once, one after a wait, one never; state is empty in the end."""
    path = f"{tmp_path}/letters"
    (tmp_path / "out").mkdir()
    write = lambda rows, n: spark.createDataFrame(rows, "id string, payload string").coalesce(1).write.parquet(f"{path}/b{n}")
    write([("1", "good"), ("2", "second"), ("3", "never"), ("2", "second")], 0)
    good = lambda payload, tries: payload == "good" or payload == "second" and tries >= 2

    def outcomes():
        return sorted((r.id, r.tries, r.outcome) for r in spark.read.schema("id string, payload string, tries int, outcome string").parquet(f"{tmp_path}/out").collect())

    def go(wanted):
        letters = stream_files(spark, "parquet", f"{path}/*", spark.createDataFrame([], "id string, payload string").schema, 1)
        held = run_until(S.replayed(letters, "id", "payload", good, wait_ms=300, most=3), tmp_path, lambda: set(wanted) <= set(outcomes()))
        return held, outcomes()

    first = [("1", 1, "replayed"), ("2", 1, "waiting"), ("3", 1, "waiting")]
    _, found = go(first)
    assert set(first) <= set(found)
    write([("4", "good")], 1)
    last = [("2", 2, "replayed"), ("3", 3, "purged"), ("4", 1, "replayed")]
    held, found = go(last)
    assert sorted([*first, ("3", 2, "waiting"), *last]) == found
    assert held[-1] == 0
