"""Batch and stream give the same windows; restarts go on; keyed state equals a plain loop."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tidewatch.operators import windows as W
from tidewatch.sources.tables import requests, stream_files
from tidewatch.streaming import pipeline as S

SPECS = [("count", "latency_ms", "n"), ("avg", "latency_ms", "mean"), ("percentile", "latency_ms", "p95", 95)]


def files(spark, small, path, parts=3):
    rows = S.event_time(requests(spark, small), "event_time").select("request_id", "model_id", "event_time", "latency_ms")
    for i in range(parts):
        rows.where(F.col("request_id") % parts == i).coalesce(1).write.mode("append").parquet(path)
    return rows


def test_stream_windows_equal_batch(spark, small, tmp_path):
    rows = files(spark, small, f"{tmp_path}/in")
    stream = stream_files(spark, "parquet", f"{tmp_path}/in", rows.schema, 1)
    out = S.windowed(stream, "event_time", "60 days", ["model_id"], W.tumbling("event_time", "1 day"), SPECS)
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("select model_id, window_start, n, round(mean, 6), round(p95, 6) from w").collect()}
    batch = W.window_aggregate(rows, ["model_id"], W.tumbling("event_time", "1 day"), SPECS)
    assert got == {tuple(r) for r in batch.select("model_id", "window_start", "n", F.round("mean", 6), F.round("p95", 6)).collect()}


def test_restart_goes_on(spark, small, tmp_path):
    rows = files(spark, small, f"{tmp_path}/in")
    for _ in range(2):
        S.to_files(stream_files(spark, "parquet", f"{tmp_path}/in", rows.schema), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == rows.count()


def test_dead_letters_and_dedup(spark, small, tmp_path):
    rows = files(spark, small, f"{tmp_path}/in", 1)
    stream = stream_files(spark, "parquet", f"{tmp_path}/in", rows.schema)
    S.split_to_files(stream, F.col("latency_ms") < 1000, f"{tmp_path}/good", f"{tmp_path}/dead", f"{tmp_path}/c1").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/dead").count() == rows.where("latency_ms >= 1000").count() > 0
    doubled = S.deduplicated(stream.unionByName(stream_files(spark, "parquet", f"{tmp_path}/in", rows.schema)), "event_time", "60 days", ["request_id"])
    S.to_files(doubled, f"{tmp_path}/once", f"{tmp_path}/c2").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/once").count() == rows.count()


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_keyed_state_equals_loops(spark, small, tmp_path):
    rows = files(spark, small, f"{tmp_path}/in", 1)
    stream = stream_files(spark, "parquet", f"{tmp_path}/in", rows.schema)
    n = rows.groupBy("model_id").count().collect()
    for name, out in (("cw", S.count_windows(stream, "model_id", "latency_ms", 10)), ("ra", S.running_average(stream, "model_id", "latency_ms", 0.3))):
        out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(180)
    fired = {r.key: r.n for r in spark.sql("select key, count(*) as n from cw group by key").collect()}
    assert fired == {r.model_id: r["count"] // 10 for r in n if r["count"] >= 10}
    ema = spark.sql("select key, count(*) as n, max(ema) as top, max(value) as most from ra group by key").collect()
    assert {r.key: r.n for r in ema} == {r.model_id: r["count"] for r in n} and all(r.top <= r.most for r in ema)


def timed(spark, path, batches):
    """One file a batch of (key, seconds, value)."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "k string, s long, v double").select("k", F.timestamp_seconds("s").alias("ts"), "v")
        df.coalesce(1).write.parquet(f"{path}/b{i:02d}")
    return df.schema


def run_to_rows(spark, df, name, path, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start().awaitTermination(180)
    return [tuple(r) for r in spark.sql(f"select * from {name}").collect()]


LATE = [[("a", 10, 1.0), ("a", 70, 2.0)], [("a", 200, 3.0)], [("a", 210, 0.5)], [("a", 20, 100.0), ("a", 190, 4.0)], [("a", 400, 5.0)], [("a", 900, 6.0)]]


def test_append_mode_fires_closed_windows_and_drops_late_rows(spark, tmp_path):
    """With a delay of 60 s the row of second 20 comes when the watermark of the batch before is past its window; the one of 190 is in time."""
    schema = timed(spark, f"{tmp_path}/in", LATE)
    stream = stream_files(spark, "parquet", f"{tmp_path}/in/*", schema, 1)
    out = S.windowed(stream, "ts", "60 seconds", ["k"], W.tumbling("ts", "60 seconds"), [("count", "v", "n"), ("sum", "v", "total")])
    rows = run_to_rows(spark, out, "late", tmp_path)
    assert sorted((int(r[1].timestamp()), r[3], r[4]) for r in rows) == [(0, 1, 1.0), (60, 1, 2.0), (180, 3, 7.5), (360, 1, 5.0)]


def test_stateful_restart_keeps_counts(spark, tmp_path):
    """A second run over more files goes on with the state of the first one."""
    schema = timed(spark, f"{tmp_path}/in", LATE[:2])
    seen = []

    def run():
        stream = stream_files(spark, "parquet", f"{tmp_path}/in/*", schema, 1)
        sink = lambda df, _: seen.append({r.k: (r.n, r.total) for r in df.collect()})
        S.early_results(stream, "ts", "1 day", ["k"], W.tumbling("ts", "1 day"), [("count", "v", "n"), ("sum", "v", "total")], sink, f"{tmp_path}/check").awaitTermination(180)

    run()
    timed_more = spark.createDataFrame([("a", 500, 10.0)], "k string, s long, v double").select("k", F.timestamp_seconds("s").alias("ts"), "v")
    timed_more.coalesce(1).write.parquet(f"{tmp_path}/in/b99")
    run()
    assert [x["a"] for x in seen if "a" in x] == [(2, 3.0), (3, 6.0), (4, 16.0)]


def test_triggers_by_count_and_watermark(spark, tmp_path):
    schema = timed(spark, f"{tmp_path}/in", LATE)
    stream = stream_files(spark, "parquet", f"{tmp_path}/in/*", schema, 1)
    by_any = run_to_rows(spark, S.triggered(stream, "k", "ts", "v", 60_000, count=2, after_ms=30_000, delay="0 seconds"), "any_trigger", tmp_path)
    found = {(r[1] // 1000, r[3], r[5]) for r in by_any}
    assert {(0, 1, "timer"), (60, 1, "timer"), (180, 2, "count"), (180, 2, "timer"), (360, 1, "timer")} <= found
    by_all = run_to_rows(spark, S.triggered(stream, "k", "ts", "v", 60_000, count=2, after_ms=30_000, mode="all", delay="0 seconds"), "all_trigger", tmp_path)
    assert all(r[3] % 2 == 0 or r[5] == "expired" for r in by_all)  # what never fits the count comes out once, as expired
    assert {0, 60, 180} <= {r[1] // 1000 for r in by_all}  # later windows wait for batches that are to come


def test_processing_timers_fire_past_windows_at_once(spark, tmp_path):
    """Windows of 1970 have long passed by the clock: every element fires."""
    schema = timed(spark, f"{tmp_path}/in", LATE)
    stream = stream_files(spark, "parquet", f"{tmp_path}/in/*", schema, 1)
    q = S.triggered(stream, "k", "ts", "v", 60_000, after_ms=0).writeStream.format("memory").queryName("clock_trigger").option("checkpointLocation", f"{tmp_path}/c").start()
    for _ in range(240):  # a query with such timers goes on until it is stopped
        time.sleep(0.5)
        if spark.table("clock_trigger").count() >= sum(map(len, LATE)):
            break
    q.stop()
    rows = [tuple(r) for r in spark.table("clock_trigger").collect()]
    assert len(rows) == sum(map(len, LATE)) and {r[5] for r in rows} == {"element"}


def test_repeated_batch_replaces_itself(spark, tmp_path):
    from tidewatch.sources.tables import append_once

    write = append_once(f"{tmp_path}/out")
    df = spark.range(10)
    write(df, 3)
    write(df, 3)
    write(df, 4)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20


def test_streams_into_tables_and_file_kinds(spark, small, tmp_path):
    from tidewatch.sources.tables import read_any

    rows = files(spark, small, f"{tmp_path}/in", 1)
    S.to_table(stream_files(spark, "parquet", f"{tmp_path}/in", rows.schema), "kept_requests", f"{tmp_path}/c").awaitTermination(120)
    assert spark.table("kept_requests").count() == rows.count()
    spark.sql("drop table kept_requests")
    for kind in ("json", "csv", "orc"):
        rows.write.format(kind).save(f"{tmp_path}/{kind}")
        assert read_any(spark, kind, f"{tmp_path}/{kind}", rows.schema).count() == rows.count()
