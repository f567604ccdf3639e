"""Streaming forms: the batch functions over unbounded frames, sinks with side outputs, and keyed state.

Event time must be a TIMESTAMP: NTZ columns are cast in UTC.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import window_aggregate


def event_time(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def windowed(df: DataFrame, ts: str, delay: str, keys: Sequence[str], window: Column, specs: Sequence[tuple]) -> DataFrame:
    """Keyed window aggregation with a watermark; in append mode a window fires once it has passed its end."""
    return window_aggregate(event_time(df, ts).withWatermark(ts, delay), keys, window, specs)


def deduplicated(df: DataFrame, ts: str, delay: str, keys: Sequence[str]) -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def enriched(stream: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Stream rows with the columns of a static dimension."""
    return stream.join(dimension, key, "left")


def joined_within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, delay: str, within: str, how: str = "inner") -> DataFrame:
    """Two streams joined where the right event follows the left one by at most `within`.

    Both sides have a watermark, so state ends: a left row is held until the watermark is `within` past it, and with how
    left it then comes out with nulls if nothing followed. The slower of the two inputs sets the watermark
    (spark.sql.streaming.multipleWatermarkPolicy is min by default).
    """
    a, b = event_time(left, left_ts).withWatermark(left_ts, delay), event_time(right, right_ts).withWatermark(right_ts, delay)
    bound = (b[right_ts] >= a[left_ts]) & (b[right_ts] <= a[left_ts] + F.expr(f"interval {within}"))
    return a.join(b, (a[key] == b[key]) & bound, how).drop(b[key])


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def early_results(df: DataFrame, ts: str, delay: str, keys: Sequence[str], window: Column, specs: Sequence[tuple], sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Results of open windows at an interval before the watermark has passed them: update mode, each batch to `sink`."""
    out = windowed(df, ts, delay, keys, window, specs).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def to_table(df: DataFrame, table: str, checkpoint: str):
    """INSERT INTO a table from a stream, over all that is there."""
    return df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).toTable(table)


def to_kafka(df: DataFrame, servers: str, checkpoint: str, **options):
    """Rows of (key, value, topic, partition) to Kafka; a restart may repeat a batch, so readers must bear repeats."""
    return df.writeStream.format("kafka").options(**{"kafka.bootstrap.servers": servers}, **options).option("checkpointLocation", checkpoint).start()


def to_files(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run over all that is there and stop; the checkpoint makes a restart go on where it ended."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def split_to_files(df: DataFrame, good: Column, path: str, dead_path: str, checkpoint: str):
    """Good rows and dead letters of each batch, each batch under its own number so that a repeat replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        ok = F.coalesce(good, F.lit(False))
        batch.where(ok).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.where(~ok).write.mode("overwrite").parquet(f"{dead_path}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_to_files(df: DataFrame, ts: str, delay_s: float, path: str, checkpoint: str):
    """The rows of a stream in time and, as a side output, those behind the watermark, with what is known of lateness.

    The watermark of a batch is the latest time of all batches before it less the delay, as in Spark, which would drop
    the late rows unseen. Under `path`, each batch writes its rows to accepted and late (with late_by_s, seconds behind
    the watermark) and a row to lateness: the watermark, the latest time, rows accepted and late, and the sum of the
    lateness. A batch that is repeated after a failure finds the same watermark and replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            before = spark.read.parquet(f"{path}/lateness").where(F.col("batch") < number).agg(F.max("latest")).first()[0]
        except AnalysisException as missing:
            if number or "PATH_NOT_FOUND" not in str(missing):
                raise
            before = None
        seconds = F.col(ts).cast("timestamp").cast("double")
        limit = F.lit(None if before is None else before - delay_s).cast("double")
        late = F.coalesce(seconds < limit, F.lit(False))
        batch.where(~late).write.mode("overwrite").parquet(f"{path}/accepted/batch={number}")
        batch.where(late).withColumn("late_by_s", limit - seconds).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        sums = batch.agg(F.greatest(F.max(seconds), F.lit(before).cast("double")).alias("latest"), F.count(F.when(~late, 1)).alias("accepted"), F.count(F.when(late, 1)).alias("late"), F.sum(F.when(late, limit - seconds)).alias("late_by_s"))
        sums.select(limit.alias("watermark"), "*").coalesce(1).write.mode("overwrite").parquet(f"{path}/lateness/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lateness(spark: SparkSession, path: str) -> DataFrame:
    """(accepted, late, mean_late_s) over all that late_to_files has written to `path`."""
    sums = spark.read.parquet(f"{path}/lateness").agg(F.sum("accepted").alias("accepted"), F.sum("late").alias("late"), F.sum("late_by_s").alias("_s"))
    return sums.select("accepted", "late", (F.col("_s") / F.col("late")).alias("mean_late_s"))


class DeadLetters(StatefulProcessor):
    """Failed rows that are tried again: state per id holds the payload, the tries so far and when the next one is due.

    A row that succeeds comes out as `replayed` with the tries that it took, one that has failed `most` times or is
    older than `keep_ms` as `purged`. The wait doubles with each failure. `good` is told the payload and the number of tries.
    """

    def __init__(self, payload: str, good: Callable[[str, int], bool], wait_ms: int, most: int, keep_ms: int) -> None:
        self.payload, self.good, self.wait_ms, self.most, self.keep_ms = payload, good, wait_ms, most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("letter", "payload string, tries int, first long")

    def tried(self, key, payload: str, tries: int, first: int, now: int) -> list[tuple]:
        """One more try; what comes out of it. The letter waits on if it failed and may be tried again."""
        tries += 1
        if self.good(payload, tries):
            self.state.clear()
            return [(key[0], payload, tries, "replayed")]
        wait = self.wait_ms << (tries - 1)
        if tries >= self.most or now + wait - first > self.keep_ms:
            self.state.clear()
            return [(key[0], payload, tries, "purged")]
        self.state.update((payload, tries, first))
        self.handle.registerTimer(now + wait)
        return [(key[0], payload, tries, "waiting")]

    def rows(self, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["id", "payload", "tries", "outcome"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        found, now = [], timer_values.getCurrentProcessingTimeInMs()
        for pdf in rows:
            for payload in pdf[self.payload]:
                if not self.state.exists():  # a letter that waits already is not taken up twice
                    found += self.tried(key, payload, 0, now, now)
        yield self.rows(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        found = []
        if self.state.exists():
            payload, tries, first = self.state.get()
            found = self.tried(key, payload, tries, first, expiredTimerInfo.getExpiryTimeInMs())
        yield self.rows(found)

    def close(self) -> None:
        pass


def replayed(letters: DataFrame, key: str, payload: str, good: Callable[[str, int], bool], wait_ms: int, most: int = 5, keep_ms: int = 7 * 86_400_000, key_type: str = "string") -> DataFrame:
    """(id, payload, tries, outcome) of every try of the dead letters of a stream: waiting, replayed or purged."""
    processor = DeadLetters(payload, good, wait_ms, most, keep_ms)
    return letters.groupBy(key).transformWithStateInPandas(processor, f"id {key_type}, payload string, tries int, outcome string", "append", "processingTime")


class CountWindows(StatefulProcessor):
    """Fires the sum and mean of every `size` events of a key and starts anew (a count trigger that fires and purges)."""

    def __init__(self, value: str, size: int) -> None:
        self.value, self.size = value, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "number long, n long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        number, n, total = self.state.get() if self.state.exists() else (0, 0, 0.0)
        fired = []
        for pdf in rows:
            for x in pdf[self.value]:
                n, total = n + 1, total + float(x)
                if n == self.size:
                    fired.append((key[0], number, total, total / n))
                    number, n, total = number + 1, 0, 0.0
        self.state.update((number, n, total))
        yield pd.DataFrame(fired, columns=["key", "window_no", "total", "mean"])

    def close(self) -> None:
        pass


class Triggers(StatefulProcessor):
    """A key's windows of event time that fire as their triggers say, with count, sum and the reason.

    `count` fires at every so many events of a window, `after` once the clock (the processing time, or on a watermark
    the watermark) is so many milliseconds past the window's end. In mode any a window fires where one holds, and ends
    with its time: an event that comes later fires alone, at once, and is not kept. In mode all it fires where both hold.
    A window whose time comes while its count does not fit waits another `grace_ms`; so does one that is opened by an
    event after its time. What is left then comes out once as `expired`, so every event is in some row and all state ends.
    """

    def __init__(self, ts: str, value: str, size_ms: int, count: int | None, after_ms: int | None, mode: str = "any", grace_ms: int | None = None) -> None:
        self.ts, self.value, self.size_ms, self.count, self.after_ms, self.mode = ts, value, size_ms, count, after_ms, mode
        self.both = mode == "all" and count is not None and after_ms is not None
        self.grace_ms = size_ms if grace_ms is None else grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "opened long", "n long, total double, due long, waited boolean")

    def clock(self, timer_values) -> int:
        return timer_values.getCurrentProcessingTimeInMs()

    def row(self, key, opened: int, n: int, total: float, reason: str) -> tuple:
        return (key[0], opened, opened + self.size_ms, n, total, reason)

    def rows(self, fired: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(fired, columns=["key", "opened", "closed", "n", "total", "reason"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        fired, now = [], self.clock(timer_values)
        for pdf in rows:
            for at, x in zip(pdf[self.ts].astype("datetime64[ms]").astype("int64"), pdf[self.value], strict=True):
                opened = int(at) // self.size_ms * self.size_ms
                end = opened + self.size_ms + (self.after_ms or 0)
                known = self.windows.containsKey((opened,))
                n, total, due, waited = self.windows.getValue((opened,)) if known else (0, 0.0, end, False)
                n, total = n + 1, total + float(x)
                by_count = self.count is not None and n % self.count == 0
                by_time = self.after_ms is not None and now >= end
                if (by_count and by_time) if self.both else (by_count or by_time):
                    fired.append(self.row(key, opened, n, total, "count" if by_count else "element"))
                    if by_time:  # nothing more is to come of this window
                        if known:
                            self.windows.removeKey((opened,))
                            self.handle.deleteTimer(due)
                        continue
                if not known and self.after_ms is not None:
                    due, waited = (now + max(1, self.grace_ms), True) if by_time else (end, False)
                    self.handle.registerTimer(due)
                self.windows.updateValue((opened,), (n, total, due, waited))
        yield self.rows(fired)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        now, fired = expiredTimerInfo.getExpiryTimeInMs(), []
        for (opened,), (n, total, due, waited) in [(k, v) for k, v in self.windows.iterator() if v[2] <= now]:
            fits = not self.both or n % self.count == 0
            if fits or waited or not self.grace_ms:
                fired.append(self.row(key, opened, n, total, "timer" if fits and not waited else "expired"))
                self.windows.removeKey((opened,))
            else:
                self.windows.updateValue((opened,), (n, total, due + self.grace_ms, True))
                self.handle.registerTimer(due + self.grace_ms)
        yield self.rows(fired)

    def close(self) -> None:
        pass


class WatermarkTriggers(Triggers):
    """The same with timers on the watermark: results after the watermark passes the end by a delay."""

    def clock(self, timer_values) -> int:
        return timer_values.getCurrentWatermarkInMs()


def triggered(df: DataFrame, key: str, ts: str, value: str, size_ms: int, count: int | None = None, after_ms: int | None = None, mode: str = "any", delay: str | None = None, key_type: str = "string", grace_ms: int | None = None) -> DataFrame:
    """Windows with count and time triggers, any or all of them; with a watermark delay, time is the watermark's."""
    rows = event_time(df, ts).withWatermark(ts, delay) if delay else event_time(df, ts)
    processor = (WatermarkTriggers if delay else Triggers)(ts, value, size_ms, count, after_ms, mode, grace_ms)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"key {key_type}, opened long, closed long, n long, total double, reason string", "append", "eventTime" if delay else "processingTime")


class RunningAverage(StatefulProcessor):
    """The exponential average of a key, one row per event."""

    def __init__(self, value: str, alpha: float) -> None:
        self.value, self.alpha = value, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("average", "ema double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        ema, out = (self.state.get()[0] if self.state.exists() else None), []
        for pdf in rows:
            for x in pdf[self.value]:
                ema = float(x) if ema is None else self.alpha * float(x) + (1 - self.alpha) * ema
                out.append((key[0], float(x), ema))
        if ema is not None:
            self.state.update((ema,))
        yield pd.DataFrame(out, columns=["key", "value", "ema"])

    def close(self) -> None:
        pass


def count_windows(df: DataFrame, key: str, value: str, size: int, key_type: str = "string") -> DataFrame:
    return df.groupBy(key).transformWithStateInPandas(CountWindows(value, size), f"key {key_type}, window_no long, total double, mean double", "append", "none")


def running_average(df: DataFrame, key: str, value: str, alpha: float, key_type: str = "string") -> DataFrame:
    return df.groupBy(key).transformWithStateInPandas(RunningAverage(value, alpha), f"key {key_type}, value double, ema double", "append", "none")
