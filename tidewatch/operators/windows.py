"""Event-time windows: assignment, keyed aggregation, count windows, growing windows, capped sessions, triggers.

The functions that only use event time take batch and streaming DataFrames alike.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered
from .aggregates import agg_spec
from .walks import walk


def tumbling(ts: str, size: str, offset: str | None = None) -> Column:
    return F.window(ts, size, size, offset) if offset else F.window(ts, size)


def sliding(ts: str, size: str, slide: str, offset: str | None = None) -> Column:
    return F.window(ts, size, slide, offset) if offset else F.window(ts, size, slide)


def session(ts: str, gap: str) -> Column:
    """Merged sessions: events less than the gap apart are one session; it ends a gap after its last event."""
    return F.session_window(ts, gap)


def window_aggregate(df: DataFrame, keys: Sequence[str], window: Column, specs: Sequence[tuple]) -> DataFrame:
    """Keyed aggregation per window, with the window as two columns."""
    out = df.groupBy(*keys, window.alias("_w")).agg(*agg_spec(specs))
    return out.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c not in (*keys, "_w")])


def count_windows(df: DataFrame, key: str, order: Sequence[str], size: int) -> DataFrame:
    """Window number of each row: every `size` rows of a key in order; `complete` says whether the window has fired."""
    rows = ordered.numbered(df, key, order).withColumn("window_no", F.floor((F.col("_rn") - 1) / size))
    return rows.withColumn("complete", (F.col("window_no") + 1) * size <= F.col("_total")).drop("_rn", "_total")


def cumulate(df: DataFrame, keys: Sequence[str], epoch: str, step: int, most: int, value: str) -> DataFrame:
    """Growing windows that share a start: rows are reduced to steps first, then summed up inside each window."""
    steps = df.groupBy(*keys, (F.col(epoch) - F.pmod(epoch, F.lit(step))).alias("_step")).agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    steps = steps.withColumn("window_start", F.col("_step") - F.pmod("_step", F.lit(most)))
    up_to = Window.partitionBy(*keys, "window_start").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*keys, "window_start", (F.col("_step") + step).alias("window_end"), F.sum("_n").over(up_to).alias("n"), F.sum("_v").over(up_to).alias("total"))


def capped_sessions(df: DataFrame, key: str, epoch: str, order: str, gap: int, most: int) -> DataFrame:
    """Sessions that also end when an event is `most` seconds or more after the session's start.

    The cut depends on the cut before it, so each key's events are walked in order; `session_no` counts from 0.
    """

    def start():
        number, first, last = -1, None, None

        def step(t):
            nonlocal number, first, last
            t = math.nan if t is None else t
            if last is None or t - last > gap or t - first >= most:
                number, first = number + 1, t
            last = t
            return number

        return step

    return walk(df, key, [epoch, order], epoch, start, [key, order, epoch], "session_no long")


def count_trigger(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The rows at which a window with a count trigger fires: every n-th of its key and window."""
    return df.withColumn("fired_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("fired_at") % n == 0)


def bounds_algebra(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> dict[str, Column]:
    """Relations of two half-open windows."""
    return {
        "overlaps": (a_start < b_end) & (b_start < a_end),
        "contains": (a_start <= b_start) & (b_end <= a_end),
        "merged_start": F.least(a_start, b_start),
        "merged_end": F.greatest(a_end, b_end),
        "gap": F.greatest(F.lit(0), F.greatest(a_start, b_start) - F.least(a_end, b_end)),
    }


def watermark_replay(df: DataFrame, source: str, epoch: str, order: str, delay: int) -> DataFrame:
    """Each event in arrival order with the watermark that it met: the latest time before it less the delay."""
    rows = ordered.running(ordered.in_blocks(df, order), source, [order], [("_top", "max", F.col(epoch), True)])
    marked = rows.withColumn("watermark", F.col("_top") - delay).drop("_top", "_block")
    late = F.coalesce(F.col(epoch) < F.col("watermark"), F.lit(False))
    return marked.withColumn("is_late", late).withColumn("lateness", F.when(late, F.col("watermark") - F.col(epoch)).otherwise(0))


def punctuated_watermark(df: DataFrame, source: str, epoch: str, order: str, every: int) -> DataFrame:
    """A watermark that only moves at every n-th event of its source; events that share a place count by their time, in both passes."""
    counted = ordered.running(ordered.in_blocks(df, order), source, [order, epoch], [("_nth", "count", F.lit(1)), ("_top", "max", F.col(epoch))])
    marked = ordered.running(counted, source, ["_nth"], [("watermark", "max", F.when(F.col("_nth") % every == 0, F.col("_top")))])
    return marked.drop("_nth", "_top", "_block")


def late_policy(replayed: DataFrame, allowed: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, dropped): late events up to the allowed lateness are kept."""
    drop = F.col("is_late") & (F.col("lateness") > allowed)
    return replayed.where(~drop), replayed.where(drop)
