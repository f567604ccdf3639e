"""Time series: moving statistics, regular grids, gap filling, interval detection, resampling."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .walks import walk_filter


def rolling(keys: Sequence[str], order: Sequence[str], n: int, *, before: bool = False):
    """A frame of the last n rows, with the current one or only those before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return w.rowsBetween(-n, -1) if before else w.rowsBetween(-(n - 1), 0)


def exponential_average(values: Column, alpha: float) -> Column:
    """The running exponential average of an ordered array: the first value starts it."""
    step = F.aggregate(
        values,
        F.array().cast("array<double>"),
        lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(alpha * x + (1 - alpha) * F.element_at(acc, -1)))),
    )
    return step


def exponential_average_by_row(df: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """The same for long series, as a scan: a missing value repeats the average and lets its weight fade."""
    return scans.exponential_average(df.select(*dict.fromkeys([key, order, value])), key, [order], value, alpha).select(key, order, "ema")


#: How a value between two known ones is made; p and n are the known values, f the share of the way.
FILLS = {
    "forward": lambda p, n, f: p, "backward": lambda p, n, f: n, "linear": lambda p, n, f: p + (n - p) * f,
    "zero": lambda p, n, f: F.lit(0.0), "mean": lambda p, n, f: (p + n) / 2, "skip": lambda p, n, f: F.lit(None).cast("double"),
}


def fill_gaps(df: DataFrame, series: str, epoch: str, value: str, step: int, how: str, constant: float = 0.0) -> DataFrame:
    """(series, epoch, value, filled): every gap of a series of multiples of `step` is filled; skip leaves gaps open."""
    fill = (lambda p, n, f: F.lit(constant)) if how == "constant" else FILLS[how]
    w = Window.partitionBy(series).orderBy(epoch)
    known = df.select(series, epoch, value, F.lead(epoch).over(w).alias("_next"), F.lead(value).over(w).alias("_next_value"))
    last = F.when(F.col("_next").isNotNull(), F.col("_next") - 1).otherwise(F.col(epoch))
    grid = known.select(series, F.explode(F.sequence(F.col(epoch), last, F.lit(step).cast("long"))).alias("_at"), epoch, value, "_next", "_next_value")
    share = (F.col("_at") - F.col(epoch)) / (F.col("_next") - F.col(epoch))
    filled = F.col("_at") != F.col(epoch)
    out = grid.select(series, F.col("_at").alias(epoch), F.when(filled, fill(F.col(value), F.col("_next_value"), share)).otherwise(F.col(value)).alias(value), filled.alias("filled"))
    return out.where(F.col(value).isNotNull()) if how == "skip" else out


def align(epoch: Column, step: int, how: str) -> Column:
    """The slot of a time: its start, end or centre, or the nearest multiple."""
    start = epoch - F.pmod(epoch, F.lit(step))
    return {"start": start, "end": start + step, "center": start + step // 2, "nearest": start + F.when(F.pmod(epoch, F.lit(step)) * 2 >= step, step).otherwise(0)}[how]


def detect_interval(df: DataFrame, series: str, epoch: str, samples: int = 100, tolerance: float = 0.1, share: float = 0.7) -> DataFrame:
    """The median of each series' last positive steps, if enough of them are close to it."""
    w = Window.partitionBy(series).orderBy(epoch)
    steps = df.select(series, epoch, (F.col(epoch) - F.lag(epoch).over(w)).alias("_d")).where("_d > 0")
    recent = steps.withColumn("_r", F.row_number().over(Window.partitionBy(series).orderBy(F.desc(epoch)))).where(F.col("_r") <= samples)
    lists = recent.groupBy(series).agg(F.array_sort(F.collect_list("_d")).alias("_s"))
    n = F.size("_s")
    middle = F.when(n % 2 == 1, F.element_at("_s", ((n + 1) / 2).cast("int"))).otherwise(F.floor((F.element_at("_s", F.greatest((n / 2).cast("int"), F.lit(1))) + F.element_at("_s", F.least((n / 2 + 1).cast("int"), n))) / 2))
    found = lists.withColumn("_m", middle.cast("long"))
    close = F.size(F.filter("_s", lambda d: F.abs(d - F.col("_m")) <= F.col("_m") * tolerance)) / n
    return found.select(series, n.alias("samples"), F.round(close, 6).alias("consistent"), F.when(close >= share, F.col("_m")).alias("interval"))


def bars(df: DataFrame, keys: Sequence[str], slot: Column, order: Sequence[str], value: str) -> DataFrame:
    """First, highest, lowest and last value, sum and count of each slot."""
    at = F.struct(*order)
    return df.groupBy(*keys, slot.alias("slot")).agg(F.min_by(value, at).alias("first"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("last"), F.sum(value).alias("total"), F.count("*").alias("n"))


def drop_outliers(df: DataFrame, series: str, order: str, value: str, threshold: float = 3.0, last: int = 100) -> DataFrame:
    """Rows whose z-score against the last kept values is over the threshold go; what is kept decides what follows."""

    def start():
        recent: deque = deque(maxlen=last)

        def step(x):
            x = math.nan if x is None else x
            odd = False
            if len(recent) >= 3:
                mean = sum(recent) / len(recent)
                sd = (sum((v - mean) ** 2 for v in recent) / len(recent)) ** 0.5
                odd = sd > 0 and abs(x - mean) / sd > threshold
            if not odd:
                recent.append(x)
            return not odd

        return step

    return walk_filter(df, series, [order], value, start)
