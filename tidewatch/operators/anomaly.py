"""Anomaly and drift detectors over ordered rows of a key, as frames and array expressions.

Frames hold at most MOST_FRAME rows where an array is built of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import two_sided_p
from . import ordered

MOST_FRAME = 1000


def checked(n: int) -> int:
    if n > MOST_FRAME:
        raise ValueError(f"a frame of over {MOST_FRAME} rows")
    return n


def rolling_z(df: DataFrame, key: str, order: Sequence[str], value: str, window: int, threshold: float) -> DataFrame:
    """Distance from the mean of the last rows, the current one included, in population deviations."""

    def add(rows: DataFrame, w) -> DataFrame:
        sd, n = F.stddev_pop(value).over(w), F.count(value).over(w)
        return rows.withColumn("score", F.when((n >= 3) & (sd > 0), F.abs(F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0))

    scored = ordered.over_frames(df, key, order, window, add)
    return scored.withColumn("is_anomaly", F.col("score") > threshold).withColumn("severity", F.when(F.col("is_anomaly"), F.least(F.lit(1.0), F.col("score") / threshold - 1)).otherwise(0.0))


def expanding_z(df: DataFrame, key: str, order: Sequence[str], value: str, threshold: float) -> DataFrame:
    """Against all rows before, in sample deviations."""
    x = F.col(value)
    sums = [("_n", "count", x, True), ("_s", "sum", x, True), ("_q", "sum", x * x, True)]
    rows = ordered.running(ordered.in_blocks(df, order[0]), key, order, sums)
    mean = F.col("_s") / F.col("_n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") - F.col("_s") * mean) / F.when(F.col("_n") > 1, F.col("_n") - 1))
    rows = rows.withColumn("score", F.when(sd > 0, (x - mean) / sd))
    return rows.withColumn("is_anomaly", F.coalesce(F.abs("score") > threshold, F.lit(False))).drop("_n", "_s", "_q", "_block")


def rolling_iqr(df: DataFrame, key: str, order: Sequence[str], value: str, window: int, k: float) -> DataFrame:
    """Outside k interquartile ranges of the quartiles of the last rows."""
    x = F.col(value)
    quartiles = lambda rows, w: rows.withColumn("_q1", F.percentile(value, 0.25).over(w)).withColumn("_q3", F.percentile(value, 0.75).over(w)).withColumn("_n", F.count(value).over(w))
    df = ordered.over_frames(df, key, order, checked(window), quartiles)
    iqr = F.col("_q3") - F.col("_q1")
    low, high = F.col("_q1") - k * iqr, F.col("_q3") + k * iqr
    out = F.when(x < low, low - x).when(x > high, x - high)
    inside = F.least(F.lit(1.0), F.abs(x - (F.col("_q1") + F.col("_q3")) / 2) / F.greatest(iqr / 2, F.lit(0.001)))
    score = F.when(F.col("_n") < 4, 0.0).when(out.isNotNull(), out / F.greatest(iqr, F.lit(0.001))).otherwise(inside)
    return df.withColumn("score", score).withColumn("is_anomaly", (F.col("_n") >= 4) & out.isNotNull()).drop("_q1", "_q3", "_n")


def array_median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2


def rolling_mad(df: DataFrame, key: str, order: Sequence[str], value: str, window: int, threshold: float) -> DataFrame:
    """1.4826 times the distance from the median of the last rows, in median absolute deviations."""
    df = ordered.over_frames(df, key, order, checked(window), lambda rows, w: rows.withColumn("_v", F.collect_list(value).over(w)))
    df = df.withColumn("_m", array_median(F.col("_v")))
    mad = array_median(F.transform("_v", lambda x: F.abs(x - F.col("_m"))))
    score = F.when((F.size("_v") >= 3) & (F.col("_mad") > 0), 1.4826 * F.abs(F.col(value) - F.col("_m")) / F.col("_mad")).otherwise(0.0)
    return df.withColumn("_mad", mad).withColumn("score", score).withColumn("is_anomaly", F.col("score") > threshold).drop("_v", "_m", "_mad")


def rolling_mahalanobis(df: DataFrame, key: str, order: Sequence[str], dimensions: Sequence[str], window: int, threshold: float) -> DataFrame:
    """Squared distance from the mean of the last rows with a diagonal covariance."""

    def add(rows: DataFrame, w) -> DataFrame:
        total = F.lit(0.0)
        for d in dimensions:
            total = total + (F.col(d) - F.avg(d).over(w)) ** 2 / F.greatest(F.var_pop(d).over(w), F.lit(1e-4))
        return rows.withColumn("score", F.when(F.count("*").over(w) < len(dimensions) + 1, 0.0).otherwise(F.sqrt(total)))

    return ordered.over_frames(df, key, order, window, add).withColumn("is_anomaly", F.col("score") > threshold)


def page_hinkley(df: DataFrame, key: str, order: Sequence[str], value: str, threshold: float, alpha: float) -> DataFrame:
    """Cumulated excess over the first value, above its lowest point so far."""
    x = F.col(value)
    first = df.groupBy(F.struct(key).alias("_k")).agg(F.min_by(x, F.struct(*order)).alias("_ref"))  # a row a key
    rows = df.withColumn("_k", F.struct(key)).join(F.broadcast(first), "_k").drop("_k")
    rows = ordered.nested_sums(rows, key, order, {"_s": x - F.col("_ref") - alpha})
    rows = rows.withColumn("score", F.col("_s") - F.least(F.lit(0.0), F.col("_s_low")))
    rows = rows.withColumn("is_drift", F.col("score") > threshold).withColumn("is_warning", (F.col("score") > 0.7 * threshold) & ~F.col("is_drift"))
    return rows.select(*df.columns, "score", "is_drift", "is_warning")


def cusum(df: DataFrame, key: str, order: Sequence[str], value: str, target: float, slack: float, threshold: float) -> DataFrame:
    """Cumulated deviations to either side, each less half the slack a row and never below zero."""
    rows = ordered.nested_sums(df, key, order, {"_u": F.col(value) - target - slack / 2, "_d": target - F.col(value) - slack / 2})
    above = lambda side: F.col(f"_{side}") - F.least(F.lit(0.0), F.col(f"_{side}_low"))
    rows = rows.select(*df.columns, above("u").alias("high"), above("d").alias("low"))
    rows = rows.withColumn("is_warning", (F.greatest("high", "low") > 0.7 * threshold) & ~(F.greatest("high", "low") > threshold))
    return rows.withColumn("direction", F.when(F.col("high") > threshold, "up").when(F.col("low") > threshold, "down"))


def adwin(df: DataFrame, key: str, order: Sequence[str], value: str, delta: float, window: int = 100) -> DataFrame:
    """Whether some cut of the last rows, from a quarter to three quarters, parts them by more than its bound in mean or
    variance; a warning where the latest quarter is off the rest by one and a half deviations.

    Prefix sums are running values of a block of rows, and a frame's sums are their differences: a cut's test is constant
    in time and a frame carries one number a row.
    """
    x = F.col(value)

    def add(rows: DataFrame, w) -> DataFrame:
        whole = w.rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_s", F.sum(x).over(whole)).withColumn("_q", F.sum(x * x).over(whole))
        return rows.withColumn("_v", F.collect_list(F.struct(x.alias("x"), F.col("_s").alias("s"), F.col("_q").alias("q"))).over(w))

    df = ordered.over_frames(df, key, order, checked(window), add)
    n, v = F.size("_v"), F.col("_v")
    before_s, before_q = v[0]["s"] - v[0]["x"], v[0]["q"] - v[0]["x"] * v[0]["x"]
    all_s, all_q = F.element_at(v, -1)["s"] - before_s, F.element_at(v, -1)["q"] - before_q

    def sums(cut: Column) -> tuple[Column, Column]:
        return F.element_at(v, cut)["s"] - before_s, F.element_at(v, cut)["q"] - before_q

    def apart(cut: Column) -> Column:
        s, q = sums(cut)
        n1, n2 = cut.cast("double"), (n - cut).cast("double")
        m1, m2 = s / n1, (all_s - s) / n2
        v1, v2 = q / n1 - m1 * m1, (all_q - q) / n2 - m2 * m2
        bound = F.sqrt(F.ln(4 + F.ln(n.cast("double")) / delta) * (1 / n1 + 1 / n2) / 2)
        return (F.abs(m1 - m2) > bound) | (F.abs(v1 - v2) > bound)

    cuts = F.sequence(F.greatest(F.lit(1), F.floor(n / 4).cast("int")), F.greatest(F.lit(1), F.floor(3 * n / 4).cast("int")))
    older = F.greatest(F.lit(1), n - F.greatest(F.floor(n / 4), F.lit(5)).cast("int"))
    s, q = sums(older)
    mean, recent = s / older, (all_s - s) / (n - older)
    # equal values differ by rounding alone, which is no warning
    off = F.abs(recent - mean) > F.greatest(1e-9 * F.abs(mean), 1.5 * F.sqrt(F.greatest(F.lit(0.0), q / older - mean * mean)))
    df = df.withColumn("is_drift", F.when(n < 10, False).otherwise(F.exists(cuts, apart)))
    return df.withColumn("is_warning", F.when(n > 10, off & ~F.col("is_drift")).otherwise(False)).drop("_v", "_s", "_q")


def welch_drift(df: DataFrame, key: str, order: Sequence[str], value: str, window: int, alpha: float) -> DataFrame:
    """The last rows against a key's first rows: two-sided p of Welch's statistic under the normal law."""

    def add(rows: DataFrame, w) -> DataFrame:
        return rows.select("*", F.col("_rn").alias("_k"), F.avg(value).over(w).alias("_m1"), F.var_samp(value).over(w).alias("_v1"), F.count(value).over(w).alias("_n1"))

    numbered = ordered.numbered(df, key, order)
    first = numbered.where(F.col("_rn") <= window).groupBy(key).agg(F.avg(value).alias("_m0"), F.var_samp(value).alias("_v0"), F.count(value).alias("_n0"))
    joined = ordered.over_frames(df, key, order, window, add).where(F.col("_k") >= 2 * window).join(first, key)
    se = F.sqrt(F.col("_v0") / F.col("_n0") + F.col("_v1") / F.col("_n1"))
    p = F.when(se > 0, two_sided_p((F.col("_m1") - F.col("_m0")) / se)).otherwise(1.0)
    return joined.withColumn("p_value", p).withColumn("is_drift", F.col("p_value") < alpha).withColumn("is_warning", (F.col("p_value") < 2 * alpha) & ~F.col("is_drift")).drop("_k", "_m0", "_v0", "_n0", "_m1", "_v1", "_n1")


def group_outliers(df: DataFrame, key: str, value: str, z: float = 3.0, k: float = 1.5) -> DataFrame:
    """Rows marked against their whole group, by z-score and by quartiles."""
    quartiles = ordered.percentiles(df, [key], value, {"_q1": 0.25, "_q3": 0.75})
    stats = df.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s")).join(quartiles, key)
    x, iqr = F.col(value), F.col("_q3") - F.col("_q1")
    out = df.join(stats, key).withColumn("by_z", F.coalesce(F.abs(x - F.col("_m")) > z * F.col("_s"), F.lit(False))).withColumn("by_iqr", (x < F.col("_q1") - k * iqr) | (x > F.col("_q3") + k * iqr))
    return out.withColumn("kind", F.when(F.col("by_z") & (x > F.col("_m")), "spike").when(F.col("by_z"), "drop")).drop("_m", "_s", "_q1", "_q3")


def population_stability(base: DataFrame, current: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """PSI over equal bins of the base's range against equal shares; empty bins are skipped."""
    span = base.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    counts = current.crossJoin(F.broadcast(span)).where(F.col(value).between(F.col("_lo"), F.col("_hi"))).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    share = F.col("n") / F.col("_all")
    return counts.crossJoin(F.broadcast(total)).agg(F.sum((share - 1 / bins) * F.ln(share / (1 / bins))).alias("psi"))


def ks_statistic(df: DataFrame, key: str, group: Column, value: str) -> DataFrame:
    """Largest distance between the distributions of two groups (group true and false) of each key, and its p value.

    Rows are reduced to distinct values first; the running shares are frames over those.
    """
    counts = df.groupBy(key, value).agg(F.count(F.when(group, 1)).alias("_a"), F.count(F.when(~group, 1)).alias("_b"))
    up_to = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    shares = counts.select(key, (F.sum("_a").over(up_to) / F.sum("_a").over(whole)).alias("_fa"), (F.sum("_b").over(up_to) / F.sum("_b").over(whole)).alias("_fb"), F.sum("_a").over(whole).alias("_na"), F.sum("_b").over(whole).alias("_nb"))
    d = shares.groupBy(key).agg(F.max(F.abs(F.col("_fa") - F.col("_fb"))).alias("d"), F.max("_na").alias("_na"), F.max("_nb").alias("_nb"))
    x = F.col("d") * F.sqrt(F.col("_na") * F.col("_nb") / (F.col("_na") + F.col("_nb")))
    return d.select(key, "d", F.least(F.lit(1.0), 2 * F.exp(-2 * x * x)).alias("p_value"))


def islands(df: DataFrame, key: str, order: Sequence[str], flag: str) -> DataFrame:
    """Runs of rows with the flag set: first and last place in order, and their number."""
    w = Window.partitionBy(key).orderBy(*order)
    breaks = F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    at = order[0]
    return df.withColumn("_run", breaks).where(F.col(flag)).groupBy(key, "_run").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n")).drop("_run")
