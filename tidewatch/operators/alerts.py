"""Anomalies that are confirmed, thresholds that are watched, and the life of an alert from pending to resolved.

Levels are 1 (warning), 2 (error) and 3 (critical); null is none. No task holds a key of raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import anomaly, ordered, scans

LEVELS = {"warning": 1, "error": 2, "critical": 3}
#: Doubles that are closer than this are equal to a threshold.
EPSILON = 2.0**-52
#: A variance under this part of the squared mean is rounding, and counts as none.
ROUNDING = 1e-24


def meets(actual: Column, operator: str, limit: Column | float) -> Column:
    """Whether a value meets a condition: > >= < <= = !=."""
    kinds = {">": actual > limit, ">=": actual >= limit, "<": actual < limit, "<=": actual <= limit, "=": F.abs(actual - limit) < EPSILON, "!=": F.abs(actual - limit) >= EPSILON}
    if operator not in kinds:
        raise ValueError(f"operator {operator!r}")
    return kinds[operator]


def level_above(x: Column, warning: float, error: float, critical: float) -> Column:
    """1, 2 or 3 as x is above the limits, else null."""
    return F.when(x > critical, 3).when(x > error, 2).when(x > warning, 1)


def confidence(z: Column, run: Column, consecutive: int) -> Column:
    """Of an anomaly with that score, the run-th in a row."""
    return F.greatest(F.lit(0.6), F.least(F.lit(1.0), F.abs(z) / 5)) * F.greatest(F.lit(0.7), F.least(F.lit(1.0), run / (consecutive + 2.0)))


def confirmed_outliers(df: DataFrame, key: str, order: Sequence[str], value: str, window: int = 1000, threshold: float = 3.0, least: int = 30, consecutive: int = 2, error: float = 4.0, critical: float = 5.0) -> DataFrame:
    """Add z, run, level and confidence to rows that have a value; the others are left out.

    z is the distance from the mean of the last `window` values, the row's own included, in sample deviations, and 0 where
    they do not vary. A row is an outlier if there are `least` values at least and |z| is above the threshold; run counts
    the outliers in a row up to it, and level is set from the `consecutive`-th on. Rows are cut into chunks of `window`; a
    window is the end of one chunk and the beginning of the next, so it is put together from two running moments: a row
    costs the same whatever the window, and nothing is subtracted, so that a huge value leaves no trace behind its window.
    """
    x = F.col(value).cast("double")

    def moments(v: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many, their mean and their squares about it, from the first of each row of the matrix on; what is not there comes first or last."""
        n = np.cumsum(there, axis=1)
        mean = np.cumsum(v, axis=1) / np.maximum(n, 1)
        before = np.concatenate([np.zeros((len(v), 1)), mean[:, :-1]], axis=1)
        return n, mean, np.cumsum(np.where(there & (n > 1), (v - before) * (v - mean), 0.0), axis=1)

    def scored(table: pa.Table) -> pa.Table:
        """Rows of a frame in order with their z and whether they are outliers."""
        table = table.sort_by("_rn")
        v, place = table.column("_v").to_numpy(), table.column("_rn").to_numpy() - 1
        start = place[0] // window
        at = place - start * window
        cells = np.zeros((at[-1] // window + 1) * window)
        there = np.zeros(len(cells), bool)
        cells[at], there[at] = v, True
        cells, there = cells.reshape(-1, window), there.reshape(-1, window)
        to_n, to_m, to_q = (c.ravel()[at] for c in moments(cells, there))
        ends = [np.concatenate([np.zeros(window), c[:, ::-1].ravel()])[at + 1] for c in moments(cells[:, ::-1], there[:, ::-1])]
        from_n, from_m, from_q = (np.where((at + 1) % window > 0, c, 0.0) for c in ends)  # else the window is the row's own chunk
        n = to_n + from_n
        apart = np.where(from_n > 0, from_m - to_m, 0.0)
        mean = to_m + apart * from_n / n
        variance = (to_q + from_q + apart * apart * to_n * from_n / n) / np.maximum(n - 1, 1)
        varies = (n > 1) & (variance > ROUNDING * mean * mean)
        z = np.where(varies, (v - mean) / np.sqrt(np.where(varies, variance, 1.0)), 0.0)
        return pa.table([*(table.column(c) for c in kept), pa.array(z), pa.array((n >= least) & (np.abs(z) > threshold))], names=[*kept, "z", "_out"])

    known = df.where(F.col(value).isNotNull() & ~F.isnan(x)).withColumn("_v", x)
    kept = [*df.columns, "_rn", "_context"]
    types = dict(df.dtypes) | {"_rn": "bigint", "_context": "boolean"}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "z double", "_out boolean"])
    rows = ordered.over_frames(known, key, order, window, lambda dealt, w: dealt.groupBy(key, "_frame").applyInArrow(scored, schema).withColumn("_place", F.col("_rn")))
    blocked = rows.withColumn("_block", F.floor((F.col("_place") - 1) / ordered.FRAME_ROWS))  # places are known: no cuts to look for
    placed = ordered.running(blocked, key, ["_place"], [("_calm", "last", F.when(~F.col("_out"), F.col("_place")))])
    run = F.col("_place") - F.coalesce("_calm", F.lit(0))
    level = F.when(run >= consecutive, F.coalesce(level_above(F.abs("z"), threshold, error, critical), F.lit(1)))
    return placed.select(*df.columns, "z", run.alias("run"), level.alias("level"), F.when(level.isNotNull(), confidence(F.col("z"), run, consecutive)).alias("confidence"))


def volume_anomalies(df: DataFrame, key: str, epoch: str, seconds: int = 60, back: int = 30, warning: float = 0.5, error: float = 0.75, critical: float = 1.0) -> DataFrame:
    """(key, slot, n, change, level) of slots whose number of rows is off the mean of the `back` slots before by a part over `warning`.

    Slots without rows are not there, and the first slot of a key has no mean.
    """
    slots = df.groupBy(key, F.floor(F.col(epoch) / seconds).alias("slot")).agg(F.count("*").alias("n"))
    framed = ordered.over_frames(slots, key, ["slot"], back + 1, lambda rows, w: rows.withColumn("_base", (F.sum("n").over(w) - F.col("n")) / F.when(F.count("*").over(w) > 1, F.count("*").over(w) - 1)))
    change = (F.col("n") - F.col("_base")) / F.col("_base")
    return framed.select(key, "slot", "n", change.alias("change"), level_above(F.abs(change), warning, error, critical).alias("level")).where(F.col("level").isNotNull())


def collective_anomalies(records: DataFrame, key: str, epoch: str, level: str, within: int = 300, least: int = 3) -> DataFrame:
    """(key, epoch, n, level, confidence): records with `least` of their key in the last `within` seconds, themselves and those of the same second included.

    level is the highest of them.
    """
    seen = ordered.range_points(records.select(key, epoch, level), key, epoch, within, {"n": ("count", F.lit(1)), "_top": ("max", F.col(level))})
    each = seen.where(F.col("n") >= least).withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))  # records of one second have the same
    return each.select(F.col("_point.k").alias(key), F.col("_point.t").alias(epoch), "n", F.col("_top").alias(level), F.lit(0.85).alias("confidence"))


@dataclass(frozen=True)
class Limits:
    """What a metric is watched for; the detectors' own parameters are those of `threshold_alerts`."""

    low: float | None = None
    high: float | None = None
    warning_low: float | None = None
    warning_high: float | None = None
    drift: str | None = "adwin"
    z: float | None = 3.0


def quality_limits() -> Limits:
    return Limits(low=0.5, high=1.0, warning_low=0.7, z=2.5)


def cost_limits(most: float) -> Limits:
    return Limits(low=0.0, high=most, warning_high=0.8 * most, drift="page_hinkley")


def latency_limits(most: float) -> Limits:
    return Limits(low=0.0, high=most, warning_high=0.8 * most, drift="cusum", z=2.5)


def threshold_alerts(df: DataFrame, key: str, order: Sequence[str], value: str, limits: Limits, window: int = 50, adwin: tuple = (0.002, 100), page_hinkley: tuple = (10.0, 0.005), cusum: tuple = (0.5, 0.1, 5.0)) -> DataFrame:
    """(key, *order, value, kind, level): a row for each alert of a row: threshold (critical, or a warning where none is critical), drift and anomaly.

    Detector parameters are adwin's delta and window, page_hinkley's threshold and alpha, cusum's target, slack and threshold. Rows without a value are left out.
    """
    columns = list(dict.fromkeys([key, *order, value]))
    rows = ordered.numbered(df.select(*columns).where(F.col(value).isNotNull()), key, order)  # once for all detectors
    x = F.col(value)
    drift = anomalous = F.lit(None).cast("int")
    if limits.drift == "adwin":
        rows = anomaly.adwin(rows, key, order, value, *adwin)
    elif limits.drift == "page_hinkley":
        rows = anomaly.page_hinkley(rows, key, order, value, *page_hinkley).drop("score")
    elif limits.drift == "cusum":
        rows = anomaly.cusum(rows, key, order, value, *cusum).withColumn("is_drift", F.col("direction").isNotNull()).drop("high", "low", "direction")
    elif limits.drift is not None:
        raise ValueError(f"no drift detector {limits.drift!r}")
    if limits.drift:
        rows = rows.withColumnsRenamed({"is_drift": "_drift", "is_warning": "_drift_warning"})
        drift = F.when(F.col("_drift"), 3).when(F.col("_drift_warning"), 1)
    if limits.z is not None:
        rows = anomaly.rolling_z(rows, key, order, value, window, limits.z)
        anomalous = F.when(F.col("is_anomaly"), F.when(F.col("severity") > 0.7, 3).otherwise(1))
    beyond = lambda low, high: F.coalesce(x < low, F.lit(False)) | F.coalesce(x > high, F.lit(False))
    number = lambda v: F.lit(v).cast("double")
    hard = beyond(number(limits.low), number(limits.high))
    threshold = F.when(hard, 3).when(beyond(number(limits.warning_low), number(limits.warning_high)), 1)
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), level.alias("level")) for k, level in (("threshold", threshold), ("drift", drift), ("anomaly", anomalous))]), lambda a: a["level"].isNotNull())
    return rows.select(*columns, F.explode(found).alias("_a")).select(*columns, "_a.*")


@dataclass(frozen=True)
class Rule:
    """An alert rule: it fires once `value operator limit` has held for `hold_s` seconds."""

    name: str
    value: Column
    operator: str
    limit: float
    hold_s: int
    level: int


def rule_samples(slots: DataFrame, scope: str, epoch: str, rules: Sequence[Rule]) -> DataFrame:
    """(scope, epoch, rule, value, firing, hold_s, level): every rule at every slot; a value that is null does not fire."""
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), r.value.cast("double").alias("value"), F.coalesce(meets(r.value.cast("double"), r.operator, r.limit), F.lit(False)).alias("firing"), F.lit(r.hold_s).alias("hold_s"), F.lit(r.level).alias("level")) for r in rules])
    return slots.select(scope, epoch, F.explode(each).alias("_r")).select(scope, epoch, "_r.*")


def alert_spans(samples: DataFrame, scope: str, epoch: str) -> DataFrame:
    """(scope, rule, level, hold_s, started, last_met, ended, n): stretches of samples of a rule and scope that fire one after another.

    `ended` is the time of the sample after the last one, which does not fire, and null while there is none. Samples of a
    rule and scope have one time each. A sample that does not fire closes one stretch and opens the next: both are one
    aggregate over the number of such samples before, which is split over many tasks.
    """
    rows = samples.withColumn("_key", F.struct(F.col(scope).alias("scope"), F.col("rule").alias("rule")))
    calm = ~F.col("firing")
    rows = ordered.running(ordered.in_blocks(rows, epoch), "_key", [epoch], [("_run", "count", F.when(calm, 1))])
    parts = rows.withColumn("_to", F.explode(F.when(calm, F.array("_run", F.col("_run") - 1)).otherwise(F.array("_run"))))
    ends = F.when(calm & (F.col("_to") < F.col("_run")), F.col(epoch))
    at = F.when(F.col("firing"), F.col(epoch))
    spans = parts.groupBy("_key", "_to").agg(F.max("level").alias("level"), F.max("hold_s").alias("hold_s"), F.min(at).alias("started"), F.max(at).alias("last_met"), F.min(ends).alias("ended"), F.count(at).alias("n")).where("n > 0")
    return spans.select(F.col("_key.scope").alias(scope), F.col("_key.rule").alias("rule"), "level", "hold_s", "started", "last_met", "ended", "n")


def alert_states(spans: DataFrame, scope: str, now: int, silences: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """Add fired_at and state at the time `now` to spans: pending, firing, acknowledged, silenced or resolved.

    A span fires at started + hold_s if it is met that long; one that ends before is dropped, as it never fired.
    `silences` has (rule, scope, starts, ends), `acknowledgements` (rule, scope, at); null in rule or scope stands for all.
    A silence holds from starts to before ends; an acknowledgement counts from fired_at to `now`. Resolved goes before
    silenced, and silenced before acknowledged. Spans that start after `now` are left out.
    """
    over = F.col("ended").isNotNull() & (F.col("ended") <= now)
    until = F.when(over, F.col("last_met")).otherwise(F.least(F.col("last_met"), F.lit(now)))
    fired = F.when(until - F.col("started") >= F.col("hold_s"), F.col("started") + F.col("hold_s"))
    known = spans.where(F.col("started") <= now).withColumn("fired_at", fired).where(F.col("fired_at").isNotNull() | ~over)
    open_spans = known.where(~over & F.col("fired_at").isNotNull()).select(F.col(scope).alias("_scope"), F.col("rule").alias("_rule"), "started", "fired_at")

    def touched(marks: DataFrame, holds: Column, name: str) -> DataFrame:
        """Open spans that one of the marks is about, found by an equi join for each way in which a mark may be general."""
        m = marks.withColumnsRenamed({"rule": "_m_rule", scope: "_m_scope"})
        found = None
        for by_rule in (True, False):
            for by_scope in (True, False):
                some = m.where((F.col("_m_rule").isNotNull() if by_rule else F.col("_m_rule").isNull()) & (F.col("_m_scope").isNotNull() if by_scope else F.col("_m_scope").isNull()))
                on = holds
                on = on & (F.col("_m_rule") == F.col("_rule")) if by_rule else on
                on = on & (F.col("_m_scope") == F.col("_scope")) if by_scope else on
                if not by_rule and not by_scope:  # general marks: all that matters of them is one row
                    some = some.agg(F.max("at").alias("at")) if name == "_acked" else some.where((F.col("starts") <= now) & (F.lit(now) < F.col("ends"))).limit(1)
                    some = F.broadcast(some)
                part = open_spans.join(some, on, "left_semi").select("_scope", "_rule", "started")
                found = part if found is None else found.unionByName(part)
        return found.distinct().withColumn(name, F.lit(True)).withColumnRenamed("started", "_started")

    def with_flag(rows: DataFrame, flags: DataFrame, name: str) -> DataFrame:
        same = F.col(scope).eqNullSafe(F.col("_scope")) & (F.col("rule") == F.col("_rule")) & (F.col("started") == F.col("_started"))
        return rows.join(flags, same, "left").drop("_scope", "_rule", "_started")

    quiet = touched(silences, (F.col("starts") <= now) & (F.lit(now) < F.col("ends")), "_silenced")
    acked = touched(acknowledgements.where(F.col("at") <= now), F.col("at") >= F.col("fired_at"), "_acked")
    rows = with_flag(with_flag(known, quiet, "_silenced"), acked, "_acked")
    state = F.when(over, "resolved").when(F.col("fired_at").isNull(), "pending").when(F.col("_silenced"), "silenced").when(F.col("_acked"), "acknowledged").otherwise("firing")
    return rows.withColumn("state", state).drop("_silenced", "_acked")


def performance_summary(df: DataFrame, key: str, order: Sequence[str], epoch: str, latency: str, success: str, alpha: float = 0.3) -> DataFrame:
    """A row a key: n, p50, p90, p95, p99, p999, rps (rows a second from the first to the last), success (part) and ema, the last exponential average of the latency.

    rps is 0 where first and last are the same second.
    """
    shares = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    tails = ordered.percentiles(df, [key], latency, shares)
    span = F.max(epoch) - F.min(epoch)
    sums = df.groupBy(key).agg(F.count("*").alias("n"), F.when(span > 0, F.count("*") / span).otherwise(0.0).alias("rps"), F.avg(F.col(success).cast("double")).alias("success"))
    averaged = scans.exponential_average(df.select(*dict.fromkeys([key, *order, latency])), key, order, latency, alpha)
    last = averaged.groupBy(key).agg(F.max_by("ema", F.struct(*order)).alias("ema"))
    return sums.join(tails, key).join(last, key)
