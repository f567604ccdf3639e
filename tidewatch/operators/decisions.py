"""Insights from metric tables and the decisions that follow from them, as rules over aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .walks import walk

SEVERITY = {"info": 0, "warning": 1, "error": 2, "critical": 3}


def insights(summary: DataFrame, scope: str, rules: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """One row per scope and rule whose severity is not null: rules are (title, severity, value)."""
    rows = F.array(*[F.struct(F.lit(t).alias("title"), s.alias("severity"), v.cast("double").alias("value")) for t, s, v in rules])
    out = summary.select(scope, F.explode(F.filter(rows, lambda r: r["severity"].isNotNull())).alias("_i")).select(scope, "_i.*")
    level = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    return out.withColumn("level", level[F.col("severity")])


def performance_rules(base_p95: Column | None = None) -> list[tuple[str, Column, Column]]:
    c = F.col
    rules = [
        ("high latency", F.when(c("p95") > 5000, "critical").when(c("p95") > 1000, "warning"), c("p95")),
        ("low throughput", F.when((c("rps") > 0) & (c("rps") < 1), "info"), c("rps")),
        ("low success rate", F.when(c("success") < 0.9, "error").when(c("success") < 0.95, "warning"), c("success")),
    ]
    if base_p95 is not None:
        change = (c("p95") - base_p95) / base_p95
        rules.append(("latency regression", F.when(change > 0.5, "critical").when(change > 0.2, "warning"), change))
    return rules


def rate_limit_factor(error_rate: Column, cost_ratio: Column, volatility: Column) -> Column:
    """How a limit should change: errors, cost against budget and volatile traffic, at most a fifth either way."""
    errors = F.when(error_rate > 0.1, 0.7).when(error_rate > 0.05, 0.85).when(error_rate > 0.02, 0.95).otherwise(1.1)
    cost = F.when(cost_ratio > 1.0, 0.8).when(cost_ratio > 0.8, 0.9).otherwise(1.15)
    return F.least(F.lit(1.2), F.greatest(F.lit(0.8), errors * cost * F.when(volatility > 0.5, 1.05).otherwise(1.0)))


def batch_size(per_minute: Column, timeout_s: float, most_latency_ms: Column, process_ms: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.floor(per_minute / 60 * timeout_s), F.floor(most_latency_ms / process_ms), F.lit(high)))


def caching_clusters(requests: DataFrame, fingerprint: Sequence[str], tokens: str, band: int) -> DataFrame:
    """Groups of like requests with the hit rate and the tokens that a cache would save.

    Requests of one fingerprint and token band are alike; the group's spread of tokens stands for similarity.
    """
    groups = requests.groupBy(*fingerprint, F.floor(F.col(tokens) / band).alias("band")).agg(F.count("*").alias("n"), F.avg(tokens).alias("_m"), F.stddev_pop(tokens).alias("_s"), F.sum(tokens).alias("_t"))
    similarity = 0.8 + F.when(F.col("_s") / F.col("_m") < 0.1, 0.2).when(F.col("_s") / F.col("_m") < 0.3, 0.1).otherwise(0.0)
    hit = F.least(F.lit(95.0), 50 * similarity + 30 * F.least(F.col("n") / 100, F.lit(1.0)) + 20 * F.least(F.col("n") / 10, F.lit(1.0)))
    return groups.select(*fingerprint, "band", "n", similarity.alias("similarity"), hit.alias("hit_rate"), (F.col("_t") * (1 - 1 / F.col("n"))).alias("tokens_saved"))


def phrase_savings(docs: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """Per phrase: texts that hold it, occurrences, and the words that its replacement would save."""
    low = F.lower(F.col(text))
    found = [(r.phrase, r.words_saved) for r in phrases.collect()]  # a small fixed dimension
    counts = docs.agg(*[F.sum(((F.length(low) - F.length(F.replace(low, F.lit(p)))) / len(p)).cast("long")).alias(f"_n{i}") for i, (p, _) in enumerate(found)], *[F.count(F.when(F.contains(low, F.lit(p)), 1)).alias(f"_d{i}") for i, (p, _) in enumerate(found)])
    rows = F.array(*[F.struct(F.lit(p).alias("phrase"), F.coalesce(F.col(f"_n{i}"), F.lit(0)).alias("occurrences"), F.col(f"_d{i}").alias("texts"), (F.coalesce(F.col(f"_n{i}"), F.lit(0)) * w).alias("words_saved")) for i, (p, w) in enumerate(found)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


#: Words that a phrase of a phrase table has at most.
PHRASE_WORDS = 8


def phrase_counts(docs: DataFrame, text: str, phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """(phrase, occurrences, texts) for a table of phrases of any size: whole words, each place counted, case ignored.

    A phrase is a run of 1 to PHRASE_WORDS words (letters and digits). Texts are counted by their runs of those lengths
    that some phrase has; runs are added up by text and then over texts before they meet the table in a join.
    """
    words = lambda column: F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}\p{N}]+)"), 1)
    wanted = phrases.where(F.col(phrase).isNotNull()).select(phrase, words(F.col(phrase)).alias("_w")).select(phrase, F.array_join("_w", " ").alias("_run"), F.size("_w").alias("_n"))
    wanted = wanted.where(F.col("_n").between(1, PHRASE_WORDS)).distinct()
    lengths = wanted.agg(F.sort_array(F.collect_set("_n")).alias("_lengths"))  # PHRASE_WORDS at most
    split = docs.select(words(F.col(text)).alias("_w")).crossJoin(F.broadcast(lengths))
    places = lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("_w"), F.lit(1))), lambda i: i + n - 1 <= F.size("_w")), lambda i: F.array_join(F.slice("_w", i, n), " "))
    runs = split.select(F.flatten(F.transform("_lengths", places)).alias("_runs")).withColumn("_key", F.monotonically_increasing_id())
    one = runs.select("_key", F.explode("_runs").alias("_run"))
    each = one.join(wanted.select("_run").distinct(), "_run", "left_semi").groupBy("_key", "_run").agg(F.count("*").alias("_c"))
    total = each.groupBy("_run").agg(F.sum("_c").alias("_o"), F.count("*").alias("_t"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return wanted.join(total, "_run", "left").select(phrase, zero("_o").alias("occurrences"), zero("_t").alias("texts"))


def merge_decisions(proposals: DataFrame, cycle: str, most: int = 3) -> DataFrame:
    """Per cycle the first `most` enabled proposals by priority, then without those in conflict with a better one.

    Two of one type are in conflict, and a model switch is with a prompt change; the cut comes before the conflicts.
    """
    best = proposals.where("enabled").withColumn("_r", F.row_number().over(Window.partitionBy(cycle).orderBy(F.desc("priority"), "id"))).where(F.col("_r") <= most)
    lists = best.groupBy(cycle).agg(F.array_sort(F.collect_list(F.struct("_r", "id", "type"))).alias("_l"))  # `most` items
    opposed = lambda a, b: (a == b) | ((a == "model_switch") & (b == "optimize_prompt")) | ((a == "optimize_prompt") & (b == "model_switch"))
    kept = F.aggregate("_l", F.filter("_l", lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda y: opposed(y["type"], x["type"])), acc).otherwise(F.concat(acc, F.array(x))))
    return lists.select(cycle, F.explode(kept).alias("d")).select(cycle, "d.id", "d.type", F.col("d._r").alias("place"))


def token_bucket(df: DataFrame, source: str, epoch: str, order: str, rate: float, burst: float) -> DataFrame:
    """Which requests a token bucket would let pass: what is left depends on every request before, so sources are walked."""

    def start():
        level, at = burst, None

        def step(t):
            nonlocal level, at
            t = math.nan if t is None else t
            level = burst if at is None else min(burst, level + (t - at) * rate)
            at = t
            passed = level >= 1
            level -= passed
            return passed

        return step

    return walk(df, source, [epoch, order], epoch, start, [source, order], "passed boolean")


def budget_walk(df: DataFrame, keys: Sequence[str], order: str, cost: str, limit: float, per_request: float) -> DataFrame:
    """Accept, downgrade or reject each request of a budget: what was rejected is not spent."""
    kinds = dict(df.dtypes)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        spent, actions = 0.0, []
        for x in pdf[cost].tolist():
            action = "reject" if x > per_request or spent + x / 2 > limit else "downgrade" if spent + x > limit else "accept"
            spent += {"reject": 0.0, "downgrade": x / 2, "accept": x}[action]
            actions.append(action)
        return pdf.assign(action=actions)[[*keys, order, "action"]]

    return df.select(*keys, order, cost).groupBy(*keys).applyInPandas(walk, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{order} {kinds[order]}", "action string"]))


def traffic_volatility(daily: DataFrame, key: str, day: str, rate: str, alpha: float) -> DataFrame:
    """(key, day, mean_rate, volatility, peak_rate): averages that start at 0, and the highest rate so far.

    Volatility is the exponential average of the rate's deviation from its own, relative to that but to no less than 1.
    """
    mean = scans.exponential_average(daily.select(key, day, rate), key, [day], rate, alpha, "mean_rate", first=alpha, keep_block=True)
    off = F.abs(F.col(rate) - F.col("mean_rate")) / F.greatest(F.col("mean_rate"), F.lit(1.0))
    both = scans.exponential_average(mean.withColumn("_off", off), key, [day], "_off", alpha, "volatility", first=alpha)
    by_day = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)  # a row a key and day
    return both.select(key, day, "mean_rate", "volatility", F.max(rate).over(by_day).alias("peak_rate"))


def cost_insights(daily: DataFrame, key: str, day: str, cost: str, alpha: float = 0.2, warning: float = 0.5, critical: float = 1.0, above: float = 1.1, window: int = 5, least: int = 10, z: float = 3.0) -> DataFrame:
    """Daily costs with spike (growth over the day before), ema, above_mean (ema over the mean so far) and odd (z-score)."""
    x = F.col(cost)
    rows = scans.exponential_average(daily.select(key, day, cost), key, [day], cost, alpha)
    by_day = Window.partitionBy(key).orderBy(day)  # a row a key and day
    before, so_far = by_day.rowsBetween(-window, -1), by_day.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_last": F.lag(cost).over(by_day), "_m": F.avg(cost).over(before), "_d": F.stddev_pop(cost).over(before), "_n": F.count("*").over(so_far), "_mean": F.avg(cost).over(so_far)})
    growth = F.when(F.col("_last") > 0, (x - F.col("_last")) / F.col("_last"))
    spike = F.when(growth > critical, "critical").when(growth > warning, "warning")
    odd = (F.col("_n") > least) & (F.col("_d") > 1e-12) & ((x - F.col("_m")) / F.col("_d") > z)
    return rows.select(key, day, cost, spike.alias("spike"), "ema", (F.col("ema") > above * F.col("_mean")).alias("above_mean"), odd.alias("odd"))


@dataclass(frozen=True)
class SwitchLimits:
    """Weights of cost, latency and quality, and what a switch must keep to; None is not checked.

    Costs count up to `cost_range` and latencies up to `latency_range`; quality goes to `quality_range`.
    """

    cost_weight: float = 0.4
    latency_weight: float = 0.3
    quality_weight: float = 0.3
    cost_range: float = 100.0
    latency_range: float = 5000.0
    quality_range: float = 5.0
    most_cost_pct: float = 10.0
    most_latency_ms: float | None = None
    least_quality: float | None = None
    least_period_s: int = 3600
    full_sample: int = 1000


def model_score(limits: SwitchLimits) -> Column:
    below = lambda x, most: (most - F.least(F.col(x), F.lit(most))) / most
    return limits.cost_weight * below("cost", limits.cost_range) + limits.latency_weight * below("latency", limits.latency_range) + limits.quality_weight * (F.col("quality") / limits.quality_range)


def model_switches(points: DataFrame, current: DataFrame, scope: str, now: int, limits: SwitchLimits = SwitchLimits()) -> DataFrame:
    """A row for each scope of `current`: the model in use, the best one, what a switch changes, the checks that fail, and the decision.

    `points` has (scope, model, n, success, cost, latency, quality), `current` (scope, model, evaluated_at), one row a scope;
    evaluated_at is null if there was none. The best model has the highest score; of equal ones the cheapest, then the
    fastest, then the one of best quality. As a model that another one beats scores no more than it and comes behind it
    among equals, the best is on the frontier, and one aggregate finds it. The decision is `keep` (best already, or nothing is
    known of the scope or its model), `blocked` (a check fails) or `switch`. A cost that rises from zero fails its check.
    """
    if min(limits.cost_weight, limits.latency_weight, limits.quality_weight) < 0:
        raise ValueError("weights are zero at least")
    values = F.struct("model", "n", "success", "cost", "latency", "quality", model_score(limits).alias("score"))
    place = F.struct(model_score(limits).alias("score"), (-F.col("cost")).alias("cost"), (-F.col("latency")).alias("latency"), "quality", "model")
    best = points.groupBy(scope).agg(F.max_by(values, place).alias("_best"))
    used = points.select(F.col(scope).alias("_scope"), F.col("model").alias("_model"), F.struct("cost", "latency", "quality", "n").alias("_now"))
    known = current.join(used, F.col(scope).eqNullSafe(F.col("_scope")) & F.col("model").eqNullSafe(F.col("_model")), "left").drop("_scope", "_model")
    rows = known.join(best.withColumnRenamed(scope, "_scope"), F.col(scope).eqNullSafe(F.col("_scope")), "left").drop("_scope")
    b, a = (lambda x: F.col(f"_best.{x}")), (lambda x: F.col(f"_now.{x}"))
    cost = b("cost") - a("cost")
    dear = F.when(a("cost") == 0, cost > 0).otherwise(cost / a("cost") * 100 > limits.most_cost_pct)
    checks = [("cost", dear)]
    if limits.most_latency_ms is not None:
        checks.append(("latency", b("latency") - a("latency") > limits.most_latency_ms))
    if limits.least_quality is not None:
        checks.append(("quality", b("quality") < limits.least_quality))
    checks.append(("period", now - F.col("evaluated_at") < limits.least_period_s))
    failed = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in checks]))
    same = F.col("_best").isNull() | F.col("_now").isNull() | (b("model") == F.col("model"))
    confidence = F.least(F.lit(1.0), 0.5 * F.least(b("n") / limits.full_sample, F.lit(1.0)) + 0.5 * b("success"))
    return rows.select(
        scope, "model", b("model").alias("best"), b("score").alias("score"), cost.alias("cost_change"), (cost * a("n")).alias("cost_change_all"), (b("latency") - a("latency")).alias("latency_change"), (b("quality") - a("quality")).alias("quality_change"),
        failed.alias("failed"), confidence.alias("confidence"), F.when(same, "keep").when(F.size(failed) > 0, "blocked").otherwise("switch").alias("decision"),
    )
