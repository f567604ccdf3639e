"""Experiments, rewards, model selection and parameter search."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import Z_TWO_SIDED, normal_cdf, normal_quantile, two_sided_p
from . import scans


def two_proportions(table: DataFrame, confidence: float = 0.95, least: int = 1000) -> DataFrame:
    """One row of (n1, c1, n2, c2, ...) per test, with the pooled z-test, interval, effect size, power and winner."""
    p1, p2 = F.col("c1") / F.col("n1"), F.col("c2") / F.col("n2")
    pooled = (F.col("c1") + F.col("c2")) / (F.col("n1") + F.col("n2"))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n1") + 1 / F.col("n2")))
    apart = F.sqrt(p1 * (1 - p1) / F.col("n1") + p2 * (1 - p2) / F.col("n2"))
    zc, diff = Z_TWO_SIDED[confidence], p2 - p1
    out = table.withColumn("rate_1", p1).withColumn("rate_2", p2).withColumn("z", F.when(se > 0, diff / se).otherwise(0.0))
    out = out.withColumn("p_value", two_sided_p(F.col("z"))).withColumn("low", diff - zc * apart).withColumn("high", diff + zc * apart)
    out = out.withColumn("effect", 2 * (F.asin(F.sqrt(p2)) - F.asin(F.sqrt(p1)))).withColumn("power", normal_cdf(F.abs("z") - zc))
    winner = F.when((F.col("p_value") < 1 - confidence) & (F.col("n1") >= least) & (F.col("n2") >= least), F.when(diff > 0, "2").otherwise("1"))
    return out.withColumn("winner", winner)


def sample_size(base: Column, effect: Column, alpha: Column, power: Column) -> Column:
    """Rows each arm needs to see an absolute effect."""
    mean = (2 * base + effect) / 2
    return F.ceil((normal_quantile(1 - alpha / 2) + normal_quantile(power)) ** 2 * 2 * mean * (1 - mean) / (effect * effect))


def hash_below(unit: Column, n: int, salt: str = "") -> Column:
    """A number from 0 to n - 1 by the MD5 of the unit as text; other engines can repeat it."""
    return F.conv(F.substring(F.md5(F.concat(unit.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long") % n


def assigned(unit: Column, shares: Sequence[tuple[str, int]]) -> Column:
    """A variant by hash of the unit; shares are whole percents."""
    at, out, total = hash_below(unit, 100), None, 0
    for name, share in shares:
        total += share
        out = F.when(at < total, name) if out is None else out.when(at < total, name)
    return out


def reward(rating: Column, done: Column, retried: Column, dwell: Column, quality: Column, cost: Column, latency: Column, weights: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> Column:
    """Quality from explicit and implicit feedback, less cost and latency, lowered for poor or repeated answers."""
    implicit = 0.5 + F.when(done, 0.3).otherwise(0.0) - F.when(retried, 0.4).otherwise(0.0) + F.when(dwell.between(10, 120), 0.2).when(dwell < 3, -0.2).otherwise(0.0)
    implicit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), implicit))
    felt = F.when(rating.isNotNull(), (rating / 5 + implicit) / 2).otherwise(implicit)
    total = weights[0] * felt + weights[1] * (1 - F.least(F.lit(1.0), cost / 0.01)) + weights[2] * (1 - F.least(F.lit(1.0), latency / 5000))
    return total * F.when((quality < 0.3) | retried, 0.8).otherwise(1.0)


def beta_arms(outcomes: DataFrame, arm: str, success: str, width: float = 0.05) -> DataFrame:
    """Posterior of each arm with its interval, regret against the best rate, and whether it has converged."""
    arms = outcomes.groupBy(arm).agg(F.count("*").alias("n"), F.sum(F.col(success).cast("long")).alias("wins"))
    a, b = F.col("wins") + 1.0, F.col("n") - F.col("wins") + 1.0
    mean, sd = a / (a + b), F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    best = arms.agg(F.max(mean).alias("_best"))
    regret = (F.col("_best") - mean) * F.col("n")
    return arms.crossJoin(F.broadcast(best)).select(arm, "n", "wins", mean.alias("mean"), (mean - 1.96 * sd).alias("low"), (mean + 1.96 * sd).alias("high"), regret.alias("regret"), ((F.col("n") >= 100) & (regret / F.col("n") < width)).alias("converged"))


PRIME = (1 << 31) - 1


def uniform(*parts: Column | int) -> Column:
    """A number in (0, 1) from integers, by quadratic steps modulo 2**31 - 1 that SQL can repeat."""

    def stirred(x: Column, multiplier: int, add: int) -> Column:
        step = lambda y: F.pmod(y * y + y * multiplier + add, F.lit(PRIME))
        return F.get(F.transform(F.array(x), step), F.lit(0))  # x is worked out once

    x = F.lit(1).cast("long")
    for p in parts:
        seed = (F.lit(p) if isinstance(p, int) else p).cast("long")
        x = stirred(F.pmod(x * 48_271 + seed + 11, F.lit(PRIME)), 69_621, 5)
    for multiplier in (16_807, 39_373, 62_089_911):
        x = stirred(x, multiplier, 7)
    return (x + 1) / F.lit(float(PRIME + 1))


def normal_draw(*parts: Column | int) -> Column:
    """A standard normal number from two uniform ones (Box and Muller)."""
    return F.sqrt(-2 * F.ln(uniform(*parts, 1))) * F.cos(2 * math.pi * uniform(*parts, 2))


def _normals(keys: np.ndarray, *parts: np.ndarray | int) -> np.ndarray:
    """The numbers of normal_draw, for a batch of keys between the parts: `parts` begins with those before the key."""
    stirred = lambda x, multiplier, add: (x * x + x * multiplier + add) % PRIME

    def uniform_of(x: np.ndarray) -> np.ndarray:
        for multiplier in (16_807, 39_373, 62_089_911):
            x = stirred(x, multiplier, 7)
        return (x + 1) / float(PRIME + 1)

    x = np.ones(len(keys), np.int64)
    for p in parts:
        x = stirred((x * 48_271 + p + 11) % PRIME, 69_621, 5)
    one, two = (uniform_of(stirred((x * 48_271 + p + 11) % PRIME, 69_621, 5)) for p in (1, 2))
    return np.sqrt(-2 * np.log(one)) * np.cos(2 * math.pi * two)


def normal_draws(n: Column, seed: int, key: Column, tails: Sequence[tuple[int, ...]] = ((),)) -> Column:
    """An array of normal_draw(seed, key, i, *tail) for i from 1 to n and each tail, tail after tail for each i.

    A batch of rows is drawn at once: row by row the steps of one number cost a hundred times as much.
    """

    @F.arrow_udf("array<double>")
    def drawn(sizes: pa.Array, keys: pa.Array) -> pa.Array:
        counts, missing = sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), keys.is_null().to_numpy(zero_copy_only=False)
        k = keys.fill_null(0).to_numpy(zero_copy_only=False)
        columns = [_normals(k, seed, k, i, *tail) for i in range(1, int(counts.max(initial=0)) + 1) for tail in tails]
        values = np.stack(columns, axis=1) if columns else np.zeros((len(k), 0))
        taken = np.arange(values.shape[1]) < (counts * len(tails))[:, None]
        offsets = np.concatenate([[0], np.cumsum(counts * len(tails))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[taken], pa.float64(), mask=np.broadcast_to(missing[:, None], values.shape)[taken]))

    return drawn(n.cast("int"), key.cast("long"))


def gamma_of(shape: Column, normal: Column) -> Column:
    """A gamma number of shape 1 and more, as the cube of a normal one (Wilson and Hilferty), no less than a tiny bit."""
    root = 1 - 1 / (9 * shape) + normal / (3 * F.sqrt(shape))
    return shape * F.pow(F.greatest(root, F.lit(1e-6)), F.lit(3.0))


def beta_draw(a: Column, b: Column, *parts: Column | int) -> Column:
    """A beta number as the share of one gamma number in two."""
    x, y = gamma_of(a, normal_draw(*parts, 3)), gamma_of(b, normal_draw(*parts, 4))
    return x / (x + y)


def thompson_draw(arms: DataFrame, arm: str, seed: int) -> DataFrame:
    """Add one draw of each arm's posterior; a function of the seed and the arm's place in the order of names."""
    placed = arms.withColumn("_place", F.row_number().over(Window.orderBy(arm)))  # a row an arm
    return placed.withColumn("draw", beta_draw(F.col("wins") + 1.0, F.col("n") - F.col("wins") + 1.0, seed, F.col("_place"))).drop("_place")


def thompson_choice(rows: DataFrame, arms: DataFrame, arm: str, key: str, seed: int) -> DataFrame:
    """(key, choice, draw): for each row the arm whose posterior draw is the largest, the first by name if equal.

    Arms are a catalogue: a row each, gathered into one; Spark sends it along with a plan of its own choice.
    """
    listed = arms.agg(F.array_sort(F.collect_list(F.struct(F.col(arm).alias("arm"), "wins", "n"))).alias("_arms"))

    def draw(x: Column, i: Column) -> Column:
        won, lost = gamma_of(x["wins"] + 1.0, F.get("_z", 2 * i)), gamma_of(x["n"] - x["wins"] + 1.0, F.get("_z", 2 * i + 1))
        return F.struct((won / (won + lost)).alias("draw"), (-i).alias("place"), x["arm"].alias("arm"))

    drawn = rows.select(key).crossJoin(F.broadcast(listed)).withColumn("_z", normal_draws(F.size("_arms"), seed, F.col(key), ((3,), (4,))))
    return drawn.select(key, F.array_max(F.transform("_arms", draw)).alias("_best")).select(key, F.col("_best.arm").alias("choice"), F.col("_best.draw").alias("draw"))


def contextual_choice(rows: DataFrame, fitted: DataFrame, policy: str, key: str, features: str, seed: int) -> DataFrame:
    """(key, choice, draw): for each row the arm of its policy with the largest theta x plus noise of its variance.

    The noise is the posterior of a linear model with one variance for all features: sqrt(variance |x|^2) times a normal draw.
    """
    listed = fitted.groupBy(policy).agg(F.array_sort(F.collect_list(F.struct("arm", "theta", "variance"))).alias("_arms"))
    x = F.col(features)
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v))
    mean = lambda a: F.aggregate(F.zip_with(a["theta"], x, lambda t, v: t * v), F.lit(0.0), lambda t, v: t + v)
    draw = lambda a, i: F.struct((mean(a) + F.sqrt(a["variance"]) * size * F.get("_z", i)).alias("draw"), (-i).alias("place"), a["arm"].alias("arm"))
    best = F.array_max(F.transform("_arms", draw))
    drawn = rows.select(policy, key, features).join(F.broadcast(listed), policy).withColumn("_z", normal_draws(F.size("_arms"), seed, F.col(key)))
    return drawn.select(key, best.alias("_best")).select(key, F.col("_best.arm").alias("choice"), F.col("_best.draw").alias("draw"))


def linucb(rows: DataFrame, arm: str, features: Sequence[str], reward_col: str, alpha: float) -> DataFrame:
    """(arm, theta, inverse): ridge solution of each arm from sums over all its rows; only sums leave the tasks."""
    d = len(features)
    sums = [F.sum(F.col(features[i]) * F.col(features[j])).alias(f"_a{i}_{j}") for i in range(d) for j in range(i, d)] + [F.sum(F.col(features[i]) * F.col(reward_col)).alias(f"_b{i}") for i in range(d)]
    totals = rows.groupBy(arm).agg(F.count("*").alias("n"), *sums)
    kind = dict(rows.dtypes)[arm]

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a = np.eye(d)
                for i in range(d):
                    for j in range(i, d):
                        a[i, j] += r[f"_a{i}_{j}"]
                        a[j, i] = a[i, j]
                inverse = np.linalg.inv(a)
                out.append((r[arm], r["n"], (inverse @ [r[f"_b{i}"] for i in range(d)]).tolist(), inverse.ravel().tolist()))
            yield pd.DataFrame(out, columns=[arm, "n", "theta", "inverse"])

    return totals.mapInPandas(solve, f"{arm} {kind}, n long, theta array<double>, inverse array<double>")


def linucb_choice(contexts: DataFrame, key: str, features: Sequence[str], model: DataFrame, arm: str, alpha: float) -> DataFrame:
    """Each context's arm with the highest upper bound.

    The arms travel as one array to every row, where the best is chosen: contexts are neither multiplied nor shuffled.
    """
    d = len(features)
    x = [F.col(f) for f in features]
    arms = model.agg(F.collect_list(F.struct(F.col(arm).alias("arm"), "theta", "inverse")).alias("_arms"))  # one row

    def scored(a: Column) -> Column:
        mean = reduce(lambda p, q: p + q, [a["theta"][i] * x[i] for i in range(d)])
        spread = reduce(lambda p, q: p + q, [a["inverse"][i * d + j] * x[i] * x[j] for i in range(d) for j in range(d)])
        score = mean + alpha * F.sqrt(F.greatest(spread, F.lit(0.0)))
        return F.struct(F.round(score, 9).alias("order"), a["arm"].alias("choice"), score.alias("score"))

    best = F.array_max(F.transform("_arms", scored))
    return contexts.crossJoin(F.broadcast(arms)).select(key, best.alias("_b")).select(key, "_b.choice", "_b.score")


def epsilon_greedy(rows: DataFrame, key: str, arms: str, best: str, percent: int) -> DataFrame:
    """(key, explores, choice): a share of rows by hash takes any arm by another hash, the others the best one."""
    explores = hash_below(F.col(key), 100, "e") < percent
    arm = F.element_at(arms, (F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit("a"))), 1, 8), 16, 10).cast("long") % F.size(arms) + 1).cast("int"))
    return rows.select(key, explores.alias("explores"), F.when(explores, arm).otherwise(F.col(best)).alias("choice"))


def contextual_thompson(rows: DataFrame, keys: Sequence[str], order: str, values: str, rate: float = 0.1) -> DataFrame:
    """(keys, n, theta, variance, mean_reward) of each policy and arm after all its rows in order.

    `values` holds the features and then the reward. Each row moves theta by the rate times the error of its prediction,
    and lets the variance fade to a floor. Rows of an arm are composed in blocks, so that no task holds an arm.
    """
    joined = rows.withColumn("_arm", F.struct(*keys).cast("string"))
    names = joined.groupBy("_arm").agg(*[F.first(k).alias(k) for k in keys])
    found = scans.gradient_fold(joined, "_arm", [order], values, rate, "_arm string, n long, theta array<double>, total double").join(names, "_arm")
    return found.select(*keys, "n", "theta", F.greatest(F.lit(0.01), F.pow(F.lit(0.99), "n")).alias("variance"), (F.col("total") / F.col("n")).alias("mean_reward"))


def ucb1(table: DataFrame, arm: str, mean: str, n: str, c: float = 2.0) -> DataFrame:
    """Mean plus exploration bonus; an arm without trials comes first."""
    total = table.agg(F.sum(n).alias("_all"))
    bonus = F.sqrt(c * F.ln(F.col("_all")) / F.col(n))
    return table.crossJoin(F.broadcast(total)).withColumn("ucb", F.when(F.col(n) == 0, float("inf")).otherwise(F.col(mean) + bonus)).drop("_all")


#: Partitions whose skylines are merged into one, and rows that are held against the kept ones at a time.
MERGED = 8
SKYLINE_ROWS = 256


def skyline(df: DataFrame, key: str, more: Sequence[str], less: Sequence[str]) -> DataFrame:
    """Rows that no other row beats: at least as good in everything and better in something.

    Every partition keeps its own skyline, then skylines are merged a few at a time, level by level. Rows come in the
    order of a score that a row which beats another one never has lower, so each is only held against rows that were kept.
    """
    columns = [key, *more, *less]
    sign = np.array([1.0] * len(more) + [-1.0] * len(less))

    def beaten(v: np.ndarray, by: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v), bool)
        for at in range(0, len(by), SKYLINE_ROWS):
            b = by[at : at + SKYLINE_ROWS]
            out |= ((b[:, None] >= v).all(2) & (b[:, None] > v).any(2)).any(0)
        return out

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[[*more, *less]].to_numpy(float) * sign
        order = np.lexsort(v.T[::-1])[::-1]
        kept = np.zeros((0, v.shape[1]))
        good: list[np.ndarray] = []
        for at in range(0, len(order), SKYLINE_ROWS):
            some = order[at : at + SKYLINE_ROWS]
            some = some[~beaten(v[some], kept)]
            some = some[~beaten(v[some], v[some])]
            good.append(some)
            kept = np.concatenate([kept, v[some]])
        return pdf.iloc[np.sort(np.concatenate(good))] if good else pdf

    def local(batches):
        best = None
        for pdf in batches:
            best = keep(pdf if best is None else pd.concat([best, pdf], ignore_index=True))
        if best is not None:
            yield best

    rows = df.select(*columns)
    parts = rows.rdd.getNumPartitions()
    best = rows.mapInPandas(local, rows.schema)
    while parts > 1:
        parts = -(-parts // MERGED)
        best = best.repartition(parts).mapInPandas(local, rows.schema)
    return best


def composite_score(quality: Column, cost: Column, latency: Column, weights: tuple[float, float, float]) -> Column:
    return weights[0] * quality + weights[1] * F.greatest(F.lit(0.0), 1 - cost / 0.1) + weights[2] * F.greatest(F.lit(0.0), 1 - latency / 5000)


def hypervolume(frontier: DataFrame, cost: str, quality: str, reference: float) -> DataFrame:
    """Area under a frontier, best quality first: room below the reference cost that the rows before have not passed."""
    w = Window.orderBy(F.desc(quality), cost).rowsBetween(Window.unboundedPreceding, -1)
    return frontier.withColumn("_top", F.coalesce(F.max(cost).over(w), F.lit(0.0))).agg(F.sum(F.greatest(F.lit(0.0), reference - F.col("_top")) * F.col(quality)).alias("volume"))


def grid(spark, axes: dict[str, tuple[float, float, int]]) -> DataFrame:
    """All combinations of evenly spaced values; axes are (low, high, steps)."""
    out = None
    for name, (low, high, steps) in axes.items():
        axis = spark.range(steps).select((F.lit(low) + F.col("id") * ((high - low) / max(1, steps - 1))).alias(name))
        out = axis if out is None else out.crossJoin(F.broadcast(axis))
    return out


def random_search(points: DataFrame, point: str, axes: dict[str, tuple[float, float]], seed: int) -> DataFrame:
    """A value on each axis for every point (an integer), each by a hash of the point, the axis and the seed."""
    return points.select(point, *[(F.lit(low) + uniform(seed + i, F.col(point)) * (high - low)).alias(name) for i, (name, (low, high)) in enumerate(axes.items())])


def spread(x: Column, seed: int) -> Column:
    """A number in [0, 1) from an integer by two multiplications: enough to shift a digit by, and short."""
    return F.pmod(F.pmod(x * 48_271 + seed * 69_621 + 11, F.lit(PRIME)) * 16_807, F.lit(PRIME)) / F.lit(float(PRIME))


def permuted(i: Column, n: int, seed: int) -> Column:
    """A keyed permutation of 0 to n - 1, worked out in the row.

    Rounds on the two digits of i in a mixed radix (a divisor of n near its root): each adds to one digit a hash of the
    other, which can be undone, between two multiplications by a number that has no divisor in common with n.
    """
    step = next(k for k in range(int(n * 0.618) or 1, 2 * n + 2) if math.gcd(k, n) == 1)
    radix = next(k for k in range(math.isqrt(n), 0, -1) if n % k == 0)
    x = F.pmod(i.cast("long") * step + seed, F.lit(n))
    low, high = F.pmod(x, F.lit(radix)), F.floor(x / radix).cast("long")
    for r in range(2):
        high = F.pmod(high + F.floor(spread(low, seed + 10 + r) * (n // radix)).cast("long"), F.lit(n // radix))
        low = F.pmod(low + F.floor(spread(high, seed + 20 + r) * radix).cast("long"), F.lit(radix))
    return F.pmod((high * radix + low) * step + 1, F.lit(n))


def latin_hypercube(points: DataFrame, point: str, axes: dict[str, tuple[float, float]], n: int, seed: int) -> DataFrame:
    """One point in each of n strata of every axis, for points 0 to n - 1: the stratum and the place in it come from the row."""
    at = lambda i: (permuted(F.col(point), n, seed + 101 * i) + uniform(seed + 7 * i, 99, F.col(point))) / n
    return points.select(point, *[(F.lit(low) + at(i) * (high - low)).alias(name) for i, (name, (low, high)) in enumerate(axes.items(), 1)])
