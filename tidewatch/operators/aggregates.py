"""Named aggregates in one pass, and the statistics that Spark's own functions define otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered


def agg_spec(specs: Sequence[tuple]) -> list[Column]:
    """Aggregates from (kind, column, name[, parameter]); percentiles interpolate linearly, as parameter 0 to 100."""
    one = {
        "count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_samp, "stddev_pop": F.stddev_pop,
        "variance": F.var_samp, "variance_pop": F.var_pop, "count_distinct": F.count_distinct,
    }
    out = []
    for kind, column, name, *parameter in specs:
        if kind == "percentile":
            out.append(F.percentile(column, parameter[0] / 100).alias(name))
        elif kind == "rate":
            span = F.max(column) - F.min(column)
            out.append((F.count("*") / F.when(span != 0, span)).alias(name))
        elif kind == "histogram":
            out += [F.sum(F.when(F.col(column) <= b, 1).otherwise(0)).alias(f"{name}_le_{i}") for i, b in enumerate(parameter[0])]
        else:
            out.append(one[kind](column).alias(name))
    return out


def by_rank(df: DataFrame, keys: Sequence[str], value: str, ranks: dict) -> DataFrame:
    """One row per key with the sorted values at 0-based ranks, each a column of n, the group's size."""
    return ordered.values_at(df, keys, value, ranks)


def agg_whole(df: DataFrame, keys: Sequence[str], specs: Sequence[tuple]) -> DataFrame:
    """As agg_spec over whole keys of any size: percentiles come from ranks, not from one task's values of a key."""
    plain = df.groupBy(*keys).agg(*agg_spec([s for s in specs if s[0] != "percentile"]))
    columns = {s[1] for s in specs if s[0] == "percentile"}
    for column in sorted(columns):
        wanted = {s[2]: s[3] / 100 for s in specs if s[0] == "percentile" and s[1] == column}
        plain = plain.join(ordered.percentiles(df, keys, column, wanted), list(keys), "left")
    return plain


def nearest_rank(p: float):
    """Rank round(p / 100 (n - 1)), half up."""
    return lambda n: F.floor(F.lit(p) / 100 * (n - 1) + 0.5)


def quartile(k: int):
    """Rank n k / 4, cut to a whole number."""
    return lambda n: F.floor(n * k / 4)


def percentage_change(old: Column, new: Column) -> Column:
    """From zero to zero there is no change, from zero to another value 100."""
    return F.when(old == 0, F.when(new == 0, 0.0).otherwise(100.0)).otherwise((new - old) / F.abs(old) * 100)


def trend(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares slope, intercept and fit; a constant series fits fully."""
    fit = F.when(F.var_pop(y) == 0, F.lit(1.0)).otherwise(F.regr_r2(y, x))
    return df.groupBy(*keys).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), fit.alias("r2"), F.count("*").alias("n"))
