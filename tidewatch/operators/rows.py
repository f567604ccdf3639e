"""Row-level operators: keys, costs, features, table queries, upserts, intake control and message validity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_key(model: Column, session: Column, user: Column, event_id: Column) -> Column:
    """Model and session together, else model, else session, else user, else the event's own id."""
    composite = F.concat(F.lit("composite:"), F.concat_ws(",", F.concat(F.lit("model:"), model), F.concat(F.lit("session:"), session)))
    return (
        F.when(model.isNotNull() & session.isNotNull(), composite)
        .when(model.isNotNull(), F.concat(F.lit("model:"), model))
        .when(session.isNotNull(), F.concat(F.lit("session:"), session))
        .when(user.isNotNull(), F.concat(F.lit("user:"), user))
        .otherwise(F.concat(F.lit("event:"), event_id))
    )


#: Task codes of the context vector.
TASK_CODES = {"classification": 0.0, "extraction": 0.33, "generation": 0.67, "analysis": 1.0}


def context_features(length: Column, priority: Column, hour: Column, weekday: Column, task: Column) -> Column:
    """Ten numbers: length (log and class), priority, hour and weekday on circles, task, a constant, padding."""
    around = lambda x, n: (F.cos(x * (2 * 3.141592653589793 / n)), F.sin(x * (2 * 3.141592653589793 / n)))
    code = reduce(lambda c, kv: c.when(task == kv[0], kv[1]), list(TASK_CODES.items())[1:], F.when(task == "classification", 0.0)).otherwise(0.5)
    size = F.when(length < 100, 0.0).when(length < 1000, 0.5).otherwise(1.0)
    return F.array(F.least(F.ln(length + 1.0) / 10, F.lit(1.0)), size, priority / 10.0, *around(hour, 24), *around(weekday, 7), code, F.lit(1.0), F.lit(0.0))


def priced(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Add `price_cost` by the first price row, by rank, whose pattern is part of the model's name.

    prices: (pattern, rank, input_per_1k, output_per_1k), a small dimension; it is matched per model, not per request.
    """
    models = requests.select("model_id").distinct()
    hit = models.join(F.broadcast(prices), F.contains(F.col("model_id"), F.col("pattern")), "left")
    best = hit.groupBy("model_id").agg(F.min_by(F.struct("input_per_1k", "output_per_1k"), "rank").alias("_p"))
    cost = F.col("prompt_tokens") / 1000 * F.col("_p.input_per_1k") + F.col("completion_tokens") / 1000 * F.col("_p.output_per_1k")
    return requests.join(best, "model_id", "left").withColumn("price_cost", cost).drop("_p")


def weighted_quality(parts: dict[str, float]) -> Column:
    """Weighted mean of the columns that are not null."""
    total = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts.items()])
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()]) / F.when(total > 0, total)


@dataclass
class TableQuery:
    """Filters as (column, operator, value), order as (column, descending), then limit, offset and columns."""

    filters: Sequence[tuple] = ()
    order: Sequence[tuple[str, bool]] = ()
    limit: int | None = None
    offset: int = 0
    columns: Sequence[str] = field(default_factory=tuple)


OPERATORS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v), "not in": lambda c, v: ~c.isin(*v), "like": lambda c, v: c.like(v), "prefix": lambda c, v: c.startswith(v), "between": lambda c, v: c.between(*v),
    "is null": lambda c, v: c.isNull(), "is not null": lambda c, v: c.isNotNull(),
}


def run_query(df: DataFrame, q: TableQuery) -> DataFrame:
    for column, operator, *value in q.filters:
        df = df.where(OPERATORS[operator](F.col(column), value[0] if value else None))
    if q.order:
        df = df.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in q.order])
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    return df.select(*q.columns) if q.columns else df


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(table, rejects) after the latest change of each key: op insert, update or delete; a stated version must match.

    base: (key, value, version); changes: (key, op, value, expected_version, order).
    """
    last = changes.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
    new = last.select(key, "op", F.col("value").alias("_value"), "expected_version", F.col(order).alias("_order"))
    merged = base.join(new, key, "full")
    clash = F.col("op").isNotNull() & F.col("expected_version").isNotNull() & ~F.coalesce(F.col("version") == F.col("expected_version"), F.lit(False))
    rejects = merged.where(clash).select(key, "op", "version", "expected_version")
    table = merged.where(clash | F.col("op").isNull() | (F.col("op") != "delete")).select(
        key,
        F.when(clash | F.col("op").isNull(), F.col("value")).otherwise(F.col("_value")).alias("value"),
        F.when(clash | F.col("op").isNull(), F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1).alias("version"),
    )
    return table.where(F.col("version").isNotNull()), rejects


def add_counters(base: DataFrame, deltas: DataFrame, key: str) -> DataFrame:
    """Counters after all increments and decrements."""
    sums = deltas.groupBy(key).agg(F.sum("delta").alias("_d"))
    return base.join(sums, key, "full").select(key, (F.coalesce("value", F.lit(0)) + F.coalesce("_d", F.lit(0))).alias("value"))


def rate_limited(df: DataFrame, source: str, epoch: str, order: str, period: int, burst: int) -> DataFrame:
    """Mark the first `burst` rows of each source and period as accepted."""
    bucket = F.col(epoch) - F.pmod(epoch, F.lit(period))
    place = F.row_number().over(Window.partitionBy(source, "bucket").orderBy(order))
    return df.withColumn("bucket", bucket).withColumn("accepted", place <= burst)


def backpressure(df: DataFrame, epoch: str, period: int, capacity: int) -> DataFrame:
    """Fill level of each period against a capacity."""
    counts = df.groupBy((F.col(epoch) - F.pmod(epoch, F.lit(period))).alias("bucket")).agg(F.count("*").alias("n"))
    fill = F.col("n") / capacity
    level = F.when(fill >= 1, "full").when(fill >= 0.9, "critical").when(fill >= 0.7, "warning").otherwise("normal")
    return counts.select("bucket", "n", F.round(fill, 6).alias("fill"), level.alias("level"), F.greatest(F.col("n") - capacity, F.lit(0)).alias("spilled"))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters): the dead letter names the first rule that is not true."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").withColumn("retry_count", F.lit(0))


def retry_delay(retries: Column, base: int = 1, most: int = 3600) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2), F.least(retries, F.lit(10)))).cast("long")
