"""Joins in time: intervals, the latest row before, versioned dimensions, and patterns of neighbouring rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def interval_join(left: DataFrame, right: DataFrame, key: str, left_epoch: str, right_epoch: str, within: int, how: str = "inner", only_after: bool = False) -> DataFrame:
    """Pairs of one key whose times are at most `within` seconds apart; only_after keeps rights that follow the left row.

    Both sides are cut into time buckets of that length and the right side is put into three: an equi join on
    (key, bucket), so a key with many rows spreads over its buckets.
    """
    bucket = lambda c: F.floor(F.col(c) / within)
    near = right.withColumnRenamed(key, "_near_key").withColumn("_near", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bucket(right_epoch) + d)))
    apart = F.col(right_epoch) - F.col(left_epoch)
    close = (apart > 0) & (apart <= within) if only_after else F.abs(apart) <= within
    dealt = left.withColumn("_bucket", bucket(left_epoch))
    pairs = dealt.join(near, (F.col(key) == F.col("_near_key")) & (F.col("_bucket") == F.col("_near")) & close, how)
    return pairs.drop("_near_key", "_near", "_bucket")


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows for which SQL's `left_key NOT IN (select right_key ...)` is true, as an anti join that may be shuffled.

    Against no rows at all it is true for every row, null keys too; against rows with a null it is true for none.
    """
    seen = right.agg(F.count("*").alias("_n"), F.count(F.when(F.col(right_key).isNull(), 1)).alias("_nulls"))  # one row
    other = right.select(F.col(right_key).alias("_other"))
    apart = left.join(other, left[left_key] == other["_other"], "left_anti").crossJoin(F.broadcast(seen))
    return apart.where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(left_key).isNotNull())).drop("_n", "_nulls")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_epoch: str, right_epoch: str, columns: Sequence[str]) -> DataFrame:
    """Each left row with the columns of the latest right row of its key at or before its time.

    Both sides are laid in one order, rights first at equal times, and the last right row seen is carried along.
    """
    rights = right.select(key, F.col(right_epoch).alias("_at"), F.lit(0).alias("_side"), F.struct(*columns).alias("_r"), *[F.lit(None).cast(t).alias(f"_l_{c}") for c, t in left.dtypes])
    lefts = left.select(key, F.col(left_epoch).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(rights.schema["_r"].dataType).alias("_r"), *[F.col(c).alias(f"_l_{c}") for c in left.columns])
    both = ordered.in_blocks(rights.unionByName(lefts), "_at")
    seen = ordered.running(both, key, ["_at", "_side"], [("_latest", "last", F.col("_r"))]).where("_side = 1")
    return seen.select(*[F.col(f"_l_{c}").alias(c) for c in left.columns], *[F.col(f"_latest.{c}").alias(c) for c in columns])


def versioned_join(facts: DataFrame, versions: DataFrame, key: str, epoch: str, valid_from: str) -> DataFrame:
    """Facts with the dimension version that is valid at their time: versions of a key end where the next begins."""
    until = F.lead(valid_from).over(Window.partitionBy(key).orderBy(valid_from))
    dim = versions.withColumn("_until", until)
    valid = (facts[key] == dim[key]) & (facts[epoch] >= dim[valid_from]) & (dim["_until"].isNull() | (facts[epoch] < dim["_until"]))
    return facts.join(dim, valid, "left").drop(dim[key]).drop("_until")


def match_runs(df: DataFrame, key: str, order: Sequence[str], symbol: str) -> DataFrame:
    """Matches of the pattern A B+ C: a run of B with an A right before and a C right after, one row each."""
    w = Window.partitionBy(key).orderBy(*order)
    stepped = df.withColumn("_new", F.when(F.lag(symbol).over(w).eqNullSafe(F.col(symbol)), 0).otherwise(1))
    numbered = stepped.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = numbered.groupBy(key, "_run").agg(F.first(symbol).alias("_s"), F.count("*").alias("length"), F.min(order[0]).alias("started"), F.max(order[0]).alias("ended"))
    around = Window.partitionBy(key).orderBy("_run")
    flanked = blocks.withColumn("_before", F.lag("_s").over(around)).withColumn("_after", F.lead("_s").over(around))
    return flanked.where((F.col("_s") == "B") & (F.col("_before") == "A") & (F.col("_after") == "C")).select(key, "started", "ended", "length")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


#: Levels and rows of a recursion over spans.
MOST_LEVELS = 10_000


def span_paths(spans: DataFrame, trace: str, span: str, parent: str, name: str, value: str) -> DataFrame:
    """Spans with their depth (1 for a root) and the sum of `value` from the root down to them.

    Children are found from their parents by recursive SQL, a level of all traces at a time; a span whose parent is not
    there, or that is its own ancestor, is left out.
    """
    spark = spans.sparkSession
    rows = spans.select(F.col(trace).alias("trace"), F.col(span).alias("span"), F.col(parent).alias("parent"), F.col(name).alias("name"), F.col(value).alias("value"))
    return spark.sql(
        f"""with recursive paths(trace, span, parent, name, value, parent_name, depth, total) max recursion level {MOST_LEVELS} as (
          select trace, span, parent, name, value, cast(null as string), 1, cast(value as double) from {{rows}} where parent is null
          union all select r.trace, r.span, r.parent, r.name, r.value, p.name, p.depth + 1, p.total + r.value from paths p join {{rows}} r on r.trace = p.trace and r.parent = p.span)
        select * from paths limit all""",
        rows=rows,
    )


def service_edges(paths: DataFrame) -> DataFrame:
    """(parent_name, name, calls, mean_value, depth, mean_total) of the edges between names; roots have no parent name."""
    return paths.groupBy("parent_name", "name").agg(F.count("*").alias("calls"), F.avg("value").alias("mean_value"), F.max("depth").alias("depth"), F.avg("total").alias("mean_total"))
