"""Deduplication by ids, canonical content, composite keys and several strategies in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the row as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def content_columns(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ("timestamp", "id", "processing_time")) -> list[str]:
    """The columns that count for a row's content: those to include, or all but those to exclude."""
    return list(include) if include else [c for c in df.columns if c not in exclude]


def composite_key(*parts: str) -> Column:
    """Parts joined by `:`; null if one is missing."""
    missing = F.lit(False)
    for p in parts:
        missing = missing | F.col(p).isNull()
    return F.when(~missing, F.concat_ws(":", *[F.col(p).cast("string") for p in parts]))


def time_bucketed(key: Column, epoch: str, seconds: int) -> Column:
    return F.concat_ws("@", key, F.floor(F.col(epoch) / seconds).cast("string"))


def mark_duplicates(df: DataFrame, key: Column, epoch: str, order: str, ttl: int | None = None) -> DataFrame:
    """Add is_duplicate: the key was seen before, at most `ttl` seconds ago if given; null keys are never duplicates.

    Rows without a key are dealt by their order, so that they share no partition.
    """
    keyed = df.withColumn("_key", key).withColumn("_deal", F.when(F.col("_key").isNull(), F.xxhash64(order)))
    before = F.lag(epoch).over(Window.partitionBy("_key", "_deal").orderBy(epoch, order))
    seen = before.isNotNull() if ttl is None else F.coalesce(F.col(epoch) - before < ttl, F.lit(False))
    return keyed.withColumn("is_duplicate", seen & F.col("_key").isNotNull()).drop("_key", "_deal")


def filtered(marked: DataFrame, strategy: str, unsure: str) -> DataFrame:
    """Rows that pass under a strategy; `unsure` says where the check itself could not be made.

    strict lets neither duplicates nor unsure rows through, best_effort lets unsure rows through, log_only everything.
    """
    if strategy == "log_only":
        return marked
    sure = F.coalesce(F.col(unsure), F.lit(False))
    return marked.where(~F.col("is_duplicate") & ~sure if strategy == "strict" else ~F.col("is_duplicate") | sure)


def bloom_report(df: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """What a Bloom filter of fixed size in front of an exact check would do: one row of counts.

    A later row of a key always finds its bits set (missed is 0). A key's first row is a false alarm if all its bits were
    set by other keys. Keys are reduced first; then a bit is held by the keys that set it.
    """
    keys = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    places = F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)) for i in range(hashes)]))
    set_by = keys.select(key, F.explode(places).alias("_bit"))
    holders = set_by.groupBy("_bit").agg(F.count("*").alias("_holders"))
    alarms = set_by.join(holders, "_bit").groupBy(key).agg(F.min("_holders").alias("_least"))
    joined = keys.join(alarms, key)
    return joined.agg(F.count("*").alias("keys"), F.sum(F.col("_n") - 1).alias("duplicates"), F.lit(0).alias("missed"), F.count(F.when(F.col("_least") > 1, 1)).alias("possible_false_alarms"))


def by_strategies(df: DataFrame, strategies: Sequence[tuple[str, Column, int]], epoch: str, order: str) -> DataFrame:
    """Add `matched`: the first strategy (name, key, ttl) under which the row repeats an earlier one."""
    for name, key, ttl in strategies:
        df = mark_duplicates(df, key, epoch, order, ttl).withColumnRenamed("is_duplicate", f"_by_{name}")
    names = [n for n, *_ in strategies]
    return df.withColumn("matched", F.coalesce(*[F.when(F.col(f"_by_{n}"), F.lit(n)) for n in names])).drop(*[f"_by_{n}" for n in names])


def dedup_stats(marked: DataFrame, *keys: str) -> DataFrame:
    return marked.groupBy(*keys).agg(F.count("*").alias("checked"), F.count(F.when(F.col("is_duplicate"), 1)).alias("duplicates"), F.round(F.avg(F.col("is_duplicate").cast("double")), 6).alias("rate"))
