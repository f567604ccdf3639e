"""Frames, running values and ranks over the rows of a key, split over many tasks.

A key may hold a third of all rows, so no window here is over a key alone. Rows go into blocks along their order, cut at
quantiles of all rows, so that no block holds many more rows than another, whatever the values are; where many rows share
one value of the first order column, they are cut along the second. The cuts come from mergeable sketches as part of the
plan: nothing runs while a plan is built. What a block takes over from the blocks of its key before it is worked out on
one row per key and block. Bounded frames are cut every FRAME_ROWS rows of a key, and each cut repeats the rows before
it that its first frames reach back to.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Rows that a block should hold on average, the most blocks that an order is cut into, and the accuracy of the sketch.
BLOCK_ROWS = 8_192
MOST_BLOCKS = 1_024
ACCURACY = 4 * MOST_BLOCKS
#: Parts along the second order column of the rows that share one value of the first.
TIE_BLOCKS = 256
#: Cuts that are looked through together: first every so many, then those between two of them.
STRIDE = 32
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp")
#: Rows of a key between two cuts of bounded frames.
FRAME_ROWS = 8_192
#: Rows, and sums of rows, that are added up one after another, and rows of a chunk: a power of it.
GROUP, CHUNK = 16, 4_096


def _number(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    x = F.col(column)
    if kind == "timestamp_ntz":
        x = x.cast("timestamp")
    return (F.unix_date(x) if kind == "date" else x).cast("double")


def _below(cuts: Column, wide: Column, x: Column) -> Column:
    """How many of the ascending cuts are under x: first among every STRIDE-th (wide), then among those between two."""
    jump = F.size(F.filter(wide, lambda c: c < x))
    return jump * STRIDE + F.size(F.filter(F.slice(cuts, jump * STRIDE + 1, STRIDE), lambda c: c < x))


def _wide(cuts: Column) -> Column:
    return F.filter(cuts, lambda c, i: i % STRIDE == STRIDE - 1)


def _quantiles(x: Column, parts: int) -> Column:
    shares = ",".join(f"{i / parts:.6g}" for i in range(1, parts))
    return F.percentile_approx(x, F.expr(f"cast(split('{shares}', ',') as array<double>)"), ACCURACY)  # one constant, not a node a share


def in_blocks(df: DataFrame, by: str, then: str | None = None) -> DataFrame:
    """Add _block, which never falls as `by` (and `then`, among equal ones) grows; nulls come first, and NaN last."""
    x = _number(df, by)
    known = F.when(~F.isnan(x), x)
    few = f"cast(least({MOST_BLOCKS}, greatest(1, ceil(_n / {BLOCK_ROWS}))) as int)"
    cuts = F.expr(f"case when {few} > 1 then transform(sequence(1, {few} - 1), i -> _p[cast(floor(i * {MOST_BLOCKS} / {few}) as int) - 1]) else cast(array() as array<double>) end")
    sketch = df.agg(_quantiles(known, MOST_BLOCKS).alias("_p"), F.count(known).alias("_n")).select(cuts.alias("_cuts")).select("_cuts", _wide(F.col("_cuts")).alias("_wide"))  # one row
    second = then if then and dict(df.dtypes)[then].split("(")[0].removesuffix("_ntz") in NUMBERS else None
    block = _below(F.col("_cuts"), F.col("_wide"), x).cast("long") * TIE_BLOCKS
    if second:
        shared = F.array_distinct(F.filter(F.col("_cuts"), lambda c, i: F.get(F.col("_cuts"), i + 1) == c))
        sketch = sketch.withColumn("_shared", shared)
        y = _number(df, second)
        tied = df.crossJoin(F.broadcast(sketch)).where(F.array_contains("_shared", x)).groupBy(x.alias("_x")).agg(_quantiles(F.when(~F.isnan(y), y), TIE_BLOCKS).alias("_y"))
        ties = tied.agg(F.map_from_entries(F.collect_list(F.struct("_x", F.struct("_y", _wide(F.col("_y")).alias("_w"))))).alias("_ties"))  # one row: a value has two cuts at least
        sketch = sketch.drop("_shared").crossJoin(ties)
        tie = F.element_at("_ties", x)
        parts = _below(tie["_y"], tie["_w"], y)
        block += F.when(tie.isNull() | y.isNull(), 0).when(F.isnan(y), TIE_BLOCKS - 1).otherwise(parts)
    last = (MOST_BLOCKS + 1) * TIE_BLOCKS
    at = F.when(x.isNull(), -1).when(F.isnan(x), last).otherwise(block).cast("long")
    return df.crossJoin(F.broadcast(sketch)).withColumn("_block", at).drop("_cuts", "_wide", "_ties")


def _free(name: str, taken: Sequence[str]) -> str:
    """The name, behind as many underscores as it takes not to hide one of the taken."""
    while name in taken:
        name = f"_{name}"
    return name


def _taken_over(rows: DataFrame, key: str, small: DataFrame) -> DataFrame:
    """Rows with the columns of their key and block."""
    there = small.withColumnRenamed(key, "_there_key").withColumnRenamed("_block", "_there_block")
    return rows.join(there, rows[key].eqNullSafe(F.col("_there_key")) & (rows["_block"] == F.col("_there_block"))).drop("_there_key", "_there_block")


def running(rows: DataFrame, key: str, order: Sequence[str], specs: Sequence[tuple]) -> DataFrame:
    """Add running values to rows that have _block: (name, how, column[, before]).

    how is sum, count, min, max, last (the last value that is not null) or first (of the whole key); with before, the row
    itself does not count. The key is held as a struct, in which null equals null: rows that are dealt by it and sorted once
    for their own block are joined where they lie. Its column has a name of its own, as rows may bring any.
    """
    one = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    k = _free("_k", rows.columns)
    at, earlier = F.struct(*order), Window.partitionBy(k).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = []
    for name, how, column, *_ in specs:
        if how == "first":
            parts.append(F.min_by(column, at).alias(f"_p_{name}"))
        elif how == "last":
            parts.append(F.max_by(column, F.when(column.isNotNull(), at)).alias(f"_p_{name}"))
        else:
            parts.append(one[how](column).alias(f"_p_{name}"))
    names = rows.columns
    rows = rows.withColumn(k, F.struct(key))
    small = rows.groupBy(k, "_block").agg(*parts)  # a row a key and block
    carried = []
    for name, how, *_ in specs:
        p = F.col(f"_p_{name}")
        if how == "first":
            carried.append(F.first(p).over(Window.partitionBy(k).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)).alias(f"_c_{name}"))
        elif how == "last":
            carried.append(F.last(p, ignorenulls=True).over(earlier).alias(f"_c_{name}"))
        else:
            carried.append({"count": F.sum}.get(how, one.get(how))(p).over(earlier).alias(f"_c_{name}"))
    own = Window.partitionBy(k, "_block").orderBy(*order)
    within, made = [], []
    for name, how, column, *before in specs:
        frame = own.rowsBetween(Window.unboundedPreceding, -1 if before and before[0] else 0)
        part, carry = F.col(f"_o_{name}"), F.col(f"_c_{name}")
        if how == "first":
            made.append(carry.alias(name))
            continue
        within.append((F.last(column, ignorenulls=True) if how == "last" else one[how](column)).over(frame).alias(f"_o_{name}"))
        if how == "last":
            made.append(F.coalesce(part, carry).alias(name))
        elif how in ("sum", "count"):
            made.append(F.coalesce(part + carry, part, carry).alias(name))
        else:
            made.append((F.least if how == "min" else F.greatest)(part, carry).alias(name))
    joined = rows.select("*", *within).join(small.select(k, "_block", *carried), [k, "_block"])
    return joined.select(*names, *made)


def numbered(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Add _rn, the place of a row among those of its key from 1, and _total, how many the key has. Rows that have places keep them."""
    if "_rn" in df.columns:
        return df
    k = _free("_k", df.columns)
    rows = in_blocks(df, *order[:2]).withColumn(k, F.struct(key))
    small = rows.groupBy(k, "_block").agg(F.count("*").alias("_n"))
    by_key = Window.partitionBy(k)
    before = F.coalesce(F.sum("_n").over(by_key.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_row", F.row_number().over(Window.partitionBy(k, "_block").orderBy(*order)))
    joined = placed.join(small.select(k, "_block", before.alias("_before"), F.sum("_n").over(by_key).alias("_total")), [k, "_block"])
    return joined.select(*df.columns, (F.col("_before") + F.col("_row")).alias("_rn"), "_total")


def _sums_before(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each of the rows and for the end: start and all values before, in nested groups of GROUP."""
    n = len(values)
    if n < GROUP:
        return np.cumsum(np.concatenate([start[None], values]), axis=0)
    whole, width = n // GROUP, values.shape[1]
    totals = np.cumsum(values[: whole * GROUP].reshape(whole, GROUP, width), axis=1)[:, -1]
    padded = np.concatenate([values, np.zeros(((whole + 1) * GROUP - n, width))]).reshape(whole + 1, GROUP, width)
    within = np.concatenate([_sums_before(totals, start)[:, None], padded], axis=1)
    return np.cumsum(within, axis=1)[:, :GROUP].reshape(-1, width)[: n + 1]


def nested_sums(df: DataFrame, key: str, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Add running sums of doubles, and the lowest value of each so far as <name>_low.

    Rows are added up in groups of GROUP by their place, those sums in groups of GROUP, and so on; a running sum is put
    together from the largest whole groups down. So its rounding error grows with the logarithm of the rows, and its last
    digit rests on the places of the rows alone, not on where blocks are cut. A chunk of CHUNK rows is whole groups, so
    chunks are summed by themselves, joined on one row each, and walked from the sum before them. Nulls are left out.
    """
    rows = numbered(df, key, order)
    kept, types, width = rows.columns, dict(rows.dtypes), len(sums)
    rows = rows.withColumns({"_block": F.floor((F.col("_rn") - 1) / CHUNK)} | {f"_x{i}": x.cast("double") for i, x in enumerate(sums.values())})
    totals, befores, afters, lows = [f"_t{i}" for i in range(2 * width)], [f"_b{i}" for i in range(2 * width)], [f"_a{i}" for i in range(2 * width)], [f"_l{i}" for i in range(width)]
    at = lambda names: ", ".join([f"`{key}` {types[key]}", "_block long", *[f"{c} double" for c in names]])
    made = [c for name in sums for c in (name, f"{name}_low")]
    full = ", ".join([*[f"`{c}` {types[c]}" for c in kept], *[f"`{c}` double" for c in made]])

    def matrix(table: pa.Table, names: Sequence[str]) -> np.ndarray:
        return np.stack([table.column(c).to_numpy() for c in names], axis=1).astype(float)

    def of_chunk(table: pa.Table, columns: np.ndarray, names: Sequence[str]) -> pa.Table:
        """A row a chunk of the table with those columns."""
        return pa.table([table.column(key), table.column("_block"), *columns.T], names=[key, "_block", *names])

    def values(table: pa.Table) -> np.ndarray:
        """The values, and for each whether it is there."""
        columns = [table.column(f"_x{i}") for i in range(width)]
        return np.stack([c.fill_null(0.0).to_numpy() for c in columns] + [c.is_valid().to_numpy() for c in columns], axis=1).astype(float)

    def walked(table: pa.Table, small: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """Rows in order, their running sums, and whether a value has been there yet."""
        table = table.sort_by("_rn")
        found = _sums_before(values(table), matrix(small, befores)[0])[1:]
        if len(found) == CHUNK:
            found[-1] = matrix(small, afters)[0]
        return table, found[:, :width], found[:, width:] > 0

    def total(table: pa.Table) -> pa.Table:
        return of_chunk(table.slice(0, 1), _sums_before(values(table.sort_by("_rn")), np.zeros(2 * width))[-1:], totals)

    def carried(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")  # a row a chunk
        found = _sums_before(matrix(table, totals), np.zeros(2 * width))
        return of_chunk(table, np.concatenate([found[:-1], found[1:]], axis=1), [*befores, *afters])

    def lowest(table: pa.Table, small: pa.Table) -> pa.Table:
        _, found, known = walked(table, small)
        low = np.fmin.reduce(np.where(known, found, np.inf), axis=0)[None]
        return of_chunk(small, np.concatenate([matrix(small, [*befores, *afters]), low], axis=1), [*befores, *afters, *lows])

    def lowest_before(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        low = np.concatenate([np.full((1, width), np.inf), np.fmin.accumulate(matrix(table, lows), axis=0)[:-1]])
        return of_chunk(table, np.concatenate([matrix(table, [*befores, *afters]), low], axis=1), [*befores, *afters, *lows])

    def finished(table: pa.Table, small: pa.Table) -> pa.Table:
        table, found, known = walked(table, small)
        low = np.fmin(np.fmin.accumulate(np.where(known, found, np.inf), axis=0), matrix(small, lows))
        more = [pa.array(x[:, i], mask=~known[:, i]) for i in range(width) for x in (found, low)]
        return pa.table([*(table.column(c) for c in kept), *more], names=[*kept, *made])

    chunks = rows.groupBy(key, "_block")
    small = chunks.applyInArrow(total, at(totals)).groupBy(key).applyInArrow(carried, at([*befores, *afters]))
    small = chunks.cogroup(small.groupBy(key, "_block")).applyInArrow(lowest, at([*befores, *afters, *lows])).groupBy(key).applyInArrow(lowest_before, at([*befores, *afters, *lows]))
    return chunks.cogroup(small.groupBy(key, "_block")).applyInArrow(finished, full)


def over_frames(df: DataFrame, key: str, order: Sequence[str], n: int, add: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
    """What `add` makes of rows and a frame of the last n rows of a key, the current one included."""
    rows, cut = numbered(df, key, order), max(FRAME_ROWS, 2 * n)
    number, place = F.floor((F.col("_rn") - 1) / cut), (F.col("_rn") - 1) % cut
    own = F.struct(number.alias("frame"), F.lit(False).alias("context"))
    after = F.struct((number + 1).alias("frame"), F.lit(True).alias("context"))
    dealt = rows.withColumn("_at", F.explode(F.when(place >= cut - n + 1, F.array(own, after)).otherwise(F.array(own))))
    dealt = dealt.select("*", F.col("_at.frame").alias("_frame"), F.col("_at.context").alias("_context")).drop("_at")
    w = Window.partitionBy(key, "_frame").orderBy(*order).rowsBetween(-(n - 1), 0)
    return add(dealt, w).where(~F.col("_context")).drop("_frame", "_context", *[c for c in ("_rn", "_total") if c not in df.columns])


def range_totals(df: DataFrame, key: str, at: str, within: int, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add totals (sum, count or max of a column) over the rows of a key whose whole number `at` is up to `within` under the row's own."""
    point = F.struct(F.col(key).alias("k"), F.col(at).alias("t"))
    return df.withColumn("_point", point).join(range_points(df, key, at, within, totals).drop("_rows"), "_point").drop("_point")


def range_points(df: DataFrame, key: str, at: str, within: int, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """(_point, _rows, totals) of each key and number: _point is a struct of k and t, _rows how many rows it has.

    Numbers are cut into parts as wide as a frame, so that a frame is the end
    of one part and the beginning of the next: each is a running value, and a row costs the same however many rows its
    frame has. Nothing is subtracted.
    """
    how = {"sum": F.sum, "count": F.count, "max": F.max}
    point = F.struct(F.col(key).alias("k"), F.col(at).alias("t"))
    points = df.groupBy(point.alias("_point")).agg(F.count("*").alias("_rows"), *[how[h](x).alias(f"_p_{name}") for name, (h, x) in totals.items()])
    part = F.floor(F.col("_point.t") / (within + 1))
    dealt = points.select("*", F.struct("_point.k").alias("_k"), F.explode(F.array(F.struct(part.alias("part"), F.lit(False).alias("context")), F.struct((part + 1).alias("part"), F.lit(True).alias("context")))).alias("_at"))
    dealt = dealt.select("*", F.col("_at.part").alias("_frame"), F.col("_at.context").alias("_context"), F.pmod("_point.t", F.lit(within + 1)).alias("_place"))
    frame = lambda *order: Window.partitionBy("_k", "_frame").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own, before = frame("_place", "_context"), frame(F.desc("_place"), "_context")  # of the part before: places after the row's own
    made = []
    for name, (h, _) in totals.items():
        p, join = F.col(f"_p_{name}"), F.max if h == "max" else F.sum
        a, b = join(F.when(~F.col("_context"), p)).over(own), join(F.when(F.col("_context"), p)).over(before)
        made.append((F.greatest(a, b) if h == "max" else F.coalesce(a + b, a, b)).alias(name))
    return dealt.select("_point", "_rows", "_context", *made).where(~F.col("_context")).drop("_context")


def values_at(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per key with its sorted values at 0-based ranks, each a column of n, the number of values.

    Equal values are one row with a count before they are ranked.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    rows = in_blocks(counts.withColumn("_key", F.struct(*keys)), value)
    placed = running(rows, "_key", [value], [("_to", "sum", F.col("_n"))])
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("n"))  # a row a key
    joined = placed.join(totals, list(keys)) if keys else placed.crossJoin(F.broadcast(totals))
    found = []
    for name, rank in ranks.items():
        at = rank(F.col("n"))
        found.append(F.max(F.when((at >= F.col("_to") - F.col("_n")) & (at < F.col("_to")), F.col(value))).alias(name))
    return joined.groupBy(*keys).agg(*found, F.max("n").alias("n"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per key with exact percentiles, linear between the two values beside the rank share (n - 1)."""
    low = {f"_l_{name}": (lambda n, p=p: F.floor(F.lit(p) * (n - 1))) for name, p in shares.items()}
    high = {f"_h_{name}": (lambda n, p=p: F.ceil(F.lit(p) * (n - 1))) for name, p in shares.items()}
    rows = values_at(df, keys, value, low | high)
    part = lambda p: F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
    made = [(F.col(f"_l_{name}") + part(p) * (F.col(f"_h_{name}") - F.col(f"_l_{name}"))).alias(name) for name, p in shares.items()]
    return rows.select(*keys, *made)
