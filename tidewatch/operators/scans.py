"""Linear recursions y = a y' + b over a key's rows, as scans that are split over many tasks.

Two such steps are one step again, so the rows of a block of a key are composed where they lie, the blocks of a key are
taken one after another on one row each, and then every block is walked from the value that it takes over. The same
holds for vectors, with a matrix in place of a. No task holds a key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .ordered import _taken_over, in_blocks

#: Numbers of the matrices of rows that are composed together.
MATRIX_CELLS = 1 << 20


def _dealt(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return rows.repartition(key, "_block").sortWithinPartitions(key, "_block", *[F.asc_nulls_last(c) for c in order])


def _starts(batch: pa.RecordBatch, key: str, last: tuple | None) -> tuple[list[bool], tuple | None]:
    """Which rows begin a block of a key; `last` is the key and block of the row before."""
    out = []
    for at in zip(batch.column(key).to_pylist(), batch.column("_block").to_pylist(), strict=True):
        same = last is not None and at[1] == last[1] and (at[0] == last[0] or (at[0] != at[0] and last[0] != last[0]))
        out.append(not same)
        last = at
    return out, last


def affine_scan(df: DataFrame, key: str, order: Sequence[str], a: Column, b: Column, result: str) -> DataFrame:
    """Add y = a y' + b, with y' that of the row before in the order of the key, and 0 before the first row.

    Where a or b is null the row leaves y as it is. Rows that tie in the whole order are taken in any order. Blocks that
    the rows have already (_block) are used.
    """
    rows = (df if "_block" in df.columns else in_blocks(df, *order[:2])).withColumns({"_a": F.when(b.isNotNull(), a), "_b": F.when(a.isNotNull(), b)})
    kind = dict(df.dtypes)[key]

    def composed(batches):
        last, at, p, q, found = None, None, 1.0, 0.0, []
        for batch in batches:
            starts, last = _starts(batch, key, last)
            for k, block, x, y, new in zip(batch.column(key).to_pylist(), batch.column("_block").to_pylist(), batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), starts, strict=True):
                if new:
                    if at:
                        found.append((*at, p, q))
                    at, p, q = (k, block), 1.0, 0.0
                if x is not None:
                    p, q = x * p, x * q + y
            if len(found) > 1000:
                yield made(found)
                found = []
        if at:
            yield made([*found, (*at, p, q)])

    schema = _parse_datatype_string(f"`{key}` {kind}, _block long, _p double, _q double")
    arrow = to_arrow_schema(schema)
    made = lambda found: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)
    small = _dealt(rows.select(key, "_block", *order, "_a", "_b"), key, order).mapInArrow(composed, schema)  # a row a key and block
    lists = small.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_block", "_p", "_q"))).alias("_s"))
    step = lambda y, s: s["_p"] * y + s["_q"]
    taken = F.aggregate("_s", F.array(F.lit(0.0)), lambda ys, s: F.concat(ys, F.array(step(F.element_at(ys, -1), s))))
    carried = lists.select(key, F.explode(F.arrays_zip(F.col("_s._block").alias("_block"), F.slice(taken, 1, F.size("_s")).alias("_y"))).alias("_z")).select(key, "_z.*")
    joined = _taken_over(rows, key, carried)
    names = df.columns
    out = _parse_datatype_string(", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), f"`{result}` double"]))

    def walked(batches):
        last, y = None, 0.0
        for batch in batches:
            starts, last = _starts(batch, key, last)
            ys = []
            for x, plus, into, new in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), batch.column("_y").to_pylist(), starts, strict=True):
                y = into if new else y
                if x is not None:
                    y = x * y + plus
                ys.append(y)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(ys, pa.float64())], names=[*names, result])

    return _dealt(joined, key, order).mapInArrow(walked, out)


def exponential_average(df: DataFrame, key: str, order: Sequence[str], value: str, alpha: float, result: str = "ema", first: float = 1.0, keep_block: bool = False) -> DataFrame:
    """Add the exponential average; the first value starts it, with the weight `first`.

    A missing value repeats the average and lets its weight fade: after k of them the old average counts
    (1 - alpha) ** (k + 1) against alpha. Before the first value the average is null. How much a block's first value
    counts rests on the blocks before; from there on the block is one linear step.
    """
    rows = df if "_block" in df.columns else in_blocks(df, *order[:2])
    rows = rows.withColumn("_x", F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")))
    schema = _parse_datatype_string(f"`{key}` {dict(df.dtypes)[key]}, _block long, _lead long, _x0 double, _p double, _q double, _tail long")
    arrow = to_arrow_schema(schema)
    old = 1 - alpha

    def weights(gap: int) -> tuple[float, float]:
        """What the old average and the value count after so many missing ones."""
        w = old ** (gap + 1)
        return (old, alpha) if not gap else (w / (w + alpha), alpha / (w + alpha))

    def composed(batches):
        last, at, held, found = None, None, None, []
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        for batch in batches:
            starts, last = _starts(batch, key, last)
            for k, block, x, new in zip(batch.column(key).to_pylist(), batch.column("_block").to_pylist(), batch.column("_x").to_pylist(), starts, strict=True):
                if new:
                    if at:
                        found.append((*at, *held))
                    at, held = (k, block), [0, None, 1.0, 0.0, 0]
                if x is None:
                    held[0 if held[1] is None else 4] += 1
                elif held[1] is None:
                    held[1] = x
                else:
                    c, d = weights(held[4])
                    held[2], held[3], held[4] = c * held[2], c * held[3] + d * x, 0
            if len(found) > 1000:
                yield made(found)
                found = []
        if at:
            yield made([*found, (*at, *held)])

    def step(state: Column, s: Column) -> Column:
        y, gap = state["y"], state["gap"] + s["_lead"]
        w = F.pow(F.lit(old), gap + 1)
        met = F.when(y.isNull(), first * s["_x0"]).when(gap == 0, old * y + alpha * s["_x0"]).otherwise((w * y + alpha * s["_x0"]) / (w + alpha))
        waited = F.when(y.isNull(), F.lit(0)).otherwise(gap)
        return F.struct(F.when(s["_x0"].isNull(), y).otherwise(s["_p"] * met + s["_q"]).alias("y"), F.when(s["_x0"].isNull(), waited).otherwise(s["_tail"]).cast("long").alias("gap"))

    small = _dealt(rows.select(key, "_block", *order, "_x"), key, order).mapInArrow(composed, schema)  # a row a key and block
    lists = small.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_block", "_lead", "_x0", "_p", "_q", "_tail"))).alias("_s"))
    start = F.array(F.struct(F.lit(None).cast("double").alias("y"), F.lit(0).cast("long").alias("gap")))
    taken = F.aggregate("_s", start, lambda states, s: F.concat(states, F.array(step(F.element_at(states, -1), s))))
    carried = lists.select(key, F.explode(F.arrays_zip(F.col("_s._block").alias("_block"), F.slice(taken, 1, F.size("_s")).alias("_y"))).alias("_z")).select(key, "_z._block", F.col("_z._y.y").alias("_y"), F.col("_z._y.gap").alias("_gap"))
    joined = _taken_over(rows, key, carried)
    names = df.columns if "_block" in df.columns or not keep_block else [*df.columns, "_block"]
    out = _parse_datatype_string(", ".join([*(f"`{n}` {dict(rows.dtypes)[n]}" for n in names), f"`{result}` double"]))

    def walked(batches):
        last, mean, gap = None, None, 0
        for batch in batches:
            starts, last = _starts(batch, key, last)
            means = []
            for x, y, before, new in zip(batch.column("_x").to_pylist(), batch.column("_y").to_pylist(), batch.column("_gap").to_pylist(), starts, strict=True):
                if new:
                    mean, gap = y, before
                if x is None:
                    gap += mean is not None
                else:
                    c, d = weights(gap)
                    mean, gap = first * x if mean is None else c * mean + d * x, 0
                means.append(mean)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(means, pa.float64())], names=[*names, result])

    return _dealt(joined, key, order).mapInArrow(walked, out)


def _composed(m: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps y = m y' + v one after another as one step: two beside each other become one, until one is left."""
    while len(m) > 1:
        odd = len(m) % 2
        first_m, first_v, then_m, then_v = m[odd::2], v[odd::2], m[odd + 1 :: 2], v[odd + 1 :: 2]
        m, v = np.concatenate([m[:odd], then_m @ first_m]), np.concatenate([v[:odd], np.einsum("nij,nj->ni", then_m, first_v) + then_v])
    return m[0], v[0]


def gradient_fold(df: DataFrame, key: str, order: Sequence[str], values: str, rate: float, schema: str) -> DataFrame:
    """(key, n, theta, total) after all rows of a key: theta = theta + rate (r - theta f) f for each row's features f and reward r.

    `values` is an array of the features and the reward. Each row is a matrix and a vector; blocks compose them.
    """
    rows = in_blocks(df.select(key, *dict.fromkeys([*order, values])), *order[:2])
    out = to_arrow_schema(_parse_datatype_string(f"`{key}` {dict(df.dtypes)[key]}, _block long, n long, total double, m array<double>, v array<double>"))

    def composed(batches):
        last, at, held = None, None, None

        def row():
            n, total, m, v = held
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*at, n, total, m.ravel().tolist(), v.tolist()), out, strict=True)], schema=out)

        for batch in batches:
            starts, last = _starts(batch, key, last)
            xs = batch.column(values).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
            d = xs.shape[1] - 1
            most = max(1, MATRIX_CELLS // (d * d))
            cuts = sorted({*np.flatnonzero(starts).tolist(), *range(0, batch.num_rows, most), batch.num_rows})
            for low, high in zip(cuts, cuts[1:]):
                if starts[low]:
                    if held:
                        yield row()
                    at = (batch.column(key)[low].as_py(), batch.column("_block")[low].as_py())
                    held = (0, 0.0, np.eye(d), np.zeros(d))
                f, r = xs[low:high, :-1], xs[low:high, -1]
                n, total, m, v = held
                later, plus = _composed(np.eye(d) - rate * f[:, :, None] * f[:, None, :], rate * r[:, None] * f)
                held = (n + high - low, total + float(r.sum()), later @ m, later @ v + plus)
        if held:
            yield row()

    small = _dealt(rows, key, order).mapInArrow(composed, _parse_datatype_string(f"`{key}` {dict(df.dtypes)[key]}, _block long, n long, total double, m array<double>, v array<double>"))
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def joined(table: pa.Table) -> pa.Table:
        blocks = sorted(zip(*(table.column(c).to_pylist() for c in ("_block", "n", "total", "m", "v")), strict=True), key=lambda x: x[0])  # MOST_BLOCKS * TIE_BLOCKS at most
        theta = np.zeros(len(blocks[0][4]))
        for _, _, _, m, v in blocks:
            theta = np.array(m).reshape(len(v), len(v)) @ theta + np.array(v)
        values = (table.column(key)[0].as_py(), sum(b[1] for b in blocks), theta.tolist(), sum(b[2] for b in blocks))
        return pa.table([pa.array([x], f.type) for x, f in zip(values, arrow, strict=True)], schema=arrow)

    return small.groupBy(key).applyInArrow(joined, schema)
