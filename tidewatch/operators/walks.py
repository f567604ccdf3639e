"""Recursions over a key's rows in order, with only the state carried from batch to batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def _walk(df: DataFrame, key: str, order: Sequence[str], value: str, start: Callable[[], Callable], finish: Callable, schema) -> DataFrame:
    """Each key's rows in order through a step of its own: a key lies in one task, but is never held there as a whole."""
    rows = df.repartition(key).sortWithinPartitions(key, *[F.asc_nulls_last(c) for c in order])

    def run(batches):
        at, step = None, None
        for batch in batches:
            found = []
            for k, x in zip(batch.column(key).to_pylist(), batch.column(value).to_pylist(), strict=True):
                if step is None or (k != at and not (k != k and at != at)):  # NaN is one key
                    at, step = k, start()
                found.append(step(x))
            yield finish(batch, found)

    return rows.mapInArrow(run, schema)


def walk(df: DataFrame, key: str, order: Sequence[str], value: str, start: Callable[[], Callable], keep: Sequence[str], result: str) -> DataFrame:
    """The kept columns and what `start()` makes of each key's values in order; `result` is its name and type."""
    kinds = dict(df.dtypes)
    schema = _parse_datatype_string(", ".join([*(f"`{c}` {kinds[c]}" for c in keep), result]))
    kind = to_arrow_schema(schema).field(len(keep))

    def finish(batch, found):
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, kind.type)], names=[*keep, kind.name])

    return _walk(df.select(*dict.fromkeys([key, *order, value])), key, order, value, start, finish, schema)


def walk_filter(df: DataFrame, key: str, order: Sequence[str], value: str, start: Callable[[], Callable]) -> DataFrame:
    """The rows, with all their columns, to which `start()` says true."""
    return _walk(df, key, order, value, start, lambda batch, found: batch.filter(pa.array(found, pa.bool_())), df.schema)
