"""Shared helpers: table access, the shared scratch folder, and Arrow maps over whole texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Rows of an Arrow batch between Spark and Python: texts are long, and a batch is held on both sides.
ARROW_ROWS = 1_000
#: Rows and bytes that one output batch holds at most; a single row may be larger.
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where the setting is absent and Spark runs on one machine, as in tests, a local folder is made and set; a
    cluster must name its shared folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, UTF-8 bytes): only these columns leave the scan, whatever else the table holds."""
    return df.select(F.col(id_col), F.col(text_col).cast("binary").alias("_bytes"))


def text_and_row(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, UTF-8 bytes, the whole row as one struct): in it no column can clash with an operator's own."""
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_bytes"), F.struct("*").alias("_row"))


def with_row(df: DataFrame, id_col: str, own: str) -> StructType:
    """The schema (_id, _row, own columns...) of an operator's result over text_and_row."""
    return StructType([StructField("_id", df.schema[id_col].dataType), StructField("_row", df.schema), *_parse_datatype_string(own).fields])


def in_small_batches(df: DataFrame) -> DataFrame:
    """Lower the session's batch size for the plan that follows, never raise it."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return df


def slices(batch: pa.RecordBatch, most: int = BATCH_BYTES, bytes_col: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece holds much more than `most` bytes of text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(bytes_col)), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (size + n > most or i - start >= BATCH_ROWS):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


_HELD: dict = {}
_USED: set = set()


def held(key, make: Callable[[], object]):
    """An object that a worker process keeps over the tasks of one operator; another operator's task lets it go."""
    _USED.add(key)
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def started(make: Callable[[], Callable]) -> Callable:
    """The function of a task; what the worker still holds for other operators is let go."""
    _USED.clear()
    f = make()
    for key in [k for k in _HELD if k not in _USED]:
        del _HELD[key]
    return f


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str | StructType) -> DataFrame:
    """Apply a per-row function to every row in Arrow batches.

    `make` runs once per task and returns f(*row) -> tuple of output values.
    """
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = started(make)
        for batch in batches:
            for piece in slices(batch):
                rows = [f(*row) for row in zip(*(c.to_pylist() for c in piece.columns), strict=True)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return in_small_batches(df).mapInArrow(run, kind)


def map_pieces(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str | StructType, most: int = BATCH_BYTES) -> DataFrame:
    """As map_rows, with a function of a whole bounded piece that returns columns by name."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = started(make)
        for batch in batches:
            for piece in slices(batch, most):
                out = f(piece)
                yield pa.RecordBatch.from_arrays([v if isinstance(v := out[x.name], pa.Array) else pa.array(v, x.type) for x in arrow], schema=arrow)

    return in_small_batches(df).mapInArrow(run, kind)


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int, text_col: str | None = None, text_bytes: int = 0) -> DataFrame:
    """About `rows` rows chosen by a hash of the key, for fitting a model; all of them if there are no more.

    With a text column the sample also has about `text_bytes` of text at most. The share is set from exact sums, so the
    expected size never grows with the table.
    """
    size = F.sum(F.octet_length(text_col)) if text_col else F.lit(0)
    total, length = df.agg(F.count("*"), size).first()
    share = min(rows / max(total, 1), text_bytes / max(length or 0, 1) if text_col else 1.0)
    if share >= 1:
        return df
    cut = int(share * (1 << 31))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 31)) < cut)
