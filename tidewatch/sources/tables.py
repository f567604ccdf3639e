"""Batch and stream table sources, and telemetry views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Telemetry from `events`: requests, and for one request in three a piece of feedback one minute later.
REQUESTS = """select event_id as request_id, ts as event_time, {epoch} as epoch_s, user_id,
  case when event_id % 4 = 0 then 'model_a' when event_id % 4 = 1 then 'model_b' when event_id % 4 = 2 then 'model_c' else 'model_d' end as model_id,
  event_type as endpoint, cast(value * 20 as double) as latency_ms,
  cast(50 + (event_id * 37) % 950 as bigint) as prompt_tokens, cast(10 + (event_id * 53) % 490 as bigint) as completion_tokens,
  case when event_type = 'error' then false else true end as success,
  cast(50 + (event_id * 37) % 950 as double) / cast(1000 as double) * cast(0.003 as double) + cast(10 + (event_id * 53) % 490 as double) / cast(1000 as double) * cast(0.015 as double) as cost_usd,
  case when event_id % 2 = 0 then 'control' else 'treatment' end as variant
from {events}"""
FEEDBACK = """select event_id as request_id, ts + interval '1' minute as event_time, {epoch} + 60 as epoch_s, user_id,
  cast(1 + (event_id * 7) % 5 as double) as rating, event_type = 'purchase' as task_completed, event_type = 'error' as retry_occurred,
  cast((event_id * 11) % 150 as double) as dwell_time_seconds
from {events} where event_id % 3 = 0"""
#: Seconds since 1970 of `ts` in Spark and in plain SQL.
SPARK_EPOCH, SQL_EPOCH = "unix_seconds(cast(ts as timestamp))", "cast(floor(epoch(ts)) as bigint)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REQUESTS.replace("{epoch}", SPARK_EPOCH), events=read(spark, sf_dir, "events"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FEEDBACK.replace("{epoch}", SPARK_EPOCH), events=read(spark, sf_dir, "events"))


def sql_views() -> str:
    """The same views as common table expressions over `events`."""
    return ", ".join(f"{name} as ({text.replace('{epoch}', SQL_EPOCH).replace('{events}', 'events')})" for name, text in (("requests", REQUESTS), ("feedback", FEEDBACK)))


def read_any(spark: SparkSession, kind: str, path: str, schema: StructType | None = None, **options) -> DataFrame:
    """A batch table of kind parquet, orc, json, csv or text; a schema spares an inference pass."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple = (), partitions: int = 8, **options) -> DataFrame:
    """A database table, read in parallel ranges of a numeric column where one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def stream_files(spark: SparkSession, kind: str, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A directory of files as a stream; files_per_batch caps the intake of a micro-batch."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def stream_kafka(spark: SparkSession, servers: str, topics: list[str], start: str | dict = "latest", most_offsets: int | None = None, **options) -> DataFrame:
    """Kafka topics as a stream: start is earliest, latest, or JSON-able offsets by topic; a timestamp goes in startingTimestamp."""
    import json

    reader = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics)}, **options)
    if "startingTimestamp" not in options:
        reader = reader.option("startingOffsets", start if isinstance(start, str) else json.dumps(start))
    return (reader.option("maxOffsetsPerTrigger", most_offsets) if most_offsets else reader).load()


def decode_json(raw: DataFrame, schema: StructType, value: str = "value") -> DataFrame:
    """Message fields beside key, topic, partition and offset; a message that is not JSON of the schema gives nulls."""
    kept = [c for c in ("key", "topic", "partition", "offset", "timestamp") if c in raw.columns]
    return raw.select(*kept, F.from_json(F.col(value).cast("string"), schema).alias("_m")).select(*kept, "_m.*")


def consumer_lag(progress: DataFrame) -> DataFrame:
    """Lag by topic from rows of (topic, partition, committed, latest)."""
    lag = F.greatest(F.col("latest") - F.coalesce("committed", F.lit(0)), F.lit(0))
    return progress.groupBy("topic").agg(F.sum(lag).alias("lag"), F.max(lag).alias("worst_partition_lag"), F.count("*").alias("partitions"))


def encode_messages(df: DataFrame, key: str, topic: str, partitions: int | None = None, how: str = "key_hash", order: str | None = None) -> DataFrame:
    """Rows of (key, value, topic, partition) for a message sink: value is the row as JSON.

    how: key_hash, round_robin (by a row number column), single, or given (the column named by `order`).
    """
    out = [F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"), F.lit(topic).alias("topic")]
    if partitions:
        spread = {"key_hash": F.pmod(F.xxhash64(key), F.lit(partitions)), "single": F.lit(0)}
        if order:
            spread |= {"round_robin": F.pmod(F.col(order), F.lit(partitions)), "given": F.col(order)}
        out.append(spread[how].cast("int").alias("partition"))
    return df.select(*out)


def append_once(path: str):
    """A foreachBatch writer that writes each batch under its own number, so that a repeated batch replaces itself."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
