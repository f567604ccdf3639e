"""Scalar functions of the SQL surface: dates, JSON, arrays, maps and casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import read
from .registry import query


@query(
    "sql_date_functions",
    """select event_id, year(ts)::int as y, month(ts)::int as mo, day(ts)::int as d, hour(ts)::int as h, minute(ts)::int as mi, cast(floor(second(ts)) as int) as s, strftime(ts, '%Y-%m-%d') as label, cast(ts as date) as day, cast(ts as date) + 3 as later, cast(ts as date) - 2 as earlier,
    datediff('day', timestamp '2024-01-01', date_trunc('day', ts)) as days, cast(floor(epoch(ts - timestamp '2024-01-01') / 3600) as bigint) as hours, strftime(date_trunc('month', ts), '%Y-%m-%d') as month_start, isodow(ts)::int as weekday, quarter(ts)::int as q from events""",
    views=False,
)
def dates(spark, sf_dir):
    return read(spark, sf_dir, "events").selectExpr(
        "event_id", "year(ts) as y", "month(ts) as mo", "day(ts) as d", "hour(ts) as h", "minute(ts) as mi", "cast(floor(second(ts)) as int) as s", "date_format(ts, 'yyyy-MM-dd') as label", "to_date(ts) as day", "date_add(to_date(ts), 3) as later", "date_sub(to_date(ts), 2) as earlier",
        "cast(datediff(ts, date'2024-01-01') as bigint) as days", "timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts) as hours", "date_format(date_trunc('MONTH', ts), 'yyyy-MM-dd') as month_start", "weekday(ts) + 1 as weekday", "quarter(ts) as q",
    )


@query("sql_json_functions", "select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.k') is not null as has_k, json_extract_string(props, '$.zz') is not null as has_z, cast(json_extract_string(props, '$.k') as bigint) + 1 as next_k, to_json({'id': event_id, 'kind': event_type})::varchar as object, to_json([event_id, user_id])::varchar as list from events", views=False)
def json(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    value = F.get_json_object("props", "$.k")
    parsed = F.from_json("props", "k long")
    return rows.select("event_id", value.alias("k"), value.isNotNull().alias("has_k"), F.get_json_object("props", "$.zz").isNotNull().alias("has_z"), (parsed["k"] + 1).alias("next_k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("object"), F.to_json(F.array("event_id", "user_id")).alias("list"))


@query("sql_array_and_map_functions", "select event_id, string_split(event_type || ',' || user_id, ',')[1] as first_part, len(string_split(event_type || ',' || user_id, ',')) as parts, regexp_extract(event_type, '[aeiou]', 0) as vowel, map {'a': user_id, 'b': event_id}['b'] as at_b, ([user_id, event_id])[2] as second, cast(cast(value as decimal(10, 1)) as double) as short from events", views=False)
def arrays(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    parts = F.split(F.concat_ws(",", "event_type", F.col("user_id").cast("string")), ",")
    return rows.select("event_id", parts[0].alias("first_part"), F.size(parts).cast("long").alias("parts"), F.regexp_extract("event_type", "[aeiou]", 0).alias("vowel"), F.create_map(F.lit("a"), "user_id", F.lit("b"), "event_id")["b"].alias("at_b"), F.array("user_id", "event_id")[1].alias("second"), F.col("value").cast("decimal(10, 1)").cast("double").alias("short"))


@query("sql_string_aggregates", "select user_id, string_agg(event_type, '|' order by event_id) as kinds, count(distinct event_type) as n_kinds, max_by(event_type, event_id) as last_kind from events group by user_id", views=False)
def strings(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.expr("listagg(event_type, '|') within group (order by event_id)").alias("kinds"), F.count_distinct("event_type").alias("n_kinds"), F.max_by("event_type", "event_id").alias("last_kind"))
