"""Where plans register themselves: a query by name, and its SQL over the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: bool = True):
    """Register a function of (spark, sf_dir); `sql` may use the telemetry views and may start with further CTEs."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql) if views else sql
        return f

    return keep


def with_views(sql: str, views: str | None = None) -> str:
    """The telemetry views in front of a statement that starts with `select`, or with `with` and CTEs of its own."""
    text = sql.strip()
    if text.lower().startswith("with recursive "):
        return f"with recursive {views or tables.sql_views()}, {text[15:]}"
    rest = f", {text[5:]}" if text.lower().startswith("with ") else f" {text}"
    return f"with {views or tables.sql_views()}{rest}"


TABLE = re.compile(r"\b(from|join)\s+(requests|feedback|events|documents|conversations|part|supplier|nation|orders|lineitem|customer|labels)\b", re.IGNORECASE)


def spark_text(sql: str) -> str:
    """The text for Spark with placeholders for tables, so that no temporary view of the session is touched."""
    return TABLE.sub(r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}"))


def both(name: str, sql: str, *more: str) -> None:
    """Register SQL text that Spark and plain SQL read alike, over requests, feedback and other given tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views = {"requests": tables.requests, "feedback": tables.feedback}
        used = {m.lower() for _, m in TABLE.findall(sql)}
        return spark.sql(spark_text(sql), **{t: views[t](spark, sf_dir) if t in views else tables.read(spark, sf_dir, t) for t in used})

    QUERIES[name] = run
    ORACLES[name] = with_views(sql)
