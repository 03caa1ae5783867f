"""Registration and the shared table bindings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HOUR = 3_600_000_000
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with SQL for the same result."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(column: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {column})")


def days(column: str) -> Column:
    return F.expr(f"timestampdiff(DAY, {EPOCH}, {column})")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their time in microseconds."""
    return table(spark, folder, "events").select("user_id", "event_id", "event_type", "value", "props", micros("ts").alias("us"))


EVENTS = "ev AS (SELECT user_id, event_id, event_type, value, props, epoch_us(ts) AS us FROM events)"
# base of the note timeline below: 2024-01-01 in hours since 1970
NOTE_BASE = 473_352


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """Events as notes: one hour is one second, the value gives length and pitch."""
    return events(spark, folder).select(
        "user_id", "event_id",
        (F.col("us") / HOUR - NOTE_BASE).alias("onset"),
        (F.col("us") / HOUR - NOTE_BASE + F.col("value") / 100).alias("offset"),
        (40 + F.col("value") % 48).alias("pitch"),
        F.when(F.col("event_type") == "view", "-").otherwise(F.col("event_type")).alias("lyric"),
    )


NOTES = f"""nt AS (SELECT user_id, event_id, epoch_us(ts) / {HOUR}.0::DOUBLE - {NOTE_BASE} AS onset,
  epoch_us(ts) / {HOUR}.0::DOUBLE - {NOTE_BASE} + value / 100 AS "offset", 40 + value % 48 AS pitch,
  CASE WHEN event_type = 'view' THEN '-' ELSE event_type END AS lyric FROM events)"""
