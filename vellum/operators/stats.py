"""Dashboard figures, views by type and month, states of batches, speeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def conditional_counts(rows: DataFrame, counts: dict[str, Column], **others: Column) -> DataFrame:
    """One row: for each name the rows that meet its condition, and other aggregates; one pass over the table."""
    return rows.agg(*[F.count_if(c).alias(n) for n, c in counts.items()], *[c.alias(n) for n, c in others.items()])


def beside(*single: DataFrame) -> DataFrame:
    """One row made of several tables of one row."""
    out = single[0]
    for other in single[1:]:
        out = out.crossJoin(other)
    return out


def since(column: Column, today: str, days: int) -> Column:
    """Whether a time is on or after the day so many days before ``today``."""
    return column >= F.lit(today).cast("date") - F.expr(f"interval {days} days")


def by_period(rows: DataFrame, date: str, kind: str, pattern: str = "yyyy-MM") -> DataFrame:
    """Rows by period and kind."""
    return rows.groupBy(F.date_format(date, pattern).alias("period"), kind).agg(F.count("*").alias("rows"))


def by_type(rows: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Rows by type with the first and last date."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def latest_of_each(log: DataFrame, key: str, time: str, *columns: str, ties: str = "event_id") -> DataFrame:
    """The newest entry of each key."""
    newest = F.max_by(F.struct(time, *columns), F.struct(time, ties)).alias("newest")
    return log.groupBy(key).agg(newest).select(key, "newest.*")


def latest(time: Column) -> Column:
    """The latest of the times in a group, null if one is missing: what an order from the latest on has first in SQL."""
    return F.when(F.count_if(time.isNull()) == 0, F.max(time))


def speeds(samples: DataFrame, key: str, time_ms: str, amount: str, ties: str, window_ms: int = 30_000, most: int = 10, least_ms: int = 500) -> DataFrame:
    """``samples`` with ``speed``: amount a second over the last ``window_ms``, of at most ``most`` samples; 0 over less than ``least_ms``."""
    recent = W.partitionBy(key).orderBy(time_ms, ties).rowsBetween(1 - most, 0)
    rows = samples.withColumn("__last", F.collect_list(F.struct(time_ms, amount)).over(recent))
    rows = rows.withColumn("__seen", F.filter("__last", lambda x: x[time_ms] >= F.col(time_ms) - window_ms))
    first, end = F.col("__seen")[0], F.element_at("__seen", -1)
    span = (end[time_ms] - first[time_ms]) / 1000.0
    speed = F.when((F.size("__seen") < 2) | (span < least_ms / 1000), 0.0).otherwise((end[amount] - first[amount]) / span)
    return rows.withColumn("speed", speed).drop("__seen", "__last")
