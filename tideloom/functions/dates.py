"""Numeric dates, time zones and trading calendars."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def date2num(ts: Column) -> Column:
    """Days since 1970-01-01 plus the fraction of the day."""
    return F.unix_micros(ts) / F.lit(86_400_000_000.0)


def num2date(days: Column) -> Column:
    return F.timestamp_micros(F.round(days * F.lit(86_400_000_000.0)).cast("bigint"))


def time2num(ts: Column) -> Column:
    """The time of day as a fraction of it."""
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / F.lit(86_400.0)


def num2time(x: Column) -> Column:
    """HH:MM:SS of a fraction of a day."""
    s = F.round(x * 86_400).cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int"), F.pmod(s, F.lit(60)))


def localize(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def to_utc(ts: Column, zone: str) -> Column:
    return F.to_utc_timestamp(ts, zone)


def calendar(spark: SparkSession, first: str, last: str, holidays: Sequence[str] = (), weekdays: Sequence[int] = (1, 2, 3, 4, 5), open_at: str = "09:30:00", close_at: str = "16:00:00", early: dict[str, str] | None = None) -> DataFrame:
    """A row per trading day: date, opens, closes, next_day, and whether it is
    the last of its week, month or year. Weekdays count from Monday as 1."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 DAY)) AS date")
    return _calendar(days, holidays, weekdays, open_at, close_at, early)


def calendar_of(rows: DataFrame, ts: str = "ts", holidays: Sequence[str] = (), weekdays: Sequence[int] = (1, 2, 3, 4, 5), open_at: str = "09:30:00", close_at: str = "16:00:00", early: dict[str, str] | None = None) -> DataFrame:
    """The calendar over all the time that a table's rows are of; without rows, none."""
    ends = rows.agg(F.to_date(F.min(ts)).alias("a"), F.to_date(F.max(ts)).alias("b")).where("a is not null")
    return _calendar(ends.select(F.explode(F.sequence("a", "b")).alias("date")), holidays, weekdays, open_at, close_at, early)


def _calendar(days: DataFrame, holidays: Sequence[str], weekdays: Sequence[int], open_at: str, close_at: str, early: dict[str, str] | None) -> DataFrame:
    days = days.where(F.expr("weekday(date) + 1").isin(list(weekdays)))
    if holidays:
        days = days.where(~F.col("date").isin([dt.date.fromisoformat(h) for h in holidays]))
    close = F.lit(close_at)
    for day, at in (early or {}).items():
        close = F.when(F.col("date") == F.lit(day).cast("date"), F.lit(at)).otherwise(close)
    at = lambda t: F.to_timestamp(F.concat_ws(" ", F.col("date").cast("string"), t))
    year = W.partitionBy(F.year("date")).orderBy("date")
    days = days.withColumns({"opens": at(F.lit(open_at)), "closes": at(close)})
    # The next day within the year; the last of a year looks at the next year's first.
    starts = days.groupBy((F.year("date") - 1).alias("_y")).agg(F.min("date").alias("_first"))
    days = days.withColumn("_y", F.year("date")).withColumn("_next", F.lead("date").over(year)).join(F.broadcast(starts), "_y", "left")
    following = F.coalesce("_next", "_first")
    ends = lambda unit: F.coalesce(F.date_trunc(unit, F.col("date")) != F.date_trunc(unit, following), F.lit(True))
    return days.select("date", "opens", "closes", following.alias("next_day"), ends("week").alias("last_of_week"), ends("month").alias("last_of_month"), ends("year").alias("last_of_year"))
