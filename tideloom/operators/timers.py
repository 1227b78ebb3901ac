"""Timers: the bars at which times of the day fall due."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def timers(bars: DataFrame, at: str = "09:30:00", offset: int = 0, repeat: int = 0, until: str = "23:59:59", weekdays: Sequence[int] = (), monthdays: Sequence[int] = ()) -> DataFrame:
    """(symbol, due, ts) for each time due on a day that has bars: ``at`` plus
    ``offset`` seconds, then every ``repeat`` seconds up to ``until``. ``ts`` is
    the first bar of that day at or after it; times that no bar follows give
    nothing. Weekdays count from Monday as 1; empty lists allow all days."""
    days = bars.select("symbol", F.to_date("ts").alias("_day")).distinct()
    for allowed, x in ((weekdays, F.expr("weekday(_day) + 1")), (monthdays, F.dayofmonth("_day"))):
        if allowed:
            days = days.where(x.isin(list(allowed)))
    moment = lambda t: F.to_timestamp(F.concat_ws(" ", F.col("_day").cast("string"), F.lit(t)))
    first = F.timestamp_seconds(F.unix_seconds(moment(at)) + offset)
    last = moment(until)
    due = F.sequence(first, last, F.expr(f"INTERVAL {repeat} SECOND")) if repeat > 0 else F.array(first)
    calls = days.where(first <= last).select("symbol", "_day", F.explode(due).alias("due"))
    # Due times and bars in one order; the next bar is looked up from behind.
    both = calls.select("symbol", "_day", F.col("due").alias("_at"), F.lit(0).alias("_bar")).unionByName(
        bars.select("symbol", F.to_date("ts").alias("_day"), F.col("ts").alias("_at"), F.lit(1).alias("_bar"))
    )
    w = W.partitionBy("symbol", "_day").orderBy("_at", "_bar").rowsBetween(0, W.unboundedFollowing)
    nxt = F.first(F.when(F.col("_bar") == 1, F.col("_at")), ignorenulls=True).over(w)
    out = both.withColumn("ts", nxt).where("_bar = 0 and ts is not null")
    return out.select("symbol", F.col("_at").alias("due"), "ts")
