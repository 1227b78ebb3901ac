"""Bars over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(ticks: DataFrame, width: str = "1 day", late: str = "1 hour", symbol: str = "symbol", ts: str = "ts", price: str = "price", volume: str | None = None, tie: str | None = None) -> DataFrame:
    """Ticks to bars by event time. In append mode a bar comes once it is
    complete, in update mode as it grows (a replay); ticks later than ``late``
    are dropped. The same code runs on a static frame."""
    at = F.struct(ts, tie) if tie else F.col(ts)
    t = ticks.where(F.col(price).isNotNull()).withWatermark(ts, late)
    g = t.groupBy(F.col(symbol).alias("symbol"), F.window(ts, width).alias("_w"))
    out = g.agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        (F.sum(volume) if volume else F.count("*").cast("double")).alias("volume"),
    )
    return out.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "1 hour", symbol: str = "symbol", ts: str = "ts", price: str = "price") -> DataFrame:
    """Bars of activity that quiet spells of ``gap`` keep apart."""
    t = ticks.where(F.col(price).isNotNull()).withWatermark(ts, late)
    g = t.groupBy(F.col(symbol).alias("symbol"), F.session_window(ts, gap).alias("_w"))
    out = g.agg(F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.count("*").alias("ticks"))
    return out.select("symbol", F.col("_w.start").alias("ts"), F.col("_w.end").alias("until"), "open", "high", "low", "close", "ticks")
