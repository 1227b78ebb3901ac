"""Bars of the driver's tables, which the queries are about: lineitem prices by
return flag, in days, and events as ticks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resample

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver, its times as timestamps of the session's zone."""
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return t.withColumns({c: F.col(c).cast("timestamp") for c, kind in t.dtypes if kind == "timestamp_ntz"})


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", (F.col("l_extendedprice") / 997).alias("p"), "l_quantity", "l_orderkey", "l_linenumber")
    return resample.from_ticks(li, "l_returnflag", "l_shipdate", "p", "day", volume="l_quantity", ties=("l_orderkey", "l_linenumber", "p"))


def pairs(spark: SparkSession, sf_dir: str, portfolio: Column) -> DataFrame:
    """Daily bars of the feeds of several portfolios: a portfolio for each value of an
    expression over line items, its feeds the return flags."""
    li = table(spark, sf_dir, "lineitem").select(F.concat_ws("/", portfolio.cast("string"), "l_returnflag").alias("pair"), "l_shipdate", (F.col("l_extendedprice") / 997).alias("p"), "l_quantity", "l_orderkey", "l_linenumber")
    bars = resample.from_ticks(li, "pair", "l_shipdate", "p", "day", volume="l_quantity", ties=("l_orderkey", "l_linenumber", "p"))
    return bars.withColumns({"portfolio": F.split("symbol", "/")[0], "symbol": F.split("symbol", "/")[1]})


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.select("symbol", "ts", *[F.round(F.col(c).cast("double"), digits).alias(c) for c in columns])


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), "event_id")


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.from_ticks(ticks(spark, sf_dir), "symbol", "ts", "price", "hour", ties=("event_id",))
