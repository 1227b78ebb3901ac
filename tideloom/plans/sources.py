"""Queries that write the bars as files of each format and read them back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import charts, readers
from ..sources.scratch import scratch
from .bars import Query, days, hours, rounded, ticks
from .sql import DAYS

BAR = ("open", "high", "low", "close", "volume")
HOURS = """bars AS (
  SELECT event_type AS symbol, CAST(date_trunc('hour', events.ts) AS TIMESTAMP) AS ts, first(value ORDER BY events.ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY events.ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events WHERE value IS NOT NULL GROUP BY event_type, date_trunc('hour', events.ts)
)"""


def _files(df: DataFrame, header: bool = True, sep: str = ",") -> tuple[str, Column]:
    """A folder a symbol; where they are, and what tells the symbol of a row."""
    path = scratch(df.sparkSession)
    df.write.partitionBy("symbol").csv(path, header=header, sep=sep)
    return f"{path}/symbol=*", F.regexp_extract(F.input_file_name(), "symbol=([^/]+)/", 1)


def _as(ts: str, form: str) -> Column:
    return F.date_format(ts, form)


def _generic(s: SparkSession, d: str) -> DataFrame:
    at, symbol = _files(days(s, d).select("symbol", _as("ts", "dd/MM/yyyy HH:mm").alias("datetime"), "close", F.lit("x").alias("note"), "open", "volume", "high", "low"), sep=";")
    return readers.generic_csv(s, at, symbol, ("datetime", "close", "note", "open", "volume", "high", "low"), "dd/MM/yyyy HH:mm", sep=";")


def _generic_unix(s: SparkSession, d: str) -> DataFrame:
    at, symbol = _files(days(s, d).select("symbol", F.unix_seconds("ts").alias("datetime"), *BAR), header=False)
    return readers.generic_csv(s, at, symbol, ("datetime", *BAR), header=False, unix=True, start="1996-01-01", end="1997-12-31")


def _bar(with_time: bool) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        when = [_as("ts", "yyyy-MM-dd").alias("date"), *([_as("ts", "HH:mm:ss").alias("time")] if with_time else [])]
        at, symbol = _files((hours if with_time else days)(s, d).select("symbol", *when, *BAR, F.lit(0).alias("openinterest")))
        return readers.bar_csv(s, at, symbol, with_time)

    return run


def _yahoo(s: SparkSession, d: str) -> DataFrame:
    at, symbol = _files(days(s, d).select("symbol", _as("ts", "yyyy-MM-dd").alias("Date"), *BAR[:4], (F.col("close") / 2).alias("Adj Close"), "volume"))
    return readers.yahoo_csv(s, at, symbol)


def _yahoo_swapped(s: SparkSession, d: str) -> DataFrame:
    at, symbol = _files(days(s, d).orderBy(F.desc("ts")).select("symbol", _as("ts", "yyyy-MM-dd").alias("Date"), *BAR[:3], (F.col("close") / 2).alias("Close"), F.col("close").alias("Adj Close"), "volume"))
    return readers.yahoo_csv(s, at, symbol, swap=True, adjust_volume=False, decimals=2)


def _mt4(s: SparkSession, d: str) -> DataFrame:
    at, symbol = _files(hours(s, d).select("symbol", _as("ts", "yyyy.MM.dd"), _as("ts", "HH:mm"), "open", F.col("open").alias("high"), "low", "close", "volume"), header=False)
    return readers.mt4_csv(s, at, symbol)


def _sierra(s: SparkSession, d: str) -> DataFrame:
    """A third of the rows are broken: their low is above their high."""
    low = F.when(F.dayofmonth("ts") % 3 == 0, F.col("high") + 1).otherwise(F.col("low"))
    at, symbol = _files(days(s, d).select("symbol", _as("ts", "yyyy/M/d").alias("Date"), _as("ts", "HH:mm:ss").alias("Time"), "open", "high", low.alias("low"), "close", "volume"))
    return readers.sierra_csv(s, at, symbol)


def _ticks(s: SparkSession, d: str) -> DataFrame:
    """Trades with their quotes, of which every seventh is crossed; far ones are left out."""
    t = ticks(s, d).where("price is not null")
    bid = F.when(F.pmod("event_id", F.lit(7)) == 0, F.col("price") + 2).otherwise(F.col("price") - 1)
    at, symbol = _files(t.select("symbol", _as("ts", "yyyy/M/d").alias("Date"), _as("ts", "HH:mm:ss.SSSSSS").alias("Time"), "price", (F.pmod("event_id", F.lit(5)) + 1).alias("volume"), bid.alias("bid"), (F.col("price") + 1).alias("ask")))
    return readers.sierra_ticks(s, at, symbol, 7200, outliers=1.5)


def _chart(intraday: bool) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        path = scratch(s)
        rows = (hours if intraday else days)(s, d)
        time = F.regexp_replace(_as("ts", "HHmmss"), "^0+(?=.)", "")
        rows.select("symbol", F.lit("1" if intraday else "D").alias("period"), _as("ts", "yyyyMMdd"), time.alias("time"), *BAR, F.lit(0)).write.csv(path)
        return readers.chart_csv(s, path, intraday)

    return run


def _quandl(s: SparkSession, d: str) -> DataFrame:
    halves = [(F.col(c) / 2).alias(f"Adj. {c}") for c in BAR]
    at, symbol = _files(days(s, d).select("symbol", _as("ts", "yyyy-MM-dd").alias("Date"), *BAR, F.lit(0).alias("Ex-Dividend"), F.lit(1).alias("Split Ratio"), *halves))
    return readers.quandl_csv(s, at, symbol)


def _frame(s: SparkSession, d: str) -> DataFrame:
    return readers.frame(days(s, d).select(F.col("symbol").alias("Ticker"), F.col("ts").alias("Date"), *[F.col(c).alias(c.upper()) for c in BAR[:4]], F.col("volume").alias("Vol")))


def _written(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    readers.write_csv(days(s, d), path)
    return readers.generic_csv(s, path, F.col("symbol"), ("symbol", "datetime", *readers.FIELDS), "yyyy-MM-dd HH:mm:ss.SSS")


def _together(s: SparkSession, d: str) -> DataFrame:
    b = days(s, d)
    return readers.together(b.where("symbol = 'A'"), b.where("symbol = 'N'").drop("openinterest"), b.where("symbol not in ('A', 'N')"))


def _times(s: SparkSession, d: str) -> DataFrame:
    return readers.between(hours(s, d), opens="09:30:00", closes="16:00:00")


def _binary(whole: bool = False, **bounds) -> Query:
    """Daily bars written as binary chart files, then read: whole, or in tasks of 200 records."""

    def run(s: SparkSession, d: str) -> DataFrame:
        at = scratch(s)
        charts.write_charts(days(s, d), at)
        return readers.chart_binary(s, f"{at}/*.fd") if whole else charts.read_charts(s, at, records=200, **bounds)

    return run


def queries() -> dict[str, Query]:
    made = {
        "src_generic_csv": _generic, "src_generic_csv_unix": _generic_unix, "src_bar_csv": _bar(False), "src_bar_csv_time": _bar(True), "src_yahoo_csv": _yahoo, "src_yahoo_csv_swapped": _yahoo_swapped,
        "src_mt4_csv": _mt4, "src_sierra_csv": _sierra, "src_sierra_ticks": _ticks, "src_chart_csv": _chart(False), "src_chart_csv_intraday": _chart(True), "src_quandl_csv": _quandl, "src_frame": _frame, "src_writer_csv": _written, "src_together": _together, "src_between_times": _times,
        "src_chart_binary": _binary(whole=True), "src_chart_split": _binary(), "src_chart_split_between": _binary(start=dt.datetime(1994, 3, 1), end=dt.datetime(1996, 2, 29)),
    }
    return {k: (lambda s, d, q=q: rounded(q(s, d), *BAR)) for k, q in made.items()}


def oracle_sql() -> dict[str, str]:
    cells = lambda **other: ", ".join(f"round({other.get(c, c)}, 4) AS {c}" for c in BAR)
    day = lambda where="true", **other: f"WITH {DAYS} SELECT symbol, ts, {cells(**other)} FROM bars WHERE {where}"
    hour = lambda where="true", **other: f"WITH {HOURS} SELECT symbol, ts, {cells(**other)} FROM bars WHERE {where}"
    half = {c: f"{c} / 2" for c in BAR}
    four = {c: f"CAST(CAST({c} AS FLOAT) AS DOUBLE)" for c in BAR[:4]}
    return {
        "src_sierra_ticks": "WITH t AS (SELECT event_type AS symbol, events.ts AS came, value, event_id FROM events WHERE value IS NOT NULL AND event_id % 7 <> 0), m AS (SELECT symbol, avg(value) AS mean, stddev_pop(value) AS std FROM t GROUP BY symbol) SELECT symbol, time_bucket(INTERVAL '2 hours', came) AS ts, round(first(value ORDER BY came, value), 4) AS open, round(max(value), 4) AS high, round(min(value), 4) AS low, round(last(value ORDER BY came, value), 4) AS close, CAST(sum(event_id % 5 + 1) AS DOUBLE) AS volume FROM t JOIN m USING (symbol) WHERE abs(value - mean) <= 1.5 * std GROUP BY symbol, time_bucket(INTERVAL '2 hours', came)",
        "src_chart_binary": day(**four), "src_chart_split": day(**four), "src_chart_split_between": day("ts BETWEEN '1994-03-01' AND '1996-02-29'", **four),
        "src_generic_csv": day(), "src_generic_csv_unix": day("ts BETWEEN '1996-01-01' AND '1997-12-31'"), "src_bar_csv": day(), "src_bar_csv_time": hour(),
        "src_yahoo_csv": day(**half | {"volume": "volume * 2"}), "src_yahoo_csv_swapped": day(**{c: f"round({c} / 2, 2)" for c in BAR[:4]}),
        "src_mt4_csv": hour(high="greatest(open, close, low)"), "src_sierra_csv": day("day(ts) % 3 <> 0"), "src_chart_csv": day(), "src_chart_csv_intraday": hour(), "src_quandl_csv": day(**half),
        "src_frame": day(), "src_writer_csv": day(), "src_together": day(), "src_between_times": hour("CAST(ts AS TIME) BETWEEN '09:30:00' AND '16:00:00'"),
    }
