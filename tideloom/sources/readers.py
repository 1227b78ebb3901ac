"""Bar files as frames, and frames as files.

All readers give symbol, ts, open, high, low, close, volume, openinterest.
Columns are read by position or by name with an explicit type, so Spark scans
files in parallel without a pass to infer them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import FIELDS, clean
from ..operators.resample import bucket, from_ticks


def _lines(spark: SparkSession, path: str | list[str], columns: Sequence[str], sep: str = ",", header: bool = True) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, schema=schema, sep=sep, header=header, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def _number(x: Column, null: str = "") -> Column:
    n = x.try_cast("double")
    return F.when((x == null) | F.isnan(n), None).otherwise(n)


def _named(df: DataFrame, symbol: str | Column, ts: Column, cells: dict[str, Column]) -> DataFrame:
    s = F.lit(symbol) if isinstance(symbol, str) else symbol
    return df.select(s.alias("symbol"), ts.alias("ts"), *[cells.get(f, F.lit(0.0)).alias(f) for f in FIELDS])


def generic_csv(
    spark: SparkSession, path: str | list[str], symbol: str | Column = "data", columns: Sequence[str] = ("datetime", "open", "high", "low", "close", "volume", "openinterest"),
    date_format: str = "yyyy-MM-dd", time_format: str | None = None, sep: str = ",", header: bool = True, null: str = "",
    start: str | None = None, end: str | None = None, unix: bool = False,
) -> DataFrame:
    """A CSV file whose columns are given in order: datetime (or date and time),
    the fields, and any others by their own names, which are dropped. Rows with
    an unreadable time are dropped; unreadable numbers are null. ``unix`` reads
    epoch seconds. ``start`` and ``end`` bound the time, both inclusive."""
    raw = _lines(spark, path, columns, sep, header)
    if unix:
        ts = F.timestamp_seconds(F.col("datetime").try_cast("double"))
    elif time_format:
        ts = F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit(f"{date_format} {time_format}"))
    else:
        ts = F.try_to_timestamp(F.col("datetime"), F.lit(date_format))
    out = _named(raw, symbol, ts, {f: _number(F.col(f), null) for f in FIELDS if f in columns}).where("ts is not null")
    if start:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return out


def bar_csv(spark: SparkSession, path: str | list[str], symbol: str | Column = "data", with_time: bool = False) -> DataFrame:
    """date[,time],open,high,low,close,volume,openinterest."""
    cols = ["date", "time", *FIELDS] if with_time else ["datetime", *FIELDS]
    return generic_csv(spark, path, symbol, cols, time_format="HH:mm:ss" if with_time else None)


def yahoo_csv(spark: SparkSession, path: str | list[str], symbol: str | Column = "data", adjust: bool = True, adjust_volume: bool = True, decimals: int | None = None, swap: bool = False) -> DataFrame:
    """Date,Open,High,Low,Close,Adj Close,Volume. Adjusted prices are times
    adj / close and the volume over it; ``swap`` takes the two closes for each
    other. Any order of rows is fine."""
    raw = _lines(spark, path, ["date", "open", "high", "low", "close", "adj", "volume"])
    n = {c: _number(F.col(c), "null") for c in ("open", "high", "low", "close", "adj", "volume")}
    if swap:
        n["close"], n["adj"] = n["adj"], n["close"]
    f = F.when(n["close"] != 0, n["adj"] / n["close"]).otherwise(1.0) if adjust else F.lit(1.0)
    near = (lambda x: F.round(x, decimals)) if decimals is not None else (lambda x: x)
    cells = {c: near(n[c] * f) for c in ("open", "high", "low")} | {"close": near(n["adj"] if adjust else n["close"])}
    cells["volume"] = n["volume"] / f if adjust_volume else n["volume"]
    return _named(raw, symbol, F.try_to_timestamp("date", F.lit("yyyy-MM-dd")), cells).where("ts is not null and close is not null")


def mt4_csv(spark: SparkSession, path: str | list[str], symbol: str | Column = "data", date_format: str = "yyyy.MM.dd", time_format: str = "HH:mm") -> DataFrame:
    """date,time,open,high,low,close,volume without a header; highs and lows are
    widened to hold open and close."""
    cols = ["date", "time", "open", "high", "low", "close", "volume"]
    b = generic_csv(spark, path, symbol, cols, date_format, time_format, header=False)
    return b.withColumns({"high": F.greatest("open", "high", "low", "close"), "low": F.least("open", "high", "low", "close")})


def sierra_csv(spark: SparkSession, path: str | list[str], symbol: str | Column = "data", date_format: str = "yyyy/M/d", time_format: str = "HH:mm:ss", validate: bool = True) -> DataFrame:
    """Date, Time, Open, High, Low, Last, Volume, ...; rows whose high and low
    don't hold open and close are dropped."""
    b = generic_csv(spark, path, symbol, ["date", "time", "open", "high", "low", "close", "volume"], date_format, time_format)
    sound = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))
    return b.where(sound) if validate else b


def sierra_ticks(spark: SparkSession, path: str | list[str], symbol: str | Column = "data", seconds: int = 60, date_format: str = "yyyy/M/d", time_format: str = "HH:mm:ss.SSSSSS", validate: bool = True, outliers: float | None = None) -> DataFrame:
    """Date, Time, Last, Volume, Bid, Ask of each trade, as bars of ``seconds``. Ticks
    whose bid is above their ask are dropped, as are those without a readable time or price, and those more than ``outliers``
    standard deviations from the mean of their symbol, if asked for."""
    raw = _lines(spark, path, ["date", "time", "price", "volume", "bid", "ask"])
    s = F.lit(symbol) if isinstance(symbol, str) else symbol
    ts = F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit(f"{date_format} {time_format}"))
    ticks = raw.select(s.alias("symbol"), ts.alias("ts"), *[_number(F.col(c)).alias(c) for c in ("price", "volume", "bid", "ask")]).where("ts is not null and price is not null")
    if validate:
        ticks = ticks.where(~F.coalesce((F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("bid") > F.col("ask")), F.lit(False)))
    if outliers is not None:
        about = ticks.groupBy(F.col("symbol").alias("_s")).agg(F.avg("price").alias("_mean"), F.stddev_pop("price").alias("_std"))
        ticks = ticks.join(about, F.col("symbol").eqNullSafe(F.col("_s"))).where(F.abs(F.col("price") - F.col("_mean")) <= outliers * F.col("_std"))
    return from_ticks(ticks, "symbol", "ts", "price", "second", seconds, volume="volume", ties=("price",))


def chart_csv(spark: SparkSession, path: str | list[str], intraday: bool = False) -> DataFrame:
    """ticker,period,date,time,open,high,low,close,volume,openinterest export;
    the symbol is the file's own."""
    cols = ["ticker", "period", "date", "time", *FIELDS]
    raw = _lines(spark, path, cols, header=False)
    at = F.concat_ws(" ", "date", F.lpad("time", 6, "0")) if intraday else F.col("date")
    ts = F.try_to_timestamp(at, F.lit("yyyyMMdd HHmmss" if intraday else "yyyyMMdd"))
    return _named(raw, F.col("ticker"), ts, {f: _number(F.col(f)) for f in FIELDS}).where("ts is not null")


def quandl_csv(spark: SparkSession, path: str | list[str], symbol: str | Column = "data", adjust: bool = True) -> DataFrame:
    """Date,Open,High,Low,Close,Volume,Ex-Dividend,Split Ratio and the adjusted
    five; the adjusted ones are taken unless told not to. Any order of rows."""
    five = ("open", "high", "low", "close", "volume")
    raw = _lines(spark, path, ["date", *five, "dividend", "split", *[f"adj_{c}" for c in five]])
    cells = {c: _number(F.col(f"adj_{c}" if adjust else c)) for c in five}
    return _named(raw, symbol, F.try_to_timestamp("date", F.lit("yyyy-MM-dd")), cells).where("ts is not null")


#: Records of the binary chart format: little-endian, 4 bytes a field.
CHART_DAY = [("day", "<u4"), ("open", "<f4"), ("high", "<f4"), ("low", "<f4"), ("close", "<f4"), ("volume", "<u4"), ("openinterest", "<u4")]
CHART_MINUTE = [CHART_DAY[0], ("second", "<u4"), *CHART_DAY[1:]]


def chart_binary(spark: SparkSession, path: str | list[str], intraday: bool = False) -> DataFrame:
    """Binary chart files: fixed records whose day is 500 times the year, 32
    times the month and the day of the month added up, with the second of the
    day if ``intraday``. The symbol is the file's name; an unfinished record at
    the end is left out. A file is read by one task."""
    kind = np.dtype(CHART_MINUTE if intraday else CHART_DAY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = np.frombuffer(data[: len(data) // kind.itemsize * kind.itemsize], dtype=kind)
                symbol = pa.array([name.rsplit("/", 1)[-1].rsplit(".", 1)[0]] * len(rows), pa.string())
                second = rows["second"] if intraday else np.zeros(len(rows))
                yield pa.RecordBatch.from_arrays([symbol, pa.array(rows["day"].astype(np.int32)), pa.array(second.astype(np.int32)), *[pa.array(rows[f].astype(float)) for f in FIELDS]], ["symbol", "day", "second", *FIELDS])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = raw.mapInArrow(run, "symbol string, day int, second int, " + ", ".join(f"{f} double" for f in FIELDS))
    date = F.make_date(F.floor(F.col("day") / 500).cast("int"), F.floor(F.col("day") % 500 / 32).cast("int"), F.col("day") % 500 % 32)
    return rows.select("symbol", F.timestamp_seconds(F.unix_seconds(date.cast("timestamp")) + F.col("second")).alias("ts"), *FIELDS)


def frame(df: DataFrame, rename: dict[str, str] | None = None, symbol: str = "data") -> DataFrame:
    """Any DataFrame as bars: columns are found by name whatever their case, or
    by ``rename``."""
    known = {c.lower(): c for c in df.columns}
    names = {"date": "ts", "datetime": "ts", "timestamp": "ts", "ticker": "symbol", "vol": "volume", "adj close": "close"} if "close" not in known else {"date": "ts", "datetime": "ts", "timestamp": "ts", "ticker": "symbol", "vol": "volume"}
    for low, c in known.items():
        target = (rename or {}).get(c, names.get(low, low))
        if target != c and (target not in df.columns or target.lower() == c.lower()):
            df = df.withColumnRenamed(c, target)
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.lit(symbol))
    return clean(df.withColumn("ts", F.col("ts").cast("timestamp")))


def jdbc(spark: SparkSession, url: str, table: str, rename: dict[str, str] | None = None, **options: str) -> DataFrame:
    """Bars from a database table; bounds and partitioning go by options."""
    return frame(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), rename)


def measurement(points: DataFrame, time: str = "ts", fields: dict[str, str] | None = None, tags: dict[str, str] | None = None, start: str | None = None, end: str | None = None, unit: str | None = None, n: int = 1, most: int | None = None) -> DataFrame:
    """A time-series query: tag and time filters, then the fields, by windows of
    ``n`` units if given, in order of time and at most so many rows. Filters are
    plain comparisons, which Spark pushes down to the files."""
    q = points
    for k, v in (tags or {}).items():
        q = q.where(F.col(k) == v)
    if start:
        q = q.where(F.col(time) >= F.lit(start).cast("timestamp"))
    if end:
        q = q.where(F.col(time) < F.lit(end).cast("timestamp"))
    if unit:
        aggs = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
        q = q.groupBy(bucket(F.col(time), unit, n).alias("ts")).agg(*[aggs[a](c).alias(f"{a}_{c}") for c, a in (fields or {}).items()])
    else:
        q = q.select(F.col(time).alias("ts"), *[F.col(c) for c in (fields or {})])
    q = q.orderBy("ts")
    return q.limit(most) if most else q


def between(bars: DataFrame, start: str | None = None, end: str | None = None, opens: str | None = None, closes: str | None = None) -> DataFrame:
    """Bars of some dates, and of some times of day, bounds included."""
    out = bars
    if start:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    day = F.date_format("ts", "HH:mm:ss")
    if opens:
        out = out.where(day >= opens)
    return out.where(day <= closes) if closes else out


def together(*feeds: DataFrame) -> DataFrame:
    """Feeds of different symbols as one frame."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str, sep: str = ",", keep_nan: bool = False, digits: int | None = None) -> None:
    """A CSV folder with a header, in order of symbol and time; missing values
    are empty, or "nan"."""
    for c, kind in df.dtypes:
        if kind == "double" and digits is not None:
            df = df.withColumn(c, F.round(c, digits))
    order = [c for c in ("symbol", "ts") if c in df.columns]
    df = df.orderBy(*order) if order else df
    df.write.mode("overwrite").csv(path, sep=sep, header=True, nullValue="nan" if keep_nan else "", timestampFormat="yyyy-MM-dd HH:mm:ss.SSS")
