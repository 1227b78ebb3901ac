"""Readers, filters, resampling and streams."""

import datetime as dt

from pyspark.sql import functions as F

from tideloom.functions import dates, lines
from tideloom.operators import filters, folds, resample
from tideloom.sources import readers
from tideloom.streaming import bars as streams

T = dt.datetime(2024, 1, 1, 9, 30)


def frame(spark, closes, step=60, symbol="a"):
    rows = [(symbol, T + dt.timedelta(seconds=step * i), *[float(c)] * 4, 1.0, 0.0) for i, c in enumerate(closes) if c is not None]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, openinterest double")


def test_readers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Date,Open,High,Low,Close,Volume,OpenInterest\n2024-01-02,1,3,0.5,2,10,0\nbad,1,1,1,1,1,1\n2024-01-03,2,x,1,3,,0\n")
    got = readers.bar_csv(spark, str(p), "q").orderBy("ts").collect()
    assert [(x["symbol"], x["close"], x["high"], x["volume"]) for x in got] == [("q", 2.0, 3.0, 10.0), ("q", 3.0, None, None)]
    p.write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-03,10,12,8,10,5,100\n2024-01-02,10,12,8,10,10,100\n")
    y = readers.yahoo_csv(spark, str(p)).orderBy(F.desc("ts")).first()
    assert (y["open"], y["high"], y["close"], y["volume"]) == (5.0, 6.0, 5.0, 200.0)
    p.write_text("2024.01.02,10:30,2,1,3,4,7\n")
    m = readers.mt4_csv(spark, str(p)).first()
    assert (m["high"], m["low"], m["ts"]) == (4.0, 1.0, dt.datetime(2024, 1, 2, 10, 30))
    p.write_text("Date,Time,Open,High,Low,Last,Volume\n2024/1/2,10:00:00,1,2,0,1,5\n2024/1/2,10:01:00,1,0,2,1,5\n")
    assert readers.sierra_csv(spark, str(p)).count() == 1
    p.write_text("SYM,1,20240102,93000,1,2,0,1,5,0\n")
    c = readers.chart_csv(spark, str(p), intraday=True).first()
    assert (c["symbol"], c["ts"]) == ("SYM", dt.datetime(2024, 1, 2, 9, 30))
    f = readers.frame(spark.createDataFrame([(T, 1.0, 2.0)], "Date timestamp, Close double, Vol double")).first()
    assert (f["symbol"], f["close"], f["volume"]) == ("data", 1.0, 2.0)
    out = str(tmp_path / "out")
    readers.write_csv(readers.bar_csv(spark, str(p)).limit(0).unionByName(frame(spark, [1, 2])), out, digits=2)
    assert spark.read.csv(out, header=True).count() == 2


def test_filters(spark):
    df = frame(spark, [1, 2, None, None, 5], 60)
    got = filters.fill(df, 60).orderBy("ts").collect()
    assert [(x["close"], x["volume"], x["filled"]) for x in got] == [(1, 1, False), (2, 1, False), (2, 0, True), (2, 0, True), (5, 1, False)]
    full = filters.session_fill(df, 60, "09:30:00", "09:36:00")
    assert full.count() == 7 and full.where("filled").count() == 4
    boxes = filters.renko(frame(spark, [10, 12.5, 11, 7]), 1.0).orderBy("ts", "box").collect()
    assert [x["close"] for x in boxes] == [11, 12, 11, 10, 9, 8, 7]
    kept = filters.day_steps(frame(spark, range(10), 86400), 3).orderBy("ts").collect()
    assert [x["close"] for x in kept] == [0, 3, 6, 9]
    holidays = spark.createDataFrame([(dt.date(2024, 1, 2),)], "date date")
    assert filters.calendar_days(frame(spark, range(8), 86400), holidays=holidays).count() == 5
    counted = folds.Counting(2, 3).push(__import__("numpy").array([1.0, 0, 1, 1, 0, 0, 0, 1]))
    assert counted.tolist() == [0, 0, 1, 0, 0, 0, 0, 0]


def test_feeds_together(spark):
    a, b = frame(spark, [1, 2, 3, 4]), frame(spark, [30, 40, 50, 60], 120)
    got = resample.asof(a, b, ["close"]).orderBy("ts").collect()
    assert [x["slow_close"] for x in got] == [30, 30, 40, 40]
    assert resample.chain([a, b]).count() == 6 and resample.chain([a, b], strict=False).count() == 8
    rolled = resample.roll_over([a, b.withColumn("volume", F.lit(5.0))]).orderBy("ts").collect()
    assert [x["contract"] for x in rolled] == [1, 1, 1, 1]
    assert resample.resample_ordinal(frame(spark, range(12), 86400), "week").count() == 3
    assert resample.align(a, b, ["close"], by_number=True).count() == 4


def test_dates_and_lines(spark):
    days = dates.calendar(spark, "2024-01-01", "2024-01-31", holidays=["2024-01-15"]).collect()
    assert len(days) == 22 and days[-1]["last_of_month"] and sum(d["last_of_week"] for d in days) >= 4
    row = spark.range(1).select(
        dates.num2date(dates.date2num(F.lit(T))).alias("t"), dates.num2time(F.lit(0.5)).alias("noon"),
        lines.lt(F.lit(float("nan")), F.lit(1.0)).alias("lt"), lines.ne(F.lit(float("nan")), F.lit(1.0)).alias("ne"), lines.div_zero_by_zero(F.lit(0.0), F.lit(0.0)).alias("zz"), lines.div_by_zero(F.lit(1.0), F.lit(0.0), 7.0).alias("z"),
    ).first()
    assert tuple(row) == (T, "12:00:00", 0.0, 1.0, 0.0, 7.0)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    ticks = spark.createDataFrame([("a", T + dt.timedelta(minutes=20 * i), float(i), i) for i in range(30)], "symbol string, ts timestamp, price double, n int")
    ticks.write.parquet(src)
    stream = spark.readStream.schema(ticks.schema).parquet(src)
    q = streams.tumbling(stream, "1 hour", "0 seconds").writeStream.outputMode("update").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("hours").groupBy("symbol", "ts").agg(F.max("volume")).count()
    assert got == streams.tumbling(ticks, "1 hour").count()


def _days(spark, symbol, first, n, volume):
    import datetime as dt

    return spark.createDataFrame([(symbol, dt.datetime(2024, 1, 1) + dt.timedelta(first + i), *[float(first + i)] * 4, float(volume(i)), 0.0) for i in range(n)], "symbol string, ts timestamp, open double, high double, low double, close double, volume double, openinterest double")


def test_roll_over_of_24_contracts(spark):
    from tideloom.operators import resample

    contracts = [_days(spark, "x", 10 * k, 25, lambda i: 100 - abs(i - 12) * 5) for k in range(24)]
    out = resample.roll_over(contracts)
    assert out._jdf.queryExecution().analyzed().toString().count("LogicalRDD") <= 4 * 24
    got = out.orderBy("ts").collect()
    assert len({r["ts"] for r in got}) == len(got) == 255
    # The next one has more volume from its seventh day after the middle of both on.
    turn = {r["contract"]: r["ts"] for r in reversed(got)}
    assert [(turn[k] - turn[0]).days for k in range(1, 24)] == [10 * (k - 1) + 18 for k in range(1, 24)]


def test_roll_over_passes_over_ended_contracts(spark):
    from tideloom.operators import resample

    out = resample.roll_over([_days(spark, "x", 0, 20, lambda i: 9), _days(spark, "x", 5, 5, lambda i: 1), _days(spark, "x", 10, 30, lambda i: 5)])
    assert [(r["contract"], r["n"]) for r in out.groupBy("contract").agg(F.count("*").alias("n")).orderBy("contract").collect()] == [(0, 20), (2, 20)]


def test_align_by_symbol(spark):
    from tideloom.operators import resample

    three = _days(spark, "a", 0, 5, lambda i: 1).unionByName(_days(spark, "b", 0, 5, lambda i: 2)).unionByName(_days(spark, "c", 2, 5, lambda i: 3))
    assert resample.align(three, three, ["volume"]).where("volume != volume2").count() == 0
    assert resample.align(three, three, ["volume"]).count() == 15
    out = resample.align(three, three, ["volume"], pairs=[("a", "b"), ("a", "c"), ("b", "c")])
    assert sorted((r["symbol"], r["symbol2"], r["n"]) for r in out.groupBy("symbol", "symbol2").agg(F.count("*").alias("n")).collect()) == [("a", "b", 5), ("a", "c", 3), ("b", "c", 3)]
    assert resample.align(three, three, ["close"], by_number=True, pairs=[("a", "c")]).count() == 5


def test_binary_charts(spark, tmp_path):
    import numpy as np

    day = np.zeros(3, dtype=np.dtype(readers.CHART_DAY))
    day["day"] = [2006 * 500 + 1 * 32 + 2, 2006 * 500 + 12 * 32 + 31, 2007 * 500 + 2 * 32 + 28]
    for i, f in enumerate(("open", "high", "low", "close", "volume", "openinterest")):
        day[f] = np.arange(3) + i
    (tmp_path / "ABC.fd").write_bytes(day.tobytes() + b"xx")
    got = readers.chart_binary(spark, str(tmp_path / "ABC.fd")).orderBy("ts").collect()
    assert [(r["symbol"], str(r["ts"])[:10], r["open"], r["openinterest"]) for r in got] == [("ABC", "2006-01-02", 0.0, 5.0), ("ABC", "2006-12-31", 1.0, 6.0), ("ABC", "2007-02-28", 2.0, 7.0)]
    minute = np.zeros(1, dtype=np.dtype(readers.CHART_MINUTE))
    minute["day"], minute["second"] = day["day"][0], 9 * 3600 + 1800
    (tmp_path / "X.min").write_bytes(minute.tobytes())
    assert str(readers.chart_binary(spark, str(tmp_path / "X.min"), intraday=True).first()["ts"]) == "2006-01-02 09:30:00"


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    _days(spark, "x", 0, 9, lambda i: i).select("symbol", F.col("ts").alias("at"), "open", "high", "low", "close", "volume").write.format("jdbc").options(url=url, dbtable="bars", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    got = readers.jdbc(spark, url, "bars", {"AT": "ts", "at": "ts"}, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").where("close >= 4")
    assert got.count() == 5 and set(got.columns) == {"symbol", "ts", "open", "high", "low", "close", "volume", "openinterest"}
