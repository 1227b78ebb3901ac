"""Readings of line pairs on small series."""

import datetime as dt

from pyspark.sql import functions as F

from tideloom.operators import readings
from tideloom.operators.frame import Bars

T = dt.datetime(2024, 1, 1)


def frame(spark, rows, symbol="x"):
    return Bars(spark.createDataFrame([(symbol, T + dt.timedelta(i), *map(lambda v: None if v is None else float(v), r)) for i, r in enumerate(rows)], "symbol string, ts timestamp, up double, down double, close double"))


def test_readings(spark):
    rows = [(None, 1, 1), (1.0, 1.25, 1), (1.3, 1.0, 1), (1.4, 1.0, 1), (1.5, 1.0, 1)]
    out = readings.readings(frame(spark, rows), "up", "down", lookback=2, n=3).df.orderBy("ts").collect()
    assert [round(x.trend_strength, 6) if x.trend_strength is not None else None for x in out] == [None, 0.25, 0.3, 0.4, 0.5]
    assert [x.trend_direction for x in out] == [None, -1.0, 1.0, 1.0, 1.0]
    assert [x.trend_grade for x in out] == [None, 3.0, 3.0, 4.0, 4.0]
    assert [x.trend_regime for x in out] == [None, None, None, "up", "up"]
    assert round(out[3].trend_momentum, 6) == 0.65


def test_validated_and_stats(spark):
    rows = [(0, 1, 10), (2, 1, 10), (2, 1, 12), (0, 1, 12), (0, 1, 15), (2, 1, 15)]
    (v,) = readings.validated(frame(spark, rows), "up", "down", hold=1).collect()
    assert (v.signals, v.correct, v.accuracy, round(v.best, 6), round(v.worst, 6)) == (2, 1, 0.5, 0.2, -0.25)
    (s,) = readings.line_stats(frame(spark, rows), "up", "down", 5).collect()
    assert (s.up_average, s.up_most, s.down_least, s.rises, s.falls) == (1.2, 2.0, 1.0, 1, 1)
    assert readings.line_stats(Bars(frame(spark, rows).df.limit(0)), "up", "down").count() == 0


def test_divergences(spark):
    rows = [(1, 0, 5), (3, 0, 2), (1, 0, 5), (0, 0, 9), (2, 0, 1)]
    out = readings.divergences(frame(spark, rows), F.col("up"), "close", 1).df.orderBy("ts").collect()
    assert [x.divergence for x in out] == [None, 1.0, 0.0, -1.0, None]
