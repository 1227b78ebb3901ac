"""Averages in blocks of time against the folds."""

import datetime as dt
import math
import random

import pytest

from tideloom.operators import blocks, folds
from tideloom.operators.frame import Bars

SCHEMA = "symbol string, ts timestamp, close double, extra string"


def series(spark, n=400):
    """One symbol with most rows, short ones, one without a name, one of nulls; gaps in time and values."""
    r = random.Random(5)
    rows = []
    for symbol, length in (("hot", n), ("b", 45), ("short", 3), (None, 40), ("nulls", 20)):
        t = dt.datetime(2024, 1, 1)
        for _ in range(length):
            t += dt.timedelta(hours=r.choice([1, 5, 30, 400]))
            rows.append((symbol, t, None if symbol == "nulls" or r.random() < 0.1 else 100 + r.gauss(0, 5), "x"))
    r.shuffle(rows)
    return Bars(spark.createDataFrame(rows, SCHEMA))


def table(b, *columns):
    return {(x["symbol"], x["ts"]): tuple(x[c] for c in columns) for x in b.df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for key, row in a.items():
        for u, v in zip(row, b[key], strict=True):
            assert (u is None) == (v is None) and (u is None or math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9)), (key, row, b[key])


@pytest.mark.parametrize("unit", ["day", "month", "year"])
def test_averages(spark, unit, monkeypatch):
    monkeypatch.setattr(blocks, "RANGE", 3.0 if unit == "year" else 600.0)  # many pieces a block
    b = series(spark)
    got = blocks.averages(b, [blocks.Average("close", 10, "e"), blocks.Average("close", 14, "s", 1 / 14), blocks.Average("close", 5, "f", 0.9), blocks.Average("close", 1, "one")], unit)
    assert got.df.columns == [*b.df.columns, "one", "e", "s", "f"]
    want = folds.fold(b, [(lambda: folds.Ema(10), ["close"], ["e"]), (lambda: folds.Smma(14), ["close"], ["s"]), (lambda: folds.Ema(5, 0.9), ["close"], ["f"]), (lambda: folds.Ema(1), ["close"], ["one"])])
    same(table(got, "e", "s", "f", "one"), table(want, "e", "s", "f", "one"))


def test_rsi_and_macd(spark):
    b = series(spark)
    same(table(blocks.rsi(b, unit="week"), "rsi"), table(folds.fold(b, [(folds.Rsi, ["close"], ["rsi"])]), "rsi"))
    names = ("macd", "macd_signal", "macd_histo")
    same(table(blocks.macd(b, unit="day"), *names), table(folds.fold(b, [(folds.Macd, ["close"], list(names))]), *names))


def test_empty(spark):
    b = Bars(spark.createDataFrame([], SCHEMA))
    assert blocks.ema(b).df.collect() == [] and blocks.rsi(b).df.columns[-1] == "rsi"
