"""Recursions in pieces against the folds."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from tideloom.operators import affine, folds
from tideloom.operators.frame import Bars

SCHEMA = "symbol string, ts timestamp, high double, low double, close double, _x string"


@pytest.fixture(scope="module")
def series(spark):
    r = random.Random(3)
    rows = []
    for symbol, length in (("hot", 500), ("b", 60), ("short", 5), (None, 90)):
        t = dt.datetime(2024, 1, 1)
        for i in range(length):
            t += dt.timedelta(hours=r.choice([1, 5, 30, 400]))
            c = 100.0 if symbol == "b" and i < 40 else 100 + r.gauss(0, 5)
            rows.append((symbol, t, c + r.random(), c - r.random(), c, "x"))
    r.shuffle(rows)
    return Bars(spark.createDataFrame(rows, SCHEMA).drop("_x"))


def table(b, *columns):
    return {(x["symbol"], x["ts"]): tuple(x[c] for c in columns) for x in b.df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for key, row in a.items():
        for u, v in zip(row, b[key], strict=True):
            assert (u is None) == (v is None) and (u is None or math.isclose(u, v, rel_tol=1e-8, abs_tol=1e-8)), (key, row, b[key])


def test_composition():
    r = np.random.default_rng(1)
    a, b = r.normal(size=(37, 3, 3)) / 2, r.normal(size=(37, 3))
    got_a, got_b = affine.composed(a, b)
    y = start = r.normal(size=3)
    for i in range(37):
        y = a[i] @ y + b[i]
        assert np.allclose(got_a[i] @ start + got_b[i], y)


@pytest.mark.parametrize("rows", [7, 31, 100_000])
def test_kama(series, rows):
    want = table(folds.fold(series, [(lambda: folds.Kama(6), ["close"], ["v"])]), "v")
    same(table(affine.kama(series, 6, out="v", rows=rows), "v"), want)


def test_kama_stepped_and_nulls(series):
    from pyspark.sql import functions as F

    holes = Bars(series.df.withColumn("close", F.when(F.hour("ts") % 5 != 2, F.col("close"))))
    want = table(folds.fold(holes, [(lambda: folds.Kama(4, stepped=True), ["close"], ["v"])]), "v")
    same(table(affine.kama(holes, 4, out="v", stepped=True, rows=11, unit="day"), "v"), want)


@pytest.mark.parametrize("n", [1, 6])
def test_laguerre(series, n):
    want = table(folds.fold(series, [(lambda: folds.Laguerre(0.7, n), ["close"], ["f", "r"])]), "f", "r")
    same(table(affine.laguerre(series, 0.7, n, out="f", rsi="r", rows=17), "f", "r"), want)


@pytest.mark.parametrize("rows", [20, 100_000])
def test_directional(series, rows):
    names = ["adx", "adxr", "plus_di", "minus_di"]
    want = table(folds.fold(series, [(lambda: folds.Directional(5), ["high", "low", "close"], names)]), *names)
    same(table(affine.directional(series, 5, rows=rows), *names), want)


def test_empty(series):
    assert affine.kama(Bars(series.df.limit(0)), 3).df.count() == 0
