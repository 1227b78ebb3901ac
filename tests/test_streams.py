"""Machines on streams against the same machines on tables."""

import datetime as dt
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideloom.functions import dates
from tideloom.operators import folds, resample
from tideloom.operators.frame import Bars
from tideloom.plans.streams import streamed
from tideloom.streaming import replay, state

T = dt.datetime(2024, 1, 1)
TICKS = "symbol string, ts timestamp, close double"


def rows(spark, cells, schema=TICKS):
    return spark.createDataFrame([(s, T + dt.timedelta(minutes=m), None if v is None else float(v)) for s, m, v in cells], schema)


def test_order_of_arrival_does_not_matter_and_late_rows_stay_out(spark):
    cells = [(s, 10 * i, None if i == 4 else i * i % 17) for s in ("a", None) for i in range(12)]
    odd, even = [c for c in cells if c[1] // 10 % 2], [c for c in cells if not c[1] // 10 % 2]
    parts = [odd, even, [("z", 10_000, 1)], [("a", 15, 99)], [("z", 20_000, 1)]]
    steps = [(lambda: folds.Ema(3), ["close"], ["ema"])]
    out = streamed([{"x": rows(spark, p)} for p in parts], lambda x: state.folded(x, steps, late="2 hours"))
    got = sorted(((r.symbol or "", r.ts, r.ema) for r in out.where("symbol is null or symbol != 'z'").collect()), key=str)
    want = folds.fold(Bars(rows(spark, cells)), steps).df
    assert got == sorted(((r.symbol or "", r.ts, r.ema) for r in want.collect()), key=str)


class Given:
    """How many rows it is given at once."""

    def push(self, x):
        return np.full(len(x), float(len(x)))


def test_a_machine_is_never_given_all_rows_of_a_key(spark):
    n = 25_000
    r = random.Random(1)
    cells = [("a", i / 50, i) for i in r.sample(range(n), n)]
    parts = [cells[: n // 2], cells[n // 2 :], [("z", 100_000, 1)]]
    steps = [(Given, ["close"], ["given"]), (lambda: folds.Ema(3), ["close"], ["ema"])]
    out = streamed([{"x": rows(spark, p)} for p in parts], lambda x: state.folded(x, steps, late="30 days")).where("symbol = 'a'").orderBy("ts").collect()
    assert [x.close for x in out] == list(range(n))
    assert max(x.given for x in out) <= state.AT_ONCE < n
    want = folds.fold(Bars(rows(spark, cells)), steps[1:]).df.orderBy("ts").collect()
    assert [x.ema for x in out] == [x.ema for x in want]


class Value:
    def __init__(self):
        self.now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    def update(self, value):
        self.now = value


class Map:
    def __init__(self):
        self.now = {}

    def containsKey(self, key):
        return key in self.now

    def getValue(self, key):
        return self.now[key]

    def updateValue(self, key, value):
        self.now[key] = value

    def removeKey(self, key):
        del self.now[key]

    def keys(self):
        return iter(list(self.now))


def processor(made):
    timers = set()
    made.init(SimpleNamespace(getValueState=lambda *_: Value(), getMapState=lambda *_: Map(), registerTimer=timers.add))
    return made, timers


def frames(order, n):
    """Frames of rows a millisecond apart, in an order of arrival, one at a time."""
    for at in range(0, len(order), n):
        yield pd.DataFrame({"us_": [1000 * i for i in order[at : at + n]], "x": [float(i) for i in order[at : at + n]]})


def test_a_timer_keeps_one_row_however_many_come():
    p, timers = processor(state.AtTimes(lambda us: -(-us // 40_000_000) * 40_000_000, ("us_", "x"), ("symbol", "at", "last", "x", "n")))
    n = 200_000
    order = random.Random(1).sample(range(1, n + 1), n)
    tracemalloc.start()
    for half in (order[: n // 2], order[n // 2 :]):
        list(p.handleInputRows(("a",), frames(half, 5000), None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # all rows as tuples are over 20 MB
    assert timers == {40_000 * k for k in range(1, 6)} and len(p.timers.now) == 5
    for ms in sorted(timers):
        (got,) = p.handleExpiredTimer(("a",), None, SimpleNamespace(getExpiryTimeInMs=lambda ms=ms: ms))
        assert got.values.tolist() == [["a", ms * 1000, ms * 1000, float(ms), 40_000]]
    assert not p.timers.now


def test_rows_that_wait_are_read_in_blocks():
    class Seen:
        def rows(self, due):
            return due

        def memory(self):
            return None

        def remember(self, memory):
            pass

    p, timers = processor(state.InOrder(lambda key: Seen(), ("us_", "x"), ("symbol", "us_", "x")))
    n = 200_000
    order = random.Random(1).sample(range(1, n + 1), n)
    list(p.handleInputRows(("a",), frames(order, 5000), None))
    assert timers == {1}
    got, peaks = [], []
    for until in (n // 2 + 1, n):
        tracemalloc.start()
        for f in p.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda until=until: until), None):
            peaks.append(tracemalloc.get_traced_memory()[1])
            got += f["us_"].tolist() and [(f["us_"].iloc[0], f["us_"].iloc[-1], len(f), bool(f["us_"].is_monotonic_increasing))]
        tracemalloc.stop()
        assert until == n or timers == {1, until + 1}
    assert got[0][0] == 1000 and got[-1][1] == 1000 * n and all(x[3] for x in got)
    assert all(b[0] == a[1] + 1000 for a, b in zip(got, got[1:], strict=False)) and sum(x[2] for x in got) == n
    assert max(peaks) < 12 << 20 and not p.blocks.now


def test_timers_of_rows_that_come_in_several_parts(spark):
    at = state.day_times(17 * 3_600_000_000)
    a, b = [("a", 60, 1), ("a", 17 * 60, 2), ("a", 17 * 60 + 1, 3)], [("a", 17 * 60, 9), ("a", 30, 7), ("a", 40, None)]
    parts = [a, b, [("z", 100_000, 1)], [("a", 5, 99)], [("z", 200_000, 1)]]
    out = streamed([{"x": rows(spark, p)} for p in parts], lambda x: state.timed(x, at, x="close", late="10 days")).where("symbol = 'a'")
    five = T + dt.timedelta(hours=17)
    assert sorted(map(tuple, out.collect())) == [("a", five, five, 9.0, 4), ("a", five + dt.timedelta(1), five + dt.timedelta(minutes=1), 3.0, 1)]


def test_times_of_day():
    at = state.day_times(17 * 3_600_000_000, range(1, 6))
    us = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    friday = dt.datetime(2024, 1, 5)
    assert at(us(friday)) == us(friday + dt.timedelta(hours=17)) == at(us(friday + dt.timedelta(hours=17)))
    assert at(us(friday + dt.timedelta(hours=17)) + 1) == us(dt.datetime(2024, 1, 8, 17))


def test_growing_bars_after_a_crash(spark, tmp_path):
    ticks = rows(spark, [("a", 7 * i, i % 5) for i in range(60)]).withColumnRenamed("close", "price")
    source = str(tmp_path / "in")

    def run(path, broken=False):
        stream = replay.growing(spark.readStream.schema(ticks.schema).parquet(source), "1 hour", "30 minutes")
        if not broken:
            replay.replay(stream, f"{path}/bars", f"{path}/state").awaitTermination()
            return

        def put(batch, number):
            batch.write.mode("overwrite").parquet(f"{path}/bars/batch={number}")
            raise RuntimeError("lost")

        q = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(put).start()
        with pytest.raises(Exception, match="lost"):
            q.awaitTermination()

    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    early = F.col("ts") < F.lit(T + dt.timedelta(hours=3, minutes=30))
    ticks.where(early).write.parquet(source)
    run(whole)
    run(broken)
    ticks.where(~early).write.mode("append").parquet(source)
    run(broken, True)
    run(broken)
    run(whole)
    a, b = (sorted(map(tuple, replay.table(spark, f"{p}/bars", "30 minutes").collect())) for p in (whole, broken))
    assert a == b and {x[-1] for x in a} == {True, False} and sum(x[6] for x in a) == 60
    assert max(x[-2] for x in a) == 2  # the bar that was open between the runs has two versions


def test_coupled_equals_asof(spark):
    fast = rows(spark, [("a", 10 * i, i) for i in range(8)] + [("b", 5, 1)])
    slow = rows(spark, [("a", 20, 100), ("a", 45, 200), ("a", 60, 300)])
    end = [rows(spark, [("z", m, 0)]) for m in (10_000, 20_000)]
    parts = [{"fast": fast, "slow": slow.limit(0)}, {"fast": end[0], "slow": slow}, {"fast": end[0], "slow": end[0]}, {"fast": end[1], "slow": end[1]}]
    out = streamed(parts, lambda fast, slow: state.coupled(fast, slow)).where("symbol != 'z'")
    want = resample.asof(fast, slow, ["close"])
    assert sorted((r.symbol, r.ts, r.close, r.slow_close or 0) for r in out.collect()) == sorted((r.symbol, r.ts, r.close, r.slow_close or 0) for r in want.collect())


def test_session_bars(spark):
    day = lambda d, h, m: T + dt.timedelta(days=d - 1, hours=h, minutes=m)
    ticks = spark.createDataFrame([("x", day(2, 9, 0), 1.0), ("x", day(2, 9, 30), 2.0), ("x", day(2, 10, 59), 3.0), ("x", day(2, 15, 59), 4.0), ("x", day(2, 16, 0), 5.0), ("x", day(2, 16, 9), 6.0), ("x", day(2, 16, 11), 7.0), ("x", day(3, 12, 30), 8.0), ("x", day(3, 13, 1), 9.0), ("x", day(6, 12, 0), 9.0), ("x", day(4, 12, 0), None)], "s string, at timestamp, p double")
    days = dates.calendar_of(ticks, "at", early={"2024-01-03": "13:00:00"})
    assert days.count() == 4  # the 6th is a Saturday
    got = {(r.session.day, r.ts.strftime("%H:%M")): (r.open, r.close, r.volume, r.closes) for r in resample.session_bars(ticks, days, "s", "at", "p", 7200, take_late=600).collect()}
    assert got == {(2, "11:30"): (2.0, 3.0, 2.0, False), (2, "16:00"): (4.0, 6.0, 3.0, True), (3, "13:00"): (8.0, 9.0, 2.0, True)}
    whole = resample.session_bars(ticks, days, "s", "at", "p", edge="last").orderBy("ts").collect()
    assert [(r.ts.hour, r.ts.minute, r.high) for r in whole] == [(16, 0, 5.0), (12, 30, 8.0)]
    assert dates.calendar_of(ticks.limit(0), "at").count() == 0
