"""Orders, positions, fees and the tables of a run."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideloom.operators import analyzers, broker
from tideloom.operators.broker import Account, Commission, Order, Position, Rules, matched


def test_position():
    p = Position()
    assert p.update(10, 10.0) == (10, 0.0)
    p.update(5, 12.5)
    assert p.size == 15 and p.price == pytest.approx((100 + 62.5) / 15)
    price = p.price
    assert p.update(-7, 14.5) == (0.0, -7) and (p.size, p.price) == (8, price)
    assert p.update(-15, 17.5) == (-7, -8) and p.price == 17.5
    assert p.update(7, 1.0) == (0.0, 7) and (p.size, p.price) == (0, 0.0)


def test_fees():
    stock = Commission(0.5)
    assert stock.cost(100, 10) == 1000 and stock.fee(100, 10) == 500
    future = Commission(2.0, 1000.0, 10.0)
    assert future.cost(3, 10) == 3000 and future.fee(3, 10) == 6 and future.pnl(2, 10, 11) == 20
    assert Commission(5.0, fixed=True).fee(100, 10) == 5 and Commission(0.0, minimum=1.0).fee(1, 1) == 1
    assert broker.crypto_fee(1000) == 1.0 and broker.crypto_fee(1000, 600_000, maker=True) == pytest.approx(0.6)


def test_matching():
    bar = {"high": 11.0, "low": 9.0, "open_": 10.0, "close": 10.5}
    assert matched(Order(1, 1), **bar) == 10.0 and matched(Order(1, 1, "Close"), **bar) == 10.5
    assert matched(Order(1, 1, "Limit", 9.5), **bar) == 9.5 and matched(Order(1, 1, "Limit", 8.0), **bar) is None
    assert matched(Order(1, -1, "Limit", 10.8), **bar) == 10.8 and matched(Order(1, -1, "Limit", 12.0), **bar) is None
    assert matched(Order(1, 1, "Stop", 10.8), **bar) == 10.8 and matched(Order(1, -1, "Stop", 8.0), **bar) is None
    assert matched(Order(1, 1, "StopLimit", 10.8, 10.9), **bar) == 10.9
    waits = Order(1, 1, "StopLimit", 12.0, 12.5)
    assert matched(waits, **bar, instant=False) is None and not waits.triggered
    above = {"high": 13.0, "low": 12.2, "open_": 12.6, "close": 12.9}
    assert matched(waits, **above, instant=False) is None and waits.triggered
    assert matched(waits, **above, instant=False) == 12.5
    assert matched(Order(1, 1, "StopLimit", 10.4, 10.6), **bar, instant=False) == 10.6


def test_sizers_and_fillers():
    assert broker.percent(1000, 10, 0) == 20 and broker.percent(1000, 10, -3) == 3 and broker.all_in(1005, 10, 0) == 100
    assert broker.reverser(0, 1, 5, 2) == 4 and broker.to_target(0, 1, 3, 10) == 7
    assert broker.fixed_size(10, 5) == 5 and broker.bar_percent(100, 30, 50) == 15 and broker.bar_points(100, 1000, 10, 9, 9.5, 0.1, 50) == 45


def test_account_by_hand():
    a = Account(Rules(cash=1000.0, commission=Commission(0.01)))
    a.next(1, 10, 11, 9, 10, 100, 5, None, None, None)
    assert a.cash == 1000.0
    a.next(2, 12, 13, 11, 12, 100, None, None, None, None)
    assert a.position.size == 5 and a.cash == pytest.approx(1000 - 60 - 0.6)
    cash, value, *_ = a.next(3, 12, 13, 11, 13, 100, -5, None, None, None)
    assert value == pytest.approx(cash + 65)
    *_, fills, trades = a.next(4, 14, 15, 13, 14, 100, None, None, None, None)
    assert fills == [(2, -5, 14, pytest.approx(0.7), pytest.approx(10.0))]
    assert trades[0][5:] == (pytest.approx(10.0), pytest.approx(10 - 1.3), 2)
    assert a.next(5, 14, 15, 13, 14, 100, 1000, None, None, None)[4] == 1  # more than the cash


def bars(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t + dt.timedelta(days=i), 10.0 + i, 11.0 + i, 9.0 + i, 10.5 + i, 100.0, {1: 2.0, 4: -1.0, 6: -1.0, 9: 5.0}.get(i)) for i in range(10)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, order double")


def test_run_tables(spark):
    result = broker.run(bars(spark)).cache()
    assert [(x["size"], x["price"]) for x in broker.fills(result).orderBy("ts").collect()] == [(2.0, 12.0), (-1.0, 15.0), (-1.0, 17.0)]
    (t,) = broker.trades(result).collect()
    assert (t["size"], t["pnl"], t["bars"]) == (2.0, 8.0, 5)
    assert result.orderBy(F.desc("ts")).first()["value"] == 10_008.0
    trips = analyzers.round_trips(broker.fills(result)).orderBy("sell_ts").collect()
    assert [(x["quantity"], x["pnl"]) for x in trips] == [(1.0, 3.0), (1.0, 5.0)]
    assert analyzers.sqn(broker.trades(result)).first()["sqn"] == 0.0
    assert broker.run(bars(spark).limit(0)).count() == 0


def test_drawdown(spark):
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([("a", t + dt.timedelta(days=i), float(v)) for i, v in enumerate([10, 12, 9, 6, 12, 11])], "symbol string, ts timestamp, value double")
    got = analyzers.drawdown(e).orderBy("ts").collect()
    assert [x["money"] for x in got] == [0, 0, 3, 6, 0, 1] and [x["length"] for x in got] == [0, 0, 1, 2, 0, 1]
    assert analyzers.max_drawdown(e).first()["drawdown"] == 50.0


def series(spark, rows):
    return spark.createDataFrame([(s, dt.datetime(2024, 1, d), *[float(p)] * 4, 100.0, o, k, x) for s, d, p, o, k, x in rows], "symbol string, ts timestamp, open double, high double, low double, close double, volume double, order double, order_type string, order_price double")


def test_portfolio_has_one_cash(spark):
    rows = [("a", 1, 10, 60.0, None, None), ("b", 1, 20, 30.0, None, None), ("a", 2, 11, None, None, None), ("b", 2, 20, 5.0, None, None), ("a", 3, 12, -60.0, None, None), ("b", 3, 21, None, None, None), ("a", 4, 12, None, None, None)]
    got = {(r["symbol"], r["ts"].day): r for r in broker.run_portfolio(series(spark, rows), Rules(cash=1000.0)).collect()}
    assert got["a", 2]["cash"] == 340 and got["a", 2]["value"] == 1000
    assert got["b", 2]["cash"] == -260 and got["b", 2]["value"] == 1000 and got["b", 2]["rejected"] == 1
    assert got["b", 2]["gross"] == pytest.approx(1260 / 1000)
    assert got["a", 4]["cash"] == 460 and got["a", 4]["value"] == 460 + 30 * 21
    two = series(spark, rows).withColumn("book", F.col("symbol"))
    apart = broker.run_portfolio(two, Rules(cash=1000.0), by=("book",))
    assert apart.where("symbol = 'b'").agg(F.min("cash")).first()[0] == 1000 - 30 * 20 - 5 * 21


def test_cancel_and_sizes(spark):
    rows = [("a", 1, 10, 5.0, "Limit", 8.0), ("a", 2, 9, None, "Cancel", None), ("a", 3, 7, None, None, None)]
    assert broker.fills(broker.run(series(spark, rows))).count() == 0
    kept = broker.fills(broker.run(series(spark, [rows[0], ("a", 2, 9, None, None, None), rows[2]]))).collect()
    assert [(r["size"], r["price"]) for r in kept] == [(5.0, 8.0)]
    rules = Rules(cash=1000.0, sizer=lambda cash, price, position, size: broker.percent(cash, price, position, 50.0), filler=lambda left, volume, high, low, price: broker.fixed_size(left, volume, 20.0))
    rows = [("a", 1, 10, 1.0, None, None)] + [("a", d, 10, None, None, None) for d in range(2, 6)]
    assert [r["size"] for r in broker.fills(broker.run(series(spark, rows), rules)).orderBy("ts").collect()] == [20.0, 20.0, 10.0]


def test_a_fill_of_a_million_shares_is_one_row(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, 1e6, 10.0), ("a", t + dt.timedelta(1), -4e5, 11.0), ("a", t + dt.timedelta(2), 1e5, 9.0), ("a", t + dt.timedelta(3), -7e5, 12.0), ("b", t, -5.0, 1.0)]
    got = analyzers.round_trips(spark.createDataFrame(rows, "symbol string, ts timestamp, size double, price double")).collect()
    assert sorted((r["buy_ts"].day, r["sell_ts"].day, r["quantity"], r["pnl"]) for r in got) == [(1, 2, 4e5, 4e5), (1, 4, 6e5, 1.2e6), (3, 4, 1e5, 3e5)]


def test_sweep_of_a_hundred_lengths(spark):
    from tideloom.plans import optimize

    r = [100 + (i * 37 % 41) - 20 for i in range(150)]
    bars = spark.createDataFrame([("a", dt.datetime(2024, 1, 1) + dt.timedelta(i), *[float(p)] * 4, 1.0) for i, p in enumerate(r)], "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    out = optimize.sweep(bars, list(range(2, 102)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("avg(") <= 2 * 100 and out.count() == 100
    one = optimize.backtest(bars, 20).orderBy(F.desc("ts")).first()["value"]
    assert out.where("period = 20").first()["value"] == pytest.approx(one)


def test_signed_sizers_slippage_rates_and_forex():
    assert [broker.reversing(0, 1, p, s) for p, s in ((0, 2), (5, 2), (5, -2), (-5, 2), (-5, -2))] == [2, 2, -4, 4, -2]
    assert [broker.to_target(0, 1, p, s, 5) for p, s in ((0, 10), (3, 10), (3, -10))] == [2, -1, -5] and broker.to_target(0, 1, 0, 1, 5) == 1
    r = broker.Rules(slip_percent=0.1, slip_fixed=5.0)
    assert r.slipped(10, True, 12, 9) == 11 and r.slipped(10, False, 12, 9.5) == 9.5
    assert broker.Rules(slip_fixed=5.0, slip_match=False).slipped(10, True, 12, 9) == 15 and broker.Rules().slipped(10, True, 1, 1) == 10
    c = broker.exchange("kraken", maximum=3.0)
    assert c.fee(2, 100, maker=True) == pytest.approx(0.32) and c.fee(-2, 100) == pytest.approx(0.52) and c.fee(100, 100) == 3.0
    assert broker.Commission(0.01, per_share=True).fee(-7, 50) == pytest.approx(0.07)
    f = broker.forex(2.0, 1000.0, 20.0, 10.0)
    assert f.held == f.cost(1, 5) == 50.0 and f.fee(3, 5) == 6.0
