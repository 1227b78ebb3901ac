"""Strategies, order states, rolling machines."""

import datetime as dt
from collections import namedtuple

import numpy as np
import pytest

from tideloom.operators import rolling
from tideloom.operators.broker import Commission, Rules
from tideloom.operators.strategy import Session, Strategy, orders, run_strategy

Bar = namedtuple("Bar", "ts open high low close volume k")
T = dt.datetime(2024, 1, 1)


def bars(*cells):
    """(open, high, low, close) a day."""
    return [Bar(T + dt.timedelta(i), *map(float, c), 100.0, i) for i, c in enumerate(cells)]


class Plan(Strategy):
    """Does what it is told on each bar, and notes what it hears."""

    def start(self):
        self.heard, self.trades, self.made = [], [], {}

    def notify_order(self, order, status):
        self.heard.append((order.id, status))

    def notify_trade(self, trade):
        self.trades.append(trade)

    def next(self, bar):
        act = self.params["do"].get(bar.k)
        if act:
            self.made[bar.k] = act(self, bar)


def played(do, rows, rules=Rules(cash=1e6)):
    s = Session(Plan, rules, {"do": do})
    out = [s.step(None, b) for b in rows]
    return s, out


FLAT = (10, 11, 9, 10)


def states(out):
    return [[(e[0], e[3]) for e in o[6]] for o in out]


def test_market_order_is_filled_on_the_next_bar_and_told():
    s, out = played({0: lambda p, b: p.buy(2)}, bars(FLAT, (12, 13, 11, 12)))
    assert states(out) == [[(1, "Submitted"), (1, "Accepted")], [(1, "Completed")]]
    assert out[1][4] == [(1, 2.0, 12.0, 0.0, 0.0)] and out[1][2:4] == (2.0, 12.0)
    assert s.strategy.heard == [(1, "Submitted"), (1, "Accepted"), (1, "Completed")]


def test_bracket_stop_cancels_target():
    do = {0: lambda p, b: p.bracket(1, 8.0, 15.0)}
    s, out = played(do, bars(FLAT, FLAT, FLAT, (9, 9.5, 7, 8), FLAT))
    assert states(out) == [[(1, "Submitted"), (1, "Accepted"), (2, "Submitted"), (3, "Submitted")], [(1, "Completed"), (2, "Accepted"), (3, "Accepted")], [], [(2, "Completed"), (3, "Canceled")], []]
    assert s.strategy.trades[0].pnl == -2.0 and out[4][2] == 0.0


def test_children_sleep_on_the_bar_of_their_parent():
    do = {0: lambda p, b: p.bracket(1, 8.0, 15.0)}
    _, out = played(do, bars(FLAT, (10, 20, 5, 10), (10, 16, 9, 10)))
    assert states(out)[1] == [(1, "Completed"), (2, "Accepted"), (3, "Accepted")]
    assert states(out)[2] == [(3, "Completed"), (2, "Canceled")]


def test_expired_parent_takes_children_along():
    do = {0: lambda p, b: p.bracket(1, 1.0, 15.0, "Limit", 5.0, bars=2)}
    _, out = played(do, bars(FLAT, FLAT, FLAT, (4, 5, 3, 4)))
    assert states(out)[3] == [(1, "Expired"), (2, "Canceled"), (3, "Canceled")] and out[3][2] == 0.0


def test_until_a_time():
    do = {0: lambda p, b: p.buy(1, "Limit", 5.0, until=T + dt.timedelta(1))}
    _, out = played(do, bars(FLAT, FLAT, (4, 5, 3, 4)))
    assert states(out)[2] == [(1, "Expired")]


def test_trailing_stop_follows_one_way():
    do = {0: lambda p, b: p.buy(1), 1: lambda p, b: p.order(-1, "StopTrail", trail=2.0)}
    rows = bars(FLAT, FLAT, (10, 15, 9, 14), (14, 14, 13, 13), (13, 13, 11.5, 12))
    s, out = played(do, rows)
    assert out[4][4] == [(2, -1.0, 12.0, 0.0, 2.0)]  # 14 - 2; the fall to 13 doesn't lower it
    assert s.strategy.trades[0].pnl == 2.0


def test_trailing_percent_and_short_side():
    do = {0: lambda p, b: p.sell(1), 1: lambda p, b: p.order(1, "StopTrail", trail_percent=50.0)}
    _, out = played(do, bars(FLAT, FLAT, (10, 10, 4, 4), (4, 6.5, 4, 6)))
    assert out[3][4][0][2] == 6.0


def test_trailing_limit_keeps_its_distance():
    do = {0: lambda p, b: p.buy(1), 1: lambda p, b: p.order(-1, "StopTrailLimit", 8.0, 7.5, trail=2.0)}
    _, out = played(do, bars(FLAT, FLAT, (10, 20, 10, 20), (18, 18, 17, 17.6)))
    assert out[3][4][0][2] == 17.5


def test_margin_reject_cancel_and_partial():
    rules = Rules(cash=100.0, fill_percent=5.0)
    do = {0: lambda p, b: p.buy(50), 1: lambda p, b: p.buy(8), 3: lambda p, b: p.cancel(p.made[1]), 4: lambda p, b: p.order(-1, "Stop", 5.0, parent=p.made[1])}
    _, out = played(do, bars(*[FLAT] * 6), rules)
    assert states(out) == [[(1, "Submitted"), (1, "Margin")], [(2, "Submitted"), (2, "Accepted")], [(2, "Partial")], [(2, "Completed")], [(3, "Rejected")], []]
    do = {0: lambda p, b: p.buy(8, "Limit", 1.0), 1: lambda p, b: p.cancel(p.made[0])}
    assert states(played(do, bars(*[FLAT] * 3))[1])[1] == [(1, "Canceled")]


def test_sizer_target_and_close():
    rules = Rules(cash=1000.0, sizer=lambda cash, price, held, size: cash // price // 2)
    do = {0: lambda p, b: p.buy(), 1: lambda p, b: p.target(20), 2: lambda p, b: p.target(20), 3: lambda p, b: p.close(), 4: lambda p, b: p.close()}
    s, out = played(do, bars(*[FLAT] * 6), rules)
    assert [o[2] for o in out] == [0, 50, 20, 20, 0, 0] and s.strategy.made[2] is None


def test_memory_goes_on_where_it_was():
    import pickle

    from pyspark import cloudpickle

    rules = Rules(cash=1e6, commission=Commission(0.001), filler=lambda left, *rest: left)
    do = {0: lambda p, b: p.bracket(1, 8.0, 15.0), 4: lambda p, b: p.buy(3)}
    rows = bars(FLAT, FLAT, FLAT, (9, 9.5, 7, 8), FLAT, FLAT)
    whole = [Session.step(s, None, b) for s in [Session(Plan, rules, {"do": do})] for b in rows]
    parts, s = [], Session(Plan, rules, {"do": do})
    for b in rows:
        parts.append(s.step(None, b))
        s = Session.remembered(pickle.loads(cloudpickle.dumps(s.memory())), rules)
    assert parts == whole


class Nothing(Strategy):
    pass


def test_frames_with_nulls_and_several_feeds(spark):
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, cash double"
    rows = [(x, T + dt.timedelta(i), 10.0, 11.0, 9.0, 10.0, None, 1.0) for x in ("a", None) for i in range(3)] + [("a", T + dt.timedelta(9), None, 1.0, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, schema)
    out = run_strategy(df, Nothing)
    assert out.count() == 6 and {r.cash for r in out.collect()} == {10_000.0}
    assert orders(out).count() == 0 and run_strategy(df.limit(0), Nothing).count() == 0
    both = run_strategy(df.selectExpr("1 AS p", "*"), Buyer, by=("p",), feed="symbol")
    last = {r.symbol: r for r in both.collect() if r.ts == T + dt.timedelta(2)}
    assert last["a"].cash == last[None].cash == 10_000.0 - 20.0 and last["a"].position == 1.0


class Buyer(Strategy):
    def next(self, bar):
        if not self.position() and not self.pending():
            self.buy()


@pytest.mark.parametrize("n", [1, 3, 7])
def test_rolling_equals_windows(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 20, 200).astype(float)
    x[rng.random(200) < 0.05] = np.nan
    mean, top, low = rolling.Mean(n).push(x), rolling.Extreme(n).push(x), rolling.Extreme(n, False).push(x)
    for i in range(len(x)):
        w = x[i - n + 1 : i + 1]
        if i + 1 < n or np.isnan(w).any():
            assert np.isnan([mean[i], top[i], low[i]]).all()
        else:
            assert mean[i] == pytest.approx(w.mean()) and top[i] == w.max() and low[i] == w.min()
