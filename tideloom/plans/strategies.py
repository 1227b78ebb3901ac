"""Queries of strategies that react to their orders, and their SQL: the machine's
state, a bar at a time, in recursive common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import broker
from ..operators.broker import Commission, Rules
from ..operators.frame import Bars
from ..operators.strategy import Strategy, orders, run_strategy
from ..operators.windows import crossover
from . import optimize
from .bars import Query, days, pairs
from .sql import ORDER, Sql, cross, mean
from .sql import pairs as pairs_sql
from .trading import BOOK, FEE, LONG, RICH, _r, booked, near

RULES = Rules(cash=RICH, commission=Commission(FEE))


class Doubling(Strategy):
    """Twice as much after a loss, up to ``most``; one after a gain."""

    def start(self) -> None:
        self.size = 1.0

    def notify_trade(self, trade) -> None:
        self.size = 1.0 if trade.pnlcomm > 0 else min(2 * self.size, self.params.get("most", 8.0))

    def next(self, bar) -> None:
        x = bar.cross or 0.0
        if x > 0 and not self.position():
            self.buy(self.size)
        elif x < 0 and self.position() > 0:
            self.close()


class Bracketed(Strategy):
    """Far below the close, for three bars; then a stop and a target."""

    def next(self, bar) -> None:
        if bar.k % 20 == 1 and not self.position() and not self.pending():
            self.bracket(1.0, bar.close * 0.06, bar.close * 2.2, "Limit", bar.close * 0.12, bars=3)


class Trailed(Strategy):
    """Bought every fifteenth bar; a stop follows the close."""

    def next(self, bar) -> None:
        if self.position() > 0 and not self.pending():
            self.order(-self.position(), "StopTrail", trail_percent=90.0)
        elif bar.k % 15 == 1 and not self.position() and not self.pending():
            self.buy()


class Rotation(Strategy):
    """Two feeds or more under one account: whatever closed above its mean is held,
    as long as nothing else is."""

    def start(self) -> None:
        self.holder = None

    def notify_order(self, order, status) -> None:
        if status == "Completed":
            self.holder = order.feed if order.size > 0 else None

    def next(self, bar) -> None:
        above = bar.mean is not None and bar.close > bar.mean
        if above and self.holder is None and not any(self.pending(f) for f in self._session.desks):
            self.buy(1.0)
        elif not above and self.holder == bar.symbol and not self.pending():
            self.close()


def crossing(bars: DataFrame, n: int = 15) -> DataFrame:
    b = Bars(bars)
    return crossover(b.put(_m=b.mean("close", n)), "close", "_m", "cross").tidy().df


def numbered(bars: DataFrame) -> DataFrame:
    b = Bars(bars)
    return b.put(k=b.number()).df


def _reactive(s: SparkSession, d: str) -> DataFrame:
    return near(run_strategy(crossing(days(s, d)), Doubling, RULES, ["cross"]).select("symbol", "ts", "cash", "value", "position"))


def _brackets(s: SparkSession, d: str) -> DataFrame:
    return near(orders(run_strategy(numbered(days(s, d)), Bracketed, RULES, ["k"])))


def _trailing(s: SparkSession, d: str) -> DataFrame:
    done = orders(run_strategy(numbered(days(s, d)), Trailed, RULES, ["k"])).where("status = 'Completed'")
    return near(done.select("symbol", "ts", F.col("order"), "kind", "size", "price"))


def _sweep(s: SparkSession, d: str) -> DataFrame:
    out = optimize.sweep_strategy(crossing(days(s, d)), Doubling, optimize.grid(most=[1.0, 4.0, 16.0]), RULES, ["cross"])
    return near(out, 6)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Seven portfolios by supplier."""
    return pairs(s, d, F.pmod("l_suppkey", F.lit(7)))


def _rotation(s: SparkSession, d: str) -> DataFrame:
    b = Bars(_pairs(s, d), ("portfolio", "symbol"))
    b = b.put(mean=b.mean("close", 15)).df.withColumn("feed", F.col("symbol"))
    out = run_strategy(b, Rotation, RULES, ["mean", "symbol"], ("portfolio",), "feed")
    return near(out.select("portfolio", F.col("feed").alias("symbol"), "ts", "cash", "value", "position"))


def _portfolios(s: SparkSession, d: str) -> DataFrame:
    told = optimize.mean_cross_orders(_pairs(s, d), 15, by=("portfolio", "symbol"))
    return near(broker.run_portfolio(told, LONG, ("portfolio",)).select("portfolio", "symbol", "ts", "cash", "value", "position", "gross"), 2)


def queries() -> dict[str, Query]:
    return {"exec_reactive": _reactive, "exec_brackets": _brackets, "exec_trailing": _trailing, "exec_sweep_strategy": _sweep, "exec_rotation": _rotation, "exec_portfolios": _portfolios}


def _doubling(most: float) -> Sql:
    s = Sql()
    s.put(_m=mean("close", 15))
    cross(s, "close", "_m", "x")
    pos, fee = "(r.position + r.want)", f"({FEE} * abs(r.want) * b.open)"
    net = f"((b.open - r.entry) * -r.want - r.paid - {fee})"
    size = f"(CASE WHEN r.want < 0 THEN CASE WHEN {net} > 0 THEN 1.0 ELSE least(2 * r.size, {most}) END ELSE r.size END)"
    first = {"cash": f"{RICH}", "position": "0", "want": "0", "entry": "0", "paid": "0", "size": "1", "sold": "0"}
    step = {
        "cash": f"r.cash - r.want * b.open - {fee}", "position": pos, "want": f"CASE WHEN b.x > 0 AND {pos} = 0 THEN {size} WHEN b.x < 0 AND {pos} > 0 THEN -{pos} ELSE 0 END",
        "entry": "CASE WHEN r.want > 0 THEN b.open ELSE r.entry END", "paid": f"CASE WHEN r.want > 0 THEN {fee} ELSE r.paid END", "size": size, "sold": "CASE WHEN r.want < 0 THEN 1 ELSE 0 END",
    }
    return s.scan(first, step).put(value="cash + position * close")


def _brackets_sql() -> str:
    s = Sql().put(k=f"row_number() {ORDER}")
    ended = "(CASE WHEN r.phase = 1 THEN CASE WHEN b.k > r.born + 3 THEN 1 WHEN b.low <= r.base * 0.12 THEN 2 ELSE 0 END WHEN r.phase = 2 THEN CASE WHEN b.low <= r.base * 0.06 THEN 3 WHEN b.high >= r.base * 2.2 THEN 4 ELSE 0 END ELSE 0 END)"
    after = f"(CASE {ended} WHEN 0 THEN r.phase WHEN 2 THEN 2 ELSE 0 END)"
    made = f"({after} = 0 AND b.k % 20 = 1)"
    first = {"phase": "1", "base": "b.close", "born": "1", "m": "1", "what": "0", "made": "1", "pm": "0", "pbase": "0"}
    step = {"phase": f"CASE WHEN {made} THEN 1 ELSE {after} END", "base": f"CASE WHEN {made} THEN b.close ELSE r.base END", "born": f"CASE WHEN {made} THEN b.k ELSE r.born END", "m": f"CASE WHEN {made} THEN r.m + 3 ELSE r.m END", "what": ended, "made": f"CASE WHEN {made} THEN 1 ELSE 0 END", "pm": "r.m", "pbase": "r.base"}
    s.scan(first, step)

    def event(when: str, n: str, i: int, status: str, base: str, m: str, left: str) -> str:
        kind, price, size = (("Limit", 0.12, 1.0), ("Stop", 0.06, -1.0), ("Limit", 2.2, -1.0))[i]
        parent = f"CAST({m} AS INTEGER)" if i else "CAST(NULL AS INTEGER)"
        return f"SELECT symbol, ts, CAST({n} AS INTEGER) AS n, CAST({m} + {i} AS INTEGER) AS \"order\", {parent} AS parent, '{kind}' AS kind, '{status}' AS status, {size}::DOUBLE AS size, round({base} * {price}, 4) + 0.0 AS price, {left}::DOUBLE AS left FROM {s.table} WHERE {when}"

    ends = {1: ((0, "Expired", 1.0), (1, "Canceled", -1.0), (2, "Canceled", -1.0)), 2: ((0, "Completed", 0.0), (1, "Accepted", -1.0), (2, "Accepted", -1.0)), 3: ((1, "Completed", 0.0), (2, "Canceled", -1.0)), 4: ((2, "Completed", 0.0), (1, "Canceled", -1.0))}
    parts = [event(f"what = {w}", str(n), i, status, "pbase", "pm", str(left)) for w, each in ends.items() for n, (i, status, left) in enumerate(each)]
    before = "CASE what WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 2 END"
    parts += [event("made = 1", f"{before} + {n}", i, status, "base", "m", str(left)) for n, (i, status, left) in enumerate(((0, "Submitted", 1.0), (0, "Accepted", 1.0), (1, "Submitted", -1.0), (2, "Submitted", -1.0)))]
    return f"{s.text} " + " UNION ALL ".join(parts)


def _trailing_sql() -> str:
    s = Sql().put(k=f"row_number() {ORDER}")
    hit = "(r.stop > 0 AND b.low <= r.stop)"
    held = f"(CASE WHEN r.want > 0 THEN 1 WHEN {hit} THEN 0 ELSE r.position END)"
    stop = f"(CASE WHEN {hit} THEN 0 WHEN r.want > 0 THEN b.close * 0.1 WHEN r.stop > 0 THEN greatest(r.stop, b.close - b.close * 90.0 / 100) ELSE 0 END)"
    go = f"({held} = 0 AND b.k % 15 = 1)"
    first = {"position": "0", "want": "1", "stop": "0", "m": "1", "did": "0", "px": "0"}
    step = {"position": held, "want": f"CASE WHEN {go} THEN 1 ELSE 0 END", "stop": stop, "m": f"r.m + CASE WHEN r.want > 0 THEN 1 ELSE 0 END + CASE WHEN {go} THEN 1 ELSE 0 END", "did": f"CASE WHEN r.want > 0 THEN 1 WHEN {hit} THEN 2 ELSE 0 END", "px": f"CASE WHEN r.want > 0 THEN b.open WHEN {hit} THEN r.stop END"}
    s.scan(first, step)
    s.put(id="CASE did WHEN 1 THEN m - 1 WHEN 2 THEN m - want END")
    return f"""{s.text} SELECT symbol, ts, CAST(id AS INTEGER) AS "order", CASE did WHEN 1 THEN 'Market' ELSE 'StopTrail' END AS kind, CASE did WHEN 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS size, round(px, 4) + 0.0 AS price FROM {s.table} WHERE did > 0"""


def _sweep_sql() -> str:
    parts = []
    for most in (1.0, 4.0, 16.0):
        s = _doubling(most).put(_peak="max(value) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
        parts.append(f"SELECT * FROM ({s.text} SELECT symbol, {most}::DOUBLE AS most, round(arg_max(value, ts), 6) AS value, round(arg_max(cash, ts), 6) AS cash, CAST(sum(sold) AS BIGINT) AS trades, round(max(100 * (_peak - value) / _peak), 6) + 0.0 AS drawdown, round(arg_max(value, ts) / {RICH} - 1, 6) + 0.0 AS total_return FROM {s.table} GROUP BY symbol)")
    return " UNION ALL ".join(parts)


PAIRS = pairs_sql("l_suppkey % 7")


def _rotation_sql() -> str:
    """A portfolio's bars in one sequence; the state is who holds and who is about to buy or sell."""
    s = Sql(PAIRS).put(m15=mean("close", 15))
    flat = f"{s.text}, one AS MATERIALIZED (SELECT *, split_part(symbol, '/', 1) AS portfolio, row_number() OVER (PARTITION BY split_part(symbol, '/', 1) ORDER BY ts, symbol) AS i, m15 IS NOT NULL AND close > m15 AS above FROM {s.table})"
    mine = "(r.want <> 0 AND r.who = b.symbol)"
    held = f"(CASE WHEN {mine} THEN CASE WHEN r.want > 0 THEN 1 ELSE 0 END ELSE r.held END)"
    left = f"(CASE WHEN {mine} THEN 0 ELSE r.want END)"
    buy = f"(b.above AND {held} = 0 AND {left} = 0)"
    sell = f"(NOT b.above AND {held} = 1 AND {left} = 0 AND r.who = b.symbol)"
    first = f"SELECT portfolio, i, symbol, ts, close, 0 AS held, CASE WHEN above THEN 1 ELSE 0 END AS want, symbol AS who, {RICH}::DOUBLE AS cash FROM one WHERE i = 1"
    rec = f"r AS ({first} UNION ALL SELECT b.portfolio, b.i, b.symbol, b.ts, b.close, {held}, CASE WHEN {buy} THEN 1 WHEN {sell} THEN -1 ELSE {left} END, CASE WHEN {buy} THEN b.symbol ELSE r.who END, r.cash - CASE WHEN {mine} THEN r.want * b.open + {FEE} * b.open ELSE 0 END FROM r JOIN one b ON b.portfolio = r.portfolio AND b.i = r.i + 1)"
    told = "w AS (SELECT r.*, CASE WHEN held = 1 AND who = symbol THEN 1.0 ELSE 0.0 END AS position FROM r), x AS (SELECT *, position * close - coalesce(lag(position * close) OVER (PARTITION BY symbol ORDER BY i), 0) AS moved FROM w)"
    value = "cash + sum(moved) OVER (PARTITION BY portfolio ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"{flat}, {rec}, {told} SELECT portfolio, split_part(symbol, '/', 2) AS symbol, ts, {_r(cash='cash', value=value, position='position')} FROM x"


def oracle_sql() -> dict[str, str]:
    d = _doubling(8.0)
    book, rows = booked(PAIRS)
    return {
        "exec_reactive": f"{d.text} SELECT symbol, ts, {_r(cash='cash', value='value', position='position')} FROM {d.table}",
        "exec_brackets": _brackets_sql(),
        "exec_trailing": _trailing_sql(),
        "exec_sweep_strategy": _sweep_sql(),
        "exec_rotation": _rotation_sql(),
        "exec_portfolios": f"{book} {BOOK} FROM {rows}",
    }
