"""Queries of the order machine, its observers and analyzers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyzers as an
from ..operators import broker
from ..operators.broker import Commission, Rules
from . import optimize
from .bars import Query, days, pairs
from .sql import DAYS, ORDER, SO_FAR, Sql, cross, lag, mean
from .sql import pairs as pairs_sql

FEE = 0.001
LONG = Rules(mode="long", commission=Commission(FEE))
RICH = 1_000_000.0


def near(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes crossing their mean of 15 days, bought and sold at the next open."""
    return optimize.backtest(days(spark, sf_dir), 15, LONG)


def _equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days(spark, sf_dir).select("symbol", "ts", F.col("close").alias("value"))


def on(f) -> Query:
    return lambda s, d: near(f(test(s, d)))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with their number."""
    from ..operators.frame import Bars

    b = Bars(days(spark, sf_dir))
    return b.put(k=b.number()).df


KINDS = ("Market", "Close", "Limit", "Stop", "StopLimit")


def _orders(spark: SparkSession, sf_dir: str, rules: Rules = Rules(cash=RICH, commission=Commission(FEE))) -> DataFrame:
    """Every tenth bar an order to buy one, of each kind in turn."""
    b = _marked(spark, sf_dir)
    turn = F.pmod(F.floor(F.col("k") / 10), F.lit(5))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (turn + 1).cast("int"))
    price = F.when(turn == 2, F.col("close") * 0.97).when(turn == 3, F.col("close") * 1.03).when(turn == 4, F.col("close") * 1.02)
    b = b.withColumns({"order": F.when(F.col("k") % 10 == 1, 1.0), "order_type": F.when(F.col("k") % 10 == 1, kind), "order_price": price, "order_limit": F.when(turn == 4, F.col("close") * 1.04)})
    return near(broker.fills(broker.run(b, rules)).drop("pnl"))


def _cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits that are withdrawn three bars later if they are still there."""
    b = _marked(spark, sf_dir)
    b = b.withColumns({"order": F.when(F.col("k") % 10 == 1, 1.0), "order_type": F.when(F.col("k") % 10 == 1, "Limit").when(F.col("k") % 10 == 4, "Cancel"), "order_price": F.col("close") * 0.8})
    return near(broker.fills(broker.run(b, Rules(cash=RICH))).drop("pnl"))


FILLERS = {"fixed": lambda left, volume, high, low, price: broker.fixed_size(left, volume, 7.0), "percent": lambda left, volume, high, low, price: broker.bar_percent(left, volume, 10.0), "points": lambda left, volume, high, low, price: broker.bar_points(left, volume, high, low, price, 1.0, 50.0)}


def _fillers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One large order, filled as far as each bar lets it."""
    b = _marked(spark, sf_dir).withColumn("order", F.when(F.col("k") == 1, 5000.0))
    out = None
    for name, filler in FILLERS.items():
        f = broker.fills(broker.run(b, Rules(cash=RICH, filler=filler))).select("symbol", "ts", F.lit(name).alias("filler"), "size", "price")
        out = f if out is None else out.unionByName(f)
    return near(out)


def _with_rules(rules: Rules, *columns: str) -> Query:
    return lambda s, d: near(optimize.backtest(days(s, d), 15, rules).select("symbol", "ts", *columns))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings sold short too, twice the stake where it reverses."""
    rules = Rules(cash=RICH, sizer=lambda cash, price, position, size: broker.reversing(cash, price, position, 3 * size))
    return near(optimize.backtest(days(spark, sf_dir), 15, rules).select("symbol", "ts", "cash", "value", "position"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth bar asks for a tranche of ten, long and short in turn, and once more in vain."""
    b = _marked(spark, sf_dir)
    b = b.withColumn("order", F.when(F.col("k") % 10 == 1, 1.0).when(F.col("k") % 10 == 4, 1.0).when(F.col("k") % 10 == 6, -1.0))
    rules = Rules(cash=RICH, signed=True, sizer=lambda cash, price, position, size: broker.to_target(cash, price, position, 10 * size, 5))
    return near(broker.run(b, rules).select("symbol", "ts", "cash", "value", "position"))


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash is paid in every twentieth day."""
    e = _marked(spark, sf_dir).withColumns({"flow": F.when(F.col("k") % 20 == 0, 50.0), "value": F.col("close") + 50 * F.floor(F.col("k") / 20)})
    return near(an.fund(e, flow="flow"), 3)


def _portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portfolio for each line status, side by side, its feeds the return flags."""
    orders = optimize.mean_cross_orders(pairs(spark, sf_dir, F.col("l_linestatus")), 15, by=("portfolio", "symbol"))
    return broker.run_portfolio(orders, LONG, ("portfolio",))


def _bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = an.bundle(test(spark, sf_dir))
    rows = [
        parts["returns"].select("symbol", F.col("period").alias("ts"), F.lit("return").alias("what"), F.col("ret").alias("value")),
        parts["positions"].select("symbol", "ts", F.lit("position").alias("what"), "value"),
        parts["transactions"].select("symbol", "ts", F.lit("transaction").alias("what"), (F.col("size") * F.col("price")).alias("value")),
        parts["leverage"].select("symbol", "ts", F.lit("leverage").alias("what"), F.col("leverage").alias("value")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return near(out)


def queries() -> dict[str, Query]:
    tiers = Commission(tiers=broker.CRYPTO_TIERS)
    return {
        "exec_backtest": on(lambda r: r.select("symbol", "ts", "cash", "value", "position")),
        "exec_trades": on(broker.trades),
        "exec_orders": _orders,
        "exec_cancel": _cancelled,
        "exec_fillers": _fillers,
        "exec_slippage": lambda s, d: near(broker.fills(optimize.backtest(days(s, d), 15, Rules(mode="long", slip_percent=0.01)))),
        "exec_slip_fixed": lambda s, d: near(broker.fills(optimize.backtest(days(s, d), 15, Rules(mode="long", slip_fixed=0.5)))),
        "exec_slip_out": lambda s, d: near(broker.fills(optimize.backtest(days(s, d), 15, Rules(mode="long", slip_percent=0.01, slip_fixed=9.0, slip_match=False)))),
        "exec_slip_kinds": lambda s, d: _orders(s, d, Rules(cash=RICH, commission=Commission(FEE), slip_percent=0.01)),
        "exec_maker_taker": lambda s, d: _orders(s, d, Rules(cash=RICH, commission=broker.exchange("kraken", maximum=0.12))),
        "exec_per_share": _with_rules(Rules(cash=RICH, mode="long", commission=Commission(0.01, per_share=True)), "cash", "value"),
        "exec_forex": _with_rules(Rules(cash=RICH, mode="long", commission=broker.forex(2.0, 1000.0, 20.0, 10.0)), "cash", "value", "position"),
        "exec_sizer_reverser": _turns,
        "exec_sizer_target": _targets,
        "obs_fund_flows": _flows,
        "exec_futures": _with_rules(Rules(cash=RICH, mode="long", commission=Commission(2.0, 1000.0, 10.0)), "cash", "value", "position"),
        "exec_fixed_fee": _with_rules(Rules(cash=RICH, mode="long", commission=Commission(5.0, fixed=True)), "cash", "value"),
        "exec_least_fee": _with_rules(Rules(cash=RICH, mode="long", commission=Commission(FEE, minimum=0.05)), "cash", "value"),
        "exec_tiers": lambda s, d: near(broker.fills(optimize.backtest(days(s, d), 15, Rules(cash=RICH, mode="long", commission=tiers), size=100.0)).drop("pnl")),
        "exec_sizer_percent": _with_rules(Rules(mode="long", commission=Commission(FEE), sizer=lambda cash, price, position, size: broker.percent(cash, price, position, 20.0)), "cash", "value", "position"),
        "exec_sizer_all_in": _with_rules(Rules(cash=RICH, mode="long", sizer=lambda cash, price, position, size: broker.all_in(cash * 0.1, price, position)), "cash", "value", "position"),
        "exec_sizer_stake": _with_rules(Rules(cash=RICH, mode="long", sizer=lambda cash, price, position, size: broker.stake(cash, price, position, 12.0, 5)), "cash", "value", "position"),
        "exec_portfolio": lambda s, d: near(_portfolio(s, d).select("portfolio", "symbol", "ts", "cash", "value", "position", "gross"), 2),
        "exec_sweep": lambda s, d: near(optimize.ranked(optimize.sweep(days(s, d), [10, 15, 20, 30]))),
        "exec_sweep_grid": lambda s, d: near(optimize.ranked(optimize.sweep_grid(days(s, d), optimize.grid(fast=[1, 5], slow=[20, 40])), "drawdown", ascending=True)),
        "an_sqn": on(lambda r: an.sqn(broker.trades(r))),
        "an_trade_analyzer": on(lambda r: an.trade_analyzer(broker.trades(r))),
        "an_streaks": on(lambda r: an.streaks(broker.trades(r))),
        "an_transactions": on(lambda r: an.transactions(broker.fills(r), "month")),
        "an_positions": on(lambda r: an.positions(broker.equity(r))),
        "an_position_stats": on(lambda r: an.position_stats(broker.equity(r))),
        "an_leverage": on(lambda r: an.leverage(broker.equity(r))),
        "an_leverage_stats": on(lambda r: an.leverage_stats(broker.equity(r))),
        "an_gross_leverage": lambda s, d: near(an.leverage_stats(_portfolio(s, d), ("portfolio",), "gross")),
        "an_value_stats": on(lambda r: an.value_stats(broker.equity(r))),
        "an_bundle": _bundle,
        "an_own_annual_return": lambda s, d: near(an.own_annual_return(_equity(s, d))),
        "an_sharpe_stats": lambda s, d: near(an.sharpe_stats(_equity(s, d)).select("symbol", "n", "mean", "std", "var95", "cvar95", "sharpe", "t")),
        "an_period_stats": lambda s, d: near(an.period_stats(_equity(s, d))),
        "obs_trade_markers": lambda s, d: near(an.trade_markers(days(s, d), broker.trades(test(s, d)))),
        "obs_buy_sell": lambda s, d: near(an.buy_sell(days(s, d), broker.fills(test(s, d)))),
    }


def _signals(s: Sql, fast: str = "close", slow: str | None = None) -> Sql:
    """_sig: 1 where the fast line rises through the slow one, -1 where it falls
    again; ``size`` is what is done about it on the bar after."""
    s.put(_fast=fast, _slow=slow or mean("close", 15))
    cross(s, "_fast", "_slow", "x").put(_ups=f"count(CASE WHEN x > 0 THEN 1 END) {SO_FAR}")
    s.put(_sig="CASE WHEN x > 0 THEN 1.0 WHEN x < 0 AND _ups > 0 THEN -1.0 ELSE 0.0 END")
    return s.put(size=f"coalesce({lag('_sig')}, 0)", _k=f"row_number() {ORDER}")


def _run(s: Sql, cash: float = 10_000.0, price: str = "open", fee: str = f"{FEE} * abs(size) * px") -> Sql:
    s.put(px=price).put(fee=f"CASE WHEN size <> 0 THEN {fee} ELSE 0 END").put(position=f"sum(size) {SO_FAR}", cash=f"{cash} - sum(size * px + fee) {SO_FAR}")
    return s.put(value="cash + position * close", entry=f"last_value(CASE WHEN size > 0 THEN px END IGNORE NULLS) {SO_FAR}", _since=f"last_value(CASE WHEN size > 0 THEN ts END IGNORE NULLS) {SO_FAR}", _from=f"last_value(CASE WHEN size > 0 THEN _k END IGNORE NULLS) {SO_FAR}", _paid=f"last_value(CASE WHEN size > 0 THEN fee END IGNORE NULLS) {SO_FAR}", _order=f"sum(CASE WHEN size <> 0 THEN 1 ELSE 0 END) {SO_FAR}")


def _tested(**options) -> tuple[str, str]:
    s = _run(_signals(Sql()), **options)
    return s.text, s.table


def _r(**cells: str) -> str:
    return ", ".join(f"round({e}, 4) + 0.0 AS {c}" for c, e in cells.items())


def booked(source: str) -> tuple[str, str]:
    """Feeds of a portfolio (symbols with its name before a slash) drawing on one cash account."""
    s = _run(_signals(Sql(source)))
    text = f"{s.text}, w AS (SELECT *, position * close AS worth, split_part(symbol, '/', 1) AS portfolio FROM {s.table}), dw AS (SELECT *, worth - coalesce(lag(worth) {ORDER}, 0) AS moved FROM w)"
    return text + ", booked AS (SELECT portfolio, split_part(symbol, '/', 2) AS symbol, ts, position, 10000 - sum(size * px + fee) OVER o AS cash, sum(moved) OVER o AS worth FROM dw WINDOW o AS (PARTITION BY portfolio ORDER BY ts, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))", "booked"


BOOK = "SELECT portfolio, symbol, ts, " + _r(cash="cash", value="cash + worth", position="position", gross="worth / (cash + worth)").replace(", 4)", ", 2)")
TRADES = "SELECT symbol, _since AS opened, ts AS closed, 1.0::DOUBLE AS size, entry, px AS exit, px - entry AS pnl, px - entry - (_paid + fee) AS pnlcomm, CAST(_k - _from AS INTEGER) AS bars FROM {} WHERE size < 0"


def _picked(s: Sql, cash: float, fee: str, want: str) -> str:
    """Runs whose size hangs on the cash: the state is cash, position and what was ordered."""
    left = f"(r.cash - r.want * b.open - ({fee}))"
    held = "(r.position + r.want)"
    order = f"CASE WHEN b._sig > 0 AND {held} = 0 THEN {want.format(cash=left)} WHEN b._sig < 0 AND {held} > 0 THEN -{held} ELSE 0 END"
    s.scan({"cash": f"{cash}", "position": "0", "want": f"CASE WHEN b._sig > 0 THEN {want.format(cash=cash)} ELSE 0 END"}, {"cash": left, "position": held, "want": order})
    return f"{s.text} SELECT symbol, ts, {_r(cash='cash', value='cash + position * close', position='position')} FROM {s.table}"


def _sweep_sql(combinations: list[tuple[int, int]], names: str) -> str:
    parts = []
    for f, n in combinations:
        s = _run(_signals(Sql(), "close" if f == 1 else mean("close", f), mean("close", n)), fee="0")
        s.put(_peak=f"max(value) {SO_FAR}")
        label = f"{n} AS period" if names == "period" else f"{f} AS fast, {n} AS slow"
        parts.append(f"SELECT * FROM ({s.text} SELECT symbol, {label}, round(arg_max(value, ts), 4) AS value, round(arg_max(cash, ts), 4) AS cash, CAST(sum(CASE WHEN size < 0 THEN 1 ELSE 0 END) AS BIGINT) AS trades, round(max(100 * (_peak - value) / _peak), 4) + 0.0 AS drawdown, round(arg_max(value, ts) / 10000 - 1, 4) + 0.0 AS total_return FROM {s.table} GROUP BY symbol)")
    return " UNION ALL ".join(parts)


def _orders_sql(cost: str = f'price * {FEE}', slip: str = '{}') -> str:
    return f"""WITH {DAYS}, b AS MATERIALIZED (SELECT *, row_number() {ORDER} AS k FROM bars), o AS (
  SELECT symbol, k, close, (k // 10) % 5 AS turn, CAST(row_number() OVER (PARTITION BY symbol ORDER BY k) AS INTEGER) AS id FROM b WHERE k % 10 = 1
), hit AS (
  SELECT o.symbol, o.id, o.turn, o.close, min(b.k) AS k FROM o JOIN b ON b.symbol = o.symbol AND b.k > o.k
  WHERE turn < 2 OR turn = 2 AND b.low <= o.close * 0.97 OR turn = 3 AND b.high >= o.close * 1.03 OR turn = 4 AND b.high >= o.close * 1.02 GROUP BY ALL
), fill AS (
  SELECT h.symbol, h.id, h.turn, h.close, CASE WHEN h.turn < 4 OR b.close <= h.close * 1.04 THEN h.k ELSE (SELECT min(n.k) FROM b n WHERE n.symbol = h.symbol AND n.k > h.k AND n.low <= h.close * 1.04) END AS k
  FROM hit h JOIN b ON b.symbol = h.symbol AND b.k = h.k
), told AS (
  SELECT f.symbol, b.ts, f.id, CASE f.turn WHEN 0 THEN b.open WHEN 1 THEN b.close WHEN 2 THEN f.close * 0.97 WHEN 3 THEN f.close * 1.03 ELSE f.close * 1.04 END AS price, f.turn, b.high, b.low FROM fill f JOIN b ON b.symbol = f.symbol AND b.k = f.k
)
SELECT symbol, ts, id AS "order", 1.0::DOUBLE AS size, {_r(price='price', fee=cost)} FROM (SELECT * REPLACE ({slip.format('price')} AS price) FROM told)"""


def oracle_sql() -> dict[str, str]:
    text, rows = _tested()
    trades = f"{text}, trades AS ({TRADES.format(rows)})"
    slip, slipped = _tested(price="CASE WHEN size > 0 THEN least(open * 1.01, high) ELSE greatest(open * 0.99, low) END", fee="0")
    future, futures = _tested(cash=0, fee="0")
    fixed, fixes = _tested(cash=RICH, fee="5.0")
    least, leasts = _tested(cash=RICH, fee=f"greatest({FEE} * px, 0.05)")
    fixed_slip, fixed_slips = _tested(price="CASE WHEN size > 0 THEN least(open + 0.5, high) ELSE greatest(open - 0.5, low) END", fee="0")
    out, outs = _tested(price="CASE WHEN size > 0 THEN open * 1.01 ELSE open * 0.99 END", fee="0")
    share, shares = _tested(cash=RICH, fee="0.01 * abs(size)")
    turn = cross(Sql().put(_m=mean("close", 15)), "close", "_m", "x").put(_c=f"count(nullif(x, 0)) {SO_FAR}").put(_o="CASE WHEN x <> 0 THEN x * CASE WHEN _c = 1 THEN 3 ELSE 6 END ELSE 0 END")
    turn = _run(turn.put(size=f"coalesce({lag('_o')}, 0)", _k=f"row_number() {ORDER}"), RICH, fee="0")
    aim = Sql().put(_k=f"row_number() {ORDER}").put(_o="CASE WHEN _k = 1 THEN 2 WHEN _k % 10 = 1 THEN 4 WHEN _k % 10 = 6 THEN -4 ELSE 0 END")
    aim = _run(aim.put(size=f"coalesce({lag('_o')}, 0)"), RICH, fee="0")
    filled = lambda text, rows: f"{text} SELECT symbol, ts, CAST(_order AS INTEGER) AS \"order\", {_r(size='size', price='px', fee='0.0', pnl='CASE WHEN size < 0 THEN px - entry ELSE 0 END')} FROM {rows} WHERE size <> 0"
    staked, stakes = _tested(cash=RICH, fee="0")
    tier = "".join(f"WHEN traded >= {low} THEN {taker} " for low, _, taker in reversed(broker.CRYPTO_TIERS))
    book, booked_rows = booked(pairs_sql("l_linestatus"))
    cube = "CAST(count(*) AS BIGINT) AS trades, " + _r(gross="sum(pnl)", net="sum(pnlcomm)", average="avg(pnlcomm)", best="max(pnlcomm)", worst="min(pnlcomm)") + ", CAST(sum(bars) AS BIGINT) AS bars, round(avg(bars), 4) AS bars_average, CAST(max(bars) AS INTEGER) AS bars_max, CAST(min(bars) AS INTEGER) AS bars_min"
    stats = lambda x: _r(average=f"avg({x})", stddev=f"stddev_samp({x})", most=f"max({x})", least=f"min({x})")
    runs = lambda key: f"sum(CASE WHEN {key} = before THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY px ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run"
    month = f"WITH {DAYS}, p AS (SELECT symbol, date_trunc('month', ts) AS px, arg_min(close, ts) AS first, arg_max(close, ts) AS last FROM bars GROUP BY symbol, date_trunc('month', ts)), r AS (SELECT symbol, px, last / coalesce(lag(last) OVER (PARTITION BY symbol ORDER BY px), first) - 1 AS ret FROM p)"
    return {
        "exec_backtest": f"{text} SELECT symbol, ts, {_r(cash='cash', value='value', position='position')} FROM {rows}",
        "exec_trades": f"{trades} SELECT symbol, opened, closed, size, {_r(entry='entry', exit='exit', pnl='pnl', pnlcomm='pnlcomm')}, bars FROM trades",
        "exec_orders": _orders_sql(),
        "exec_cancel": f"WITH {DAYS}, b AS MATERIALIZED (SELECT *, row_number() {ORDER} AS k FROM bars), o AS (SELECT symbol, k, close * 0.8 AS price, CAST(row_number() OVER (PARTITION BY symbol ORDER BY k) AS INTEGER) AS id FROM b WHERE k % 10 = 1), f AS (SELECT o.symbol, o.id, o.price, min(b.ts) AS ts FROM o JOIN b ON b.symbol = o.symbol AND b.k BETWEEN o.k + 1 AND o.k + 3 AND b.low <= o.price GROUP BY ALL) SELECT symbol, ts, id AS \"order\", 1.0::DOUBLE AS size, round(price, 4) AS price, 0.0::DOUBLE AS fee FROM f",
        "exec_fillers": f"WITH {DAYS}, b AS (SELECT *, row_number() {ORDER} AS k FROM bars), c AS (SELECT symbol, ts, k, open, unnest([{{'f': 'fixed', 'n': least(volume, 7)}}, {{'f': 'percent', 'n': floor(volume * 10 / 100)}}, {{'f': 'points', 'n': floor(floor(volume * 50 / 100) / greatest(1, round_even((high - low) / 1.0, 0) + 1))}}]) AS x FROM b WHERE k > 1), d AS (SELECT *, least(x.n, 5000 - coalesce(sum(x.n) OVER (PARTITION BY symbol, x.f ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS n FROM c) SELECT symbol, ts, x.f AS filler, {_r(size='n', price='open')} FROM d WHERE n > 0",
        "exec_slippage": f"{slip} SELECT symbol, ts, CAST(_order AS INTEGER) AS \"order\", {_r(size='size', price='px', fee='0.0', pnl='CASE WHEN size < 0 THEN px - entry ELSE 0 END')} FROM {slipped} WHERE size <> 0",
        "exec_futures": f"{future}, f AS (SELECT symbol, ts, position, {RICH} - 2 * _order - 1000 * position + 10 * (cash + position * close) AS cash FROM {futures}) SELECT symbol, ts, {_r(cash='cash', value='cash + 1000 * position', position='position')} FROM f",
        "exec_slip_fixed": filled(fixed_slip, fixed_slips),
        "exec_slip_out": filled(out, outs),
        "exec_slip_kinds": _orders_sql(slip="greatest(low, least({} * 1.01, high))"),
        "exec_maker_taker": _orders_sql("least(price * CASE WHEN turn IN (2, 4) THEN 0.16 ELSE 0.26 END / 100, 0.12)"),
        "exec_per_share": f"{share} SELECT symbol, ts, {_r(cash='cash', value='value')} FROM {shares}",
        "exec_forex": f"{future}, f AS (SELECT symbol, ts, position, {RICH} - 2 * _order - 50 * position + 10 * (cash + position * close) AS cash FROM {futures}) SELECT symbol, ts, {_r(cash='cash', value='cash + 50 * position', position='position')} FROM f",
        "exec_sizer_reverser": f"{turn.text} SELECT symbol, ts, {_r(cash='cash', value='value', position='position')} FROM {turn.table}",
        "exec_sizer_target": f"{aim.text} SELECT symbol, ts, {_r(cash='cash', value='value', position='position')} FROM {aim.table}",
        "obs_fund_flows": f"WITH {DAYS}, k AS (SELECT *, row_number() {ORDER} AS k FROM bars), v AS (SELECT symbol, ts, close + 50 * (k // 20) AS value, CASE WHEN k % 20 = 0 THEN 50 ELSE 0 END AS flow FROM k), g AS (SELECT *, coalesce((value - flow) / {lag('value')}, 1) AS g FROM v), n AS (SELECT *, 100 * exp(sum(ln(g)) {SO_FAR}) AS now FROM g) SELECT symbol, ts, round(now, 3) + 0.0 AS fund_value, round(value / now, 3) + 0.0 AS fund_shares FROM n",
        "exec_fixed_fee": f"{fixed} SELECT symbol, ts, {_r(cash='cash', value='value')} FROM {fixes}",
        "exec_least_fee": f"{least} SELECT symbol, ts, {_r(cash='cash', value='value')} FROM {leasts}",
        "exec_tiers": f"{text}, v AS (SELECT symbol, ts, _order, size * 100 AS size, px, coalesce(sum(abs(size * 100 * px)) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS traded FROM {rows} WHERE size <> 0) SELECT symbol, ts, CAST(_order AS INTEGER) AS \"order\", {_r(size='size', price='px', fee=f'abs(size * px) * CASE {tier} END')} FROM v",
        "exec_sizer_percent": _picked(_signals(Sql()), 10_000.0, f"{FEE} * abs(r.want) * b.open", "({cash} * 20.0 / 100 / b.close)"),
        "exec_sizer_all_in": _picked(_signals(Sql()), RICH, "0", "floor({cash} * 0.1 * 100.0 / 100 / b.close)"),
        "exec_sizer_stake": f"{staked} SELECT symbol, ts, {_r(cash=f'{RICH} + 2 * (cash - {RICH})', value=f'{RICH} + 2 * (value - {RICH})', position='2 * position')} FROM {stakes}",
        "exec_portfolio": f"{book} {BOOK} FROM {booked_rows}",
        "exec_sweep": _sweep_sql([(1, n) for n in (10, 15, 20, 30)], "period"),
        "exec_sweep_grid": _sweep_sql([(f, n) for f in (1, 5) for n in (20, 40)], "both"),
        "an_sqn": f"{trades} SELECT symbol, CAST(count(*) AS BIGINT) AS trades, round(CASE WHEN count(*) > 1 THEN coalesce(sqrt(count(*)) * avg(pnlcomm) / nullif(stddev_pop(pnlcomm), 0), 0) ELSE 0 END, 4) + 0.0 AS sqn FROM trades GROUP BY symbol",
        "an_trade_analyzer": f"{trades}, tt AS (SELECT *, 'long' AS side, pnlcomm > 0 AS won FROM trades) SELECT symbol, side, won, {cube} FROM tt GROUP BY CUBE (symbol, side, won) HAVING symbol IS NOT NULL",
        "an_streaks": f"{trades}, tt AS (SELECT symbol, closed AS px, pnlcomm > 0 AS won, lag(pnlcomm > 0) OVER (PARTITION BY symbol ORDER BY closed) AS before FROM trades), u AS (SELECT *, {runs('won')} FROM tt), n AS (SELECT symbol, run, any_value(won) AS won, count(*) AS n FROM u GROUP BY symbol, run) SELECT symbol, CAST(max(CASE WHEN won THEN n ELSE 0 END) AS BIGINT) AS won, CAST(max(CASE WHEN NOT won THEN n ELSE 0 END) AS BIGINT) AS lost FROM n GROUP BY symbol",
        "an_transactions": f"{text} SELECT symbol, CAST(date_trunc('month', ts) AS TIMESTAMP) AS period, count(*) AS n, {_r(bought='sum(CASE WHEN size > 0 THEN size ELSE 0 END)', sold='sum(CASE WHEN size < 0 THEN -size ELSE 0 END)', value='sum(size * px)', fees='sum(fee)')} FROM {rows} WHERE size <> 0 GROUP BY symbol, date_trunc('month', ts)",
        "an_positions": f"{text} SELECT symbol, ts, {_r(value='position * close', pnl='CASE WHEN position > 0 THEN close - entry ELSE 0 END')} FROM {rows}",
        "an_position_stats": f"{text}, p AS (SELECT symbol, position * close AS value, CASE WHEN position > 0 THEN close - entry ELSE 0 END AS pnl FROM {rows}) SELECT symbol, {stats('value')}, {_r(best='max(pnl)', worst='min(pnl)', long_share='avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END)', short_share='avg(CASE WHEN value < 0 THEN 1.0 ELSE 0 END)')} FROM p GROUP BY symbol",
        "an_leverage": f"{text} SELECT symbol, ts, {_r(leverage='position * close / value')} FROM {rows}",
        "an_leverage_stats": f"{text} SELECT symbol, {stats('position * close / value')} FROM {rows} GROUP BY symbol",
        "an_gross_leverage": f"{book} SELECT portfolio, {stats('worth / (cash + worth)')} FROM {booked_rows} GROUP BY portfolio",
        "an_value_stats": f"{text} SELECT symbol, {_r(first='arg_min(value, ts)', last='arg_max(value, ts)')}, {stats('value')}, round(arg_max(value, ts) / arg_min(value, ts) - 1, 4) + 0.0 AS growth FROM {rows} GROUP BY symbol",
        "an_bundle": f"{text}, u AS (SELECT symbol, ts, 'return' AS what, value / coalesce({lag('value')}, value) - 1 AS value FROM {rows} UNION ALL SELECT symbol, ts, 'position', position * close FROM {rows} UNION ALL SELECT symbol, ts, 'transaction', size * px FROM {rows} WHERE size <> 0 UNION ALL SELECT symbol, ts, 'leverage', position * close / value FROM {rows}) SELECT symbol, ts, what, {_r(value='value')} FROM u",
        "an_own_annual_return": f"WITH {DAYS} SELECT symbol, CAST(year(ts) AS INTEGER) AS year, round(arg_max(close, ts) / arg_min(close, ts) - 1, 4) + 0.0 AS ret FROM bars GROUP BY symbol, year(ts)",
        "an_sharpe_stats": f"WITH {DAYS}, r AS (SELECT symbol, close / {lag('close')} - 1 AS r FROM bars), g AS (SELECT symbol, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS std, quantile_cont(r, 0.05) AS var95 FROM r GROUP BY symbol), c AS (SELECT symbol, avg(r) AS cvar95 FROM r JOIN g USING (symbol) WHERE r <= var95 GROUP BY symbol) SELECT symbol, n, {_r(mean='mean', std='std', var95='var95', cvar95='cvar95', sharpe='mean / std', t='mean / std * sqrt(n)')} FROM g JOIN c USING (symbol)",
        "an_period_stats": f"{month}, l AS (SELECT *, sign(ret) AS s, lag(sign(ret)) OVER (PARTITION BY symbol ORDER BY px) AS before FROM r), u AS (SELECT *, {runs('s')} FROM l), n AS (SELECT symbol, run, any_value(s) AS s, count(*) AS n FROM u GROUP BY symbol, run), m AS (SELECT symbol, CAST(max(CASE WHEN s > 0 THEN n ELSE 0 END) AS BIGINT) AS win_run, CAST(max(CASE WHEN s < 0 THEN n ELSE 0 END) AS BIGINT) AS loss_run FROM n GROUP BY symbol), g AS (SELECT symbol, count(*) AS periods, avg(ret) AS average, stddev_pop(ret) AS stddev, max(ret) AS best, min(ret) AS worst, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS win_rate, exp(sum(ln(1 + ret))) - 1 AS compound, sqrt(avg(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END)) AS downside FROM r GROUP BY symbol), q AS (SELECT symbol, close, max(close) {SO_FAR} AS peak FROM bars), x AS (SELECT symbol, max((peak - close) / peak) AS deepest FROM q GROUP BY symbol), y AS (SELECT *, pow(1 + compound, 12.0 / periods) - 1 AS annual FROM g) SELECT symbol, periods, {_r(annual='annual', volatility='stddev * sqrt(12)', calmar='CASE WHEN deepest > 0 THEN annual / deepest ELSE 0 END', consistency='50 * win_rate + CASE WHEN average > 0 AND stddev > 0 THEN greatest(0, 50 * (1 - stddev / average)) ELSE 0 END', average='average', stddev='stddev', best='best', worst='worst', win_rate='win_rate', compound='compound', downside='downside', sharpe='average / nullif(stddev, 0)', sortino='average / nullif(downside, 0)')}, win_run, loss_run FROM y JOIN m USING (symbol) JOIN x USING (symbol)",
        "obs_trade_markers": f"{trades}, tt AS (SELECT symbol, closed AS ts, sum(CASE WHEN pnlcomm >= 0 THEN pnlcomm END) AS gain, sum(CASE WHEN pnlcomm < 0 THEN pnlcomm END) AS loss FROM trades GROUP BY ALL) SELECT symbol, ts, {_r(close='close', gain='gain', loss='loss')} FROM bars LEFT JOIN tt USING (symbol, ts)",
        "obs_buy_sell": f"{text} SELECT symbol, ts, {_r(close='close', buy='CASE WHEN size > 0 THEN px END', sell='CASE WHEN size < 0 THEN px END')} FROM {rows}",
    }
