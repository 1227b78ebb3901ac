"""Performance figures as aggregations over equity and trades."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frame import ratio
from .resample import bucket

#: Periods in a year.
PER_YEAR = {"day": 252.0, "week": 52.0, "month": 12.0, "year": 1.0}


def _w(by=("symbol",)):
    return W.partitionBy(*by).orderBy("ts")


def time_return(equity: DataFrame, unit: str = "year", by=("symbol",), value: str = "value") -> DataFrame:
    """Return of each period: its last value over the last one before it, or
    over its own first value in the first period."""
    e = equity.withColumn("period", bucket(F.col("ts"), unit)).groupBy(*by, "period").agg(F.min_by(value, "ts").alias("first"), F.max_by(value, "ts").alias("last"))
    w = W.partitionBy(*by).orderBy("period")
    start = F.coalesce(F.lag("last").over(w), F.col("first"))
    return e.select(*by, "period", ratio(F.col("last"), start).alias("_r"), "first", "last").select(*by, "period", (F.col("_r") - 1).alias("ret"), "first", "last")


def annual_return(equity: DataFrame, by=("symbol",), value: str = "value") -> DataFrame:
    r = time_return(equity, "year", by, value)
    return r.select(*by, F.year("period").alias("year"), "ret")


def own_annual_return(equity: DataFrame, by=("symbol",), value: str = "value") -> DataFrame:
    """Last value of the year over its first, less one."""
    r = time_return(equity, "year", by, value)
    return r.select(*by, F.year("period").alias("year"), (ratio(F.col("last"), F.col("first")) - 1).alias("ret"))


def returns(equity: DataFrame, per_year: float = 252.0, by=("symbol",), value: str = "value") -> DataFrame:
    """Total and mean log return, and the mean by year."""
    e = equity.withColumn("_l", F.log(ratio(F.col(value), F.lag(value).over(_w(by)))))
    out = e.groupBy(*by).agg(F.sum("_l").alias("rtot"), F.avg("_l").alias("ravg"))
    return out.select(*by, "rtot", "ravg", (F.exp(F.col("ravg") * per_year) - 1).alias("rnorm"), (100 * (F.exp(F.col("ravg") * per_year) - 1)).alias("rnorm100"))


def rolling_log_returns(equity: DataFrame, n: int = 20, by=("symbol",), value: str = "value") -> DataFrame:
    """Log of each value over the oldest in its window, with running mean,
    deviation and their ratio."""
    w = _w(by)
    e = equity.withColumn("logret", F.log(ratio(F.col(value), F.first(value).over(w.rowsBetween(-(n - 1), 0)))))
    far = w.rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumns({"mean": F.avg("logret").over(far), "std": F.stddev_pop("logret").over(far)})
    return e.select(*by, "ts", "logret", "mean", "std", ratio(F.col("mean"), F.col("std")).alias("sharpe"))


def drawdown(equity: DataFrame, by=("symbol",), value: str = "value") -> DataFrame:
    """For each bar the money and percent below the running peak and the bars
    since it."""
    far = _w(by).rowsBetween(W.unboundedPreceding, 0)
    e = equity.withColumns({"peak": F.max(value).over(far), "_n": F.row_number().over(_w(by))})
    e = e.withColumn("_top", F.max(F.when(F.col(value) >= F.col("peak"), F.col("_n"))).over(far))
    money = F.col("peak") - F.col(value)
    return e.select(*by, "ts", F.col(value).alias("value"), "peak", money.alias("money"), (100 * ratio(money, F.col("peak"))).alias("drawdown"), (F.col("_n") - F.col("_top")).alias("length"))


def max_drawdown(equity: DataFrame, by=("symbol",), value: str = "value") -> DataFrame:
    return drawdown(equity, by, value).groupBy(*by).agg(F.max("money").alias("money"), F.max("drawdown").alias("drawdown"), F.max("length").alias("length"))


def time_drawdown(equity: DataFrame, unit: str = "month", by=("symbol",), value: str = "value") -> DataFrame:
    """The deepest and longest drawdown over period-end values."""
    e = equity.groupBy(*by, bucket(F.col("ts"), unit).alias("_p")).agg(F.max_by(value, "ts").alias("value"))
    return max_drawdown(e.withColumnRenamed("_p", "ts"), by)


def calmar(equity: DataFrame, unit: str = "month", by=("symbol",), value: str = "value") -> DataFrame:
    """Mean log return of the periods over the largest drawdown; infinite
    without one."""
    r = time_return(equity, unit, by, value).groupBy(*by).agg(F.avg(F.log(ratio(F.col("last"), F.col("first")))).alias("mean"))
    d = max_drawdown(equity, by, value)
    return r.join(d, list(by)).select(*by, "mean", "drawdown", F.when(F.col("drawdown") > 0, F.col("mean") / (F.col("drawdown") / 100)).otherwise(F.lit(float("inf"))).alias("calmar"))


def sharpe(equity: DataFrame, unit: str = "year", risk_free: float = 0.01, annualize: bool = False, sample: bool = False, by=("symbol",), value: str = "value") -> DataFrame:
    """Mean excess return over its deviation, the yearly rate converted to the
    period's; null without two returns or any deviation."""
    f = PER_YEAR[unit]
    rate = (1 + risk_free) ** (1 / f) - 1
    r = time_return(equity, unit, by, value).withColumn("_x", F.col("ret") - F.lit(rate))
    std = F.stddev_samp("_x") if sample else F.stddev_pop("_x")
    out = r.groupBy(*by).agg(F.avg("_x").alias("m"), std.alias("s"))
    return out.select(*by, (ratio(F.col("m"), F.col("s")) * (math.sqrt(f) if annualize else 1.0)).alias("sharpe"))


def _phi(x: Column) -> Column:
    """Normal distribution function (Abramowitz and Stegun 7.1.26)."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    e = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z)
    return F.when(x >= 0, (1 + e) / 2).otherwise((1 - e) / 2)


def sharpe_stats(equity: DataFrame, benchmark: float = 0.0, by=("symbol",), value: str = "value") -> DataFrame:
    """Sharpe ratio of bar returns with skew, excess kurtosis, t, its two-sided
    normal p, the probability that it exceeds ``benchmark``, the same deflated by
    the number of returns, the least track
    record for 95 %, and value and expected shortfall at 5 %."""
    e = equity.withColumn("_r", ratio(F.col(value), F.lag(value).over(_w(by))) - 1)
    g = e.groupBy(*by).agg(F.count("_r").alias("n"), F.avg("_r").alias("mean"), F.stddev_samp("_r").alias("std"), F.skewness("_r").alias("skew"), F.kurtosis("_r").alias("kurtosis"), F.percentile("_r", F.lit(0.05)).alias("var95"))
    tail = e.join(g.select(*by, "var95"), list(by)).where(F.col("_r") <= F.col("var95")).groupBy(*by).agg(F.avg("_r").alias("cvar95"))
    g = g.join(tail, list(by), "left").withColumn("sharpe", ratio(F.col("mean"), F.col("std")))
    sr, n = F.col("sharpe"), F.col("n")
    spread = F.sqrt(F.greatest(1 - F.col("skew") * sr + (F.col("kurtosis") + 2) / 4 * sr * sr, F.lit(1e-12)))
    t = sr * F.sqrt(n)
    return g.withColumns({
        "t": t, "p": 2 * (1 - _phi(F.abs(t))), "psr": _phi((sr - benchmark) * F.sqrt(n - 1) / spread),
        "dsr": _phi((sr - benchmark) * F.sqrt(n - 1) / spread) * (1 - math.log(2) / F.log(n.cast("double"))),
        "min_track": 1 + spread * spread * (1.6448536269514722 / F.nullif(sr - benchmark, F.lit(0.0))) ** 2,
        "low95": sr - 1.959963984540054 * spread / F.sqrt(n - 1), "high95": sr + 1.959963984540054 * spread / F.sqrt(n - 1),
    })


def sqn(trades: DataFrame, by=("symbol",)) -> DataFrame:
    """sqrt(n) mean / deviation of net profit; 0 for fewer than two trades."""
    g = trades.groupBy(*by).agg(F.count("*").alias("n"), F.avg("pnlcomm").alias("m"), F.stddev_pop("pnlcomm").alias("s"))
    return g.select(*by, F.col("n").alias("trades"), F.when(F.col("n") > 1, F.coalesce(ratio(F.sqrt("n") * F.col("m"), F.col("s")), F.lit(0.0))).otherwise(0.0).alias("sqn"))


def vwr(equity: DataFrame, unit: str = "month", by=("symbol",), value: str = "value") -> DataFrame:
    """Geometric mean return over the deviation of log returns, and both."""
    r = time_return(equity, unit, by, value).where("ret > -1").withColumn("_l", F.log1p("ret"))
    g = r.groupBy(*by).agg((F.exp(F.avg("_l")) - 1).alias("mean"), F.stddev_samp("_l").alias("std"), F.skewness("_l").alias("skew"), F.sqrt(F.avg(F.when(F.col("ret") < 0, F.col("ret") * F.col("ret")).otherwise(0.0))).alias("downside"))
    return g.withColumn("vwr", ratio(F.col("mean"), F.col("std"))).withColumn("vwr_annual", F.col("vwr") * math.sqrt(PER_YEAR[unit]))


def period_stats(equity: DataFrame, unit: str = "month", by=("symbol",), value: str = "value") -> DataFrame:
    """Mean, deviation, best, worst, share of gains, compound and downside
    figures of period returns, with the longest runs of gains and losses, the
    yearly return and deviation, the return over the deepest drawdown, and a
    score of consistency: 50 for gains always, 50 for gains without deviation."""
    r = time_return(equity, unit, by, value)
    w = W.partitionBy(*by).orderBy("period")
    sign = F.signum("ret")
    r = r.withColumn("_new", F.when(sign == F.lag(sign).over(w), 0).otherwise(1))
    r = r.withColumn("_run", F.sum("_new").over(w)).withColumn("_sign", sign)
    runs = r.groupBy(*by, "_run").agg(F.first("_sign").alias("_sign"), F.count("*").alias("_n"))
    runs = runs.groupBy(*by).agg(F.max(F.when(F.col("_sign") > 0, F.col("_n")).otherwise(0)).alias("win_run"), F.max(F.when(F.col("_sign") < 0, F.col("_n")).otherwise(0)).alias("loss_run"))
    g = r.groupBy(*by).agg(
        F.count("*").alias("periods"), F.avg("ret").alias("average"), F.stddev_pop("ret").alias("stddev"), F.max("ret").alias("best"), F.min("ret").alias("worst"),
        F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("compound"),
        F.sqrt(F.avg(F.when(F.col("ret") < 0, F.col("ret") * F.col("ret")).otherwise(0.0))).alias("downside"),
    )
    g = g.withColumns({"sharpe": ratio(F.col("average"), F.col("stddev")), "sortino": ratio(F.col("average"), F.col("downside"))})
    f = PER_YEAR[unit]
    deepest = drawdown(equity, by, value).groupBy(*by).agg((F.max("drawdown") / 100).alias("_deepest"))
    g = g.join(runs, list(by)).join(deepest, list(by))
    g = g.withColumns({"annual": F.pow(1 + F.col("compound"), F.lit(f) / F.col("periods")) - 1, "volatility": F.col("stddev") * math.sqrt(f)})
    steady = F.when((F.col("average") > 0) & (F.col("stddev") > 0), F.greatest(F.lit(0.0), 50 * (1 - F.col("stddev") / F.col("average")))).otherwise(0.0)
    return g.withColumns({"calmar": F.when(F.col("_deepest") > 0, F.col("annual") / F.col("_deepest")).otherwise(0.0), "consistency": 50 * F.col("win_rate") + steady}).drop("_deepest")


def trade_analyzer(trades: DataFrame, by=("symbol",)) -> DataFrame:
    """Counts, profits, runs and lengths of closed trades, all together and by
    side; ``side`` and ``won`` are null where added up (a cube)."""
    t = trades.withColumn("side", F.when(F.col("size") > 0, "long").otherwise("short")).withColumn("won", F.col("pnlcomm") > 0)
    return t.cube(*by, "side", "won").agg(
        F.count("*").alias("trades"), F.sum("pnl").alias("gross"), F.sum("pnlcomm").alias("net"), F.avg("pnlcomm").alias("average"),
        F.max("pnlcomm").alias("best"), F.min("pnlcomm").alias("worst"), F.sum("bars").alias("bars"), F.avg("bars").alias("bars_average"), F.max("bars").alias("bars_max"), F.min("bars").alias("bars_min"),
    ).where(" and ".join(f"{k} is not null" for k in by))


def streaks(trades: DataFrame, by=("symbol",)) -> DataFrame:
    """Longest runs of won and lost trades."""
    w = W.partitionBy(*by).orderBy("closed")
    t = trades.withColumn("won", F.col("pnlcomm") > 0)
    t = t.withColumn("_run", F.sum(F.when(F.col("won") == F.lag("won").over(w), 0).otherwise(1)).over(w))
    r = t.groupBy(*by, "_run").agg(F.first("won").alias("won"), F.count("*").alias("n"))
    return r.groupBy(*by).agg(F.max(F.when(F.col("won"), F.col("n")).otherwise(0)).alias("won"), F.max(F.when(~F.col("won"), F.col("n")).otherwise(0)).alias("lost"))


def transactions(fills: DataFrame, unit: str = "day", by=("symbol",)) -> DataFrame:
    """Fills added up by period: number, bought, sold, value and fees."""
    f = fills.withColumn("period", bucket(F.col("ts"), unit))
    return f.groupBy(*by, "period").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("size") > 0, F.col("size")).otherwise(0.0)).alias("bought"), F.sum(F.when(F.col("size") < 0, -F.col("size")).otherwise(0.0)).alias("sold"),
        F.sum(F.col("size") * F.col("price")).alias("value"), F.sum("fee").alias("fees"),
    )


def round_trips(fills: DataFrame, by=("symbol",)) -> DataFrame:
    """Buys matched with sells first in, first out. Running totals of both sides
    cut the quantity into stretches, each of which lies in one buy and one sell:
    those that end next, which one window from the highest total down finds."""
    w = _w((*by, "_side")).rowsBetween(W.unboundedPreceding, 0)
    f = fills.where("size != 0").withColumn("_side", F.signum("size")).withColumn("_at", F.sum(F.abs("size")).over(w))
    mine = lambda s: F.when(F.col("_side") == s, F.struct("ts", "price"))
    down = W.partitionBy(*by).orderBy(F.desc("_at"), F.desc("_side"))
    so_far = down.rowsBetween(W.unboundedPreceding, 0)
    f = f.withColumns({"_buy": F.last(mine(1), ignorenulls=True).over(so_far), "_sell": F.last(mine(-1), ignorenulls=True).over(so_far), "quantity": F.col("_at") - F.coalesce(F.lead("_at").over(down), F.lit(0.0))})
    m = f.where("quantity > 1e-9 and _buy is not null and _sell is not null")
    m = m.select(*by, F.col("_buy.ts").alias("buy_ts"), F.col("_sell.ts").alias("sell_ts"), F.col("_buy.price").alias("buy_price"), F.col("_sell.price").alias("sell_price"), "quantity")
    return m.withColumn("pnl", F.col("quantity") * (F.col("sell_price") - F.col("buy_price")))


def position_stats(equity: DataFrame, by=("symbol",)) -> DataFrame:
    """Figures over all bars of what is held: mean, deviation, extremes of value
    and unrealised gain, the share of bars long and short."""
    p = positions(equity, by)
    return p.groupBy(*by).agg(
        F.avg("value").alias("average"), F.stddev_samp("value").alias("stddev"), F.max("value").alias("most"), F.min("value").alias("least"),
        F.max("pnl").alias("best"), F.min("pnl").alias("worst"), F.avg((F.col("value") > 0).cast("double")).alias("long_share"), F.avg((F.col("value") < 0).cast("double")).alias("short_share"),
    )


def leverage_stats(equity: DataFrame, by=("symbol",), column: str | None = None) -> DataFrame:
    """Mean, deviation and extremes of leverage, of ``column`` if it is there already."""
    lev = equity.select(*by, F.col(column).alias("leverage")) if column else leverage(equity, by)
    return lev.groupBy(*by).agg(F.avg("leverage").alias("average"), F.stddev_samp("leverage").alias("stddev"), F.max("leverage").alias("most"), F.min("leverage").alias("least"))


def value_stats(equity: DataFrame, by=("symbol",), value: str = "value") -> DataFrame:
    """Total value: first, last, extremes, mean, deviation and growth."""
    g = equity.groupBy(*by).agg(F.min_by(value, "ts").alias("first"), F.max_by(value, "ts").alias("last"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("average"), F.stddev_samp(value).alias("stddev"))
    return g.withColumn("growth", ratio(F.col("last"), F.col("first")) - 1)


def positions(equity: DataFrame, by=("symbol",)) -> DataFrame:
    """Value and unrealised gain of what is held at each bar."""
    return equity.select(*by, "ts", (F.col("position") * F.col("close")).alias("value"), (F.col("position") * (F.col("close") - F.col("price"))).alias("pnl"))


def leverage(equity: DataFrame, by=("symbol",)) -> DataFrame:
    return equity.select(*by, "ts", ratio(F.abs(F.col("position") * F.col("close")), F.col("value")).alias("leverage"))


def total_value(equity: DataFrame, by=("symbol",)) -> DataFrame:
    return equity.groupBy(*by).agg(F.min_by("value", "ts").alias("first"), F.max_by("value", "ts").alias("last"), F.min("value").alias("least"), F.max("value").alias("most"))


def log_returns(equity: DataFrame, per_year: float = 252.0, by=("symbol",), value: str = "value") -> DataFrame:
    """Observer: log return of each bar, their running sum and yearly mean."""
    w = _w(by)
    e = equity.withColumn("logret", F.log(ratio(F.col(value), F.lag(value).over(w))))
    far = w.rowsBetween(W.unboundedPreceding, 0)
    return e.select(*by, "ts", "logret", F.sum("logret").over(far).alias("total"), (F.avg("logret").over(far) * per_year).alias("annual"))


def benchmark(equity: DataFrame, other: DataFrame, by=("symbol",), value: str = "value") -> DataFrame:
    """Beta, correlation and tracking error of bar returns against another's."""
    r = lambda d, n: d.select(*by, "ts", (ratio(F.col(value), F.lag(value).over(_w(by))) - 1).alias(n))
    j = r(equity, "a").join(r(other, "b"), [*by, "ts"]).where("a is not null and b is not null")
    g = j.groupBy(*by).agg(F.corr("a", "b").alias("correlation"), F.covar_pop("a", "b").alias("_c"), F.var_pop("b").alias("_v"), F.stddev_pop(F.col("a") - F.col("b")).alias("tracking_error"))
    return g.select(*by, ratio(F.col("_c"), F.col("_v")).alias("beta"), "correlation", "tracking_error")


def buy_sell(bars: DataFrame, fills: DataFrame, by=("symbol",)) -> DataFrame:
    """Observer: bars with the prices bought and sold at, null otherwise."""
    f = fills.groupBy(*by, "ts").agg(F.max(F.when(F.col("size") > 0, F.col("price"))).alias("buy"), F.max(F.when(F.col("size") < 0, F.col("price"))).alias("sell"))
    return bars.select(*by, "ts", "close").join(f, [*by, "ts"], "left")


def trade_markers(bars: DataFrame, trades: DataFrame, by=("symbol",)) -> DataFrame:
    """Observer: bars with the net profit of trades closed there, gains and
    losses apart, null otherwise."""
    t = trades.groupBy(*by, F.col("closed").alias("ts")).agg(F.sum(F.when(F.col("pnlcomm") >= 0, F.col("pnlcomm"))).alias("gain"), F.sum(F.when(F.col("pnlcomm") < 0, F.col("pnlcomm"))).alias("loss"))
    return bars.select(*by, "ts", "close").join(t, [*by, "ts"], "left")


def fund(equity: DataFrame, start: float = 100.0, by=("symbol",), value: str = "value", flow: str | None = None) -> DataFrame:
    """Observer: fund value and shares. Without ``flow`` the shares are fixed at the
    first value; else that column is cash paid in (out if negative) at a row, which
    buys shares at the fund value and leaves that alone."""
    w = _w(by)
    first = F.first(value).over(w)
    if flow is None:
        return equity.select(*by, "ts", (ratio(F.col(value), first) * start).alias("fund_value"), (first / start).alias("fund_shares"))
    grown = F.coalesce(ratio(F.col(value) - F.coalesce(flow, F.lit(0.0)), F.lag(value).over(w)), F.lit(1.0))
    e = equity.withColumn("_g", F.log(grown))
    now = F.exp(F.sum("_g").over(w.rowsBetween(W.unboundedPreceding, 0))) * start
    return e.select(*by, "ts", now.alias("fund_value"), ratio(F.col(value), now).alias("fund_shares"))


def bundle(result: DataFrame, by=("symbol",)) -> dict[str, DataFrame]:
    """Returns, positions, transactions and leverage of a run together."""
    from .broker import equity as _equity
    from .broker import fills as _fills

    e, f = _equity(result, by), _fills(result, by)
    return {"returns": time_return(e, "day", by), "positions": positions(e, by), "transactions": f, "leverage": leverage(e, by)}
