"""Parameter sweeps as one job, and strategies ready to run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import analyzers
from ..operators.broker import Rules, equity, run, trades
from ..operators.frame import Bars
from ..operators.strategy import Strategy, run_strategy
from ..operators.windows import crossover


def grid(**ranges: Sequence) -> list[dict]:
    """Every combination of the given values."""
    return [dict(zip(ranges, v, strict=True)) for v in product(*ranges.values())]


def mean_cross_orders(bars: DataFrame, n: int = 15, size: float = 1.0, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Buy where the close rises through its mean, sell where it falls."""
    b = Bars(bars, by)
    b = crossover(b.put(_m=b.mean("close", n)), "close", "_m", "_x")
    return b.put(order=F.when(F.col("_x") > 0, F.lit(float(size))).when(F.col("_x") < 0, F.lit(-float(size)))).tidy().df


def backtest(bars: DataFrame, n: int = 15, rules: Rules = Rules(mode="long"), size: float = 1.0) -> DataFrame:
    return run(mean_cross_orders(bars, n, size), rules)


def sweep(bars: DataFrame, periods: Sequence[int], rules: Rules = Rules(mode="long"), size: float = 1.0) -> DataFrame:
    """Final value, drawdown and trades of the close crossing its mean, for every
    mean length and symbol."""
    out = sweep_grid(bars, [{"fast": 1, "slow": n} for n in periods], rules, size)
    return out.withColumnRenamed("slow", "period").drop("fast")


def sweep_grid(bars: DataFrame, combinations: Sequence[dict], rules: Rules = Rules(mode="long"), size: float = 1.0) -> DataFrame:
    """A fast mean crossing a slow one, for every combination (``fast`` and
    ``slow`` lengths, 1 being the close itself) and symbol: final value, cash,
    trades, return and drawdown.

    The mean of each length is one window column, all in one pass over the
    bars; only then is a bar multiplied by the combinations, with the two means
    each needs, and the orders are worked by (symbol, combination) in one job."""
    lengths = sorted({n for c in combinations for n in (c["fast"], c["slow"])})
    b = Bars(bars)
    b = b.put(**{f"_m{n}": F.col("close") if n == 1 else b.mean("close", n) for n in lengths})
    each = F.explode(F.array(*[F.struct(F.lit(int(c["fast"])).alias("fast"), F.lit(int(c["slow"])).alias("slow"), F.col(f"_m{c['fast']}").alias("a"), F.col(f"_m{c['slow']}").alias("b")) for c in combinations]))
    by = ("symbol", "fast", "slow")
    wide = b.df.select(*bars.columns, each.alias("_c")).select(*bars.columns, "_c.fast", "_c.slow", F.col("_c.a").alias("_a"), F.col("_c.b").alias("_b"))
    b = crossover(Bars(wide, by), "_a", "_b", "_x")
    orders = b.put(order=F.when(F.col("_x") > 0, F.lit(float(size))).when(F.col("_x") < 0, F.lit(-float(size)))).tidy().df
    return outcomes(run(orders, rules, by), by, rules.cash)


def sweep_strategy(bars: DataFrame, make: Callable[..., Strategy], combinations: Sequence[dict], rules: Rules = Rules(), columns: Sequence[str] = ()) -> DataFrame:
    """A strategy with every combination of its parameters, on every symbol: final
    value, cash, trades, return and drawdown. Bars are multiplied by the combinations
    after the strategy's columns are made, and one job is dealt by (symbol, parameters)."""
    names = list(combinations[0])
    each = F.explode(F.array(*[F.struct(*[F.lit(c[n]).alias(n) for n in names]) for c in combinations]))
    by = ("symbol", *names)
    wide = bars.withColumn("_c", each).select(*bars.columns, *[F.col(f"_c.{n}").alias(n) for n in names])
    return outcomes(run_strategy(wide, make, rules, columns, by, params=names), by, rules.cash)


def outcomes(result: DataFrame, by: tuple[str, ...], cash: float) -> DataFrame:
    """One row a series of a result: where it ended, its trades and its deepest drawdown."""
    peak = F.max("value").over(W.partitionBy(*by).orderBy("ts"))
    result = result.withColumn("_down", 100 * (peak - F.col("value")) / peak)
    last = result.groupBy(*by).agg(F.max_by("value", "ts").alias("value"), F.max_by("cash", "ts").alias("cash"), F.sum(F.size("trades")).alias("trades"), F.max("_down").alias("drawdown"))
    return last.withColumn("total_return", F.col("value") / F.lit(cash) - 1)


def ranked(results: DataFrame, metric: str = "total_return", most: int | None = None, ascending: bool = False) -> DataFrame:
    """Best first by any column, ties by symbol and parameters."""
    rest = [c for c in ("symbol", "period", "fast", "slow") if c in results.columns]
    out = results.orderBy(F.asc(metric) if ascending else F.desc(metric), *rest)
    return out.limit(most) if most else out


def report(bars: DataFrame, n: int = 15, rules: Rules = Rules(mode="long")) -> dict[str, DataFrame]:
    """A backtest with its tables and figures."""
    result = backtest(bars, n, rules)
    e, t = equity(result), trades(result)
    return {"equity": e, "trades": t, "drawdown": analyzers.drawdown(e), "returns": analyzers.returns(e), "sqn": analyzers.sqn(t), "trade_analyzer": analyzers.trade_analyzer(t)}
