"""Exponential averages of series too long for one task.

A fold reads a symbol in one task. Here a series is cut into blocks of a time
unit, and those into pieces of a bounded number of rows. A step of the average
is y -> (1 - alpha) y + alpha x, so a piece as a whole is y -> a y + b: tasks
average their pieces from zero, a fold over one row a piece finds the state that
each piece starts from, and what this and the mean of the first n values add
fades by powers of 1 - alpha. A symbol with most of the rows is spread over as
many tasks as it has blocks; only rows of pieces go through one task.

Results are those of the folds up to rounding. Nulls give nulls and leave the
state alone. Times must be unique within a symbol, as in every bar frame. The
averaged pieces are written to the shared scratch folder and read again, so a
call runs jobs, a frame is shuffled once for each level of averages, and lineage
ends there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .folds import fold
from .frame import Bars

#: Powers of 1 - alpha within a piece stay above e to the minus this.
RANGE = 600.0


@dataclass(frozen=True)
class Average:
    """``out``: the average of ``x``, which starts at the mean of n values."""

    x: str
    n: int
    out: str
    alpha: float | None = None

    @property
    def step(self) -> float:
        return 2.0 / (self.n + 1) if self.alpha is None else self.alpha

    @property
    def keep(self) -> float:
        return 1 - self.step


class _Starts:
    """From the pieces in order, each by its number of values and its average
    from zero, to the state it starts from and the number of values before it."""

    def __init__(self, keep: float):
        self.keep, self.y, self.seen = keep, 0.0, 0.0

    def push(self, count: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        states, numbers = [], []
        for c, v in zip(count.tolist(), own.tolist(), strict=True):
            states.append(self.y)
            numbers.append(self.seen)
            self.y, self.seen = self.keep**c * self.y + v, self.seen + c
        return np.array(states), np.array(numbers)


def _kept(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _beside(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the other columns of ``small``, which has a row for each key, null or not."""
    small = small.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    on = [df[k].eqNullSafe(small[f"_r{i}"]) for i, k in enumerate(keys)]
    return df.join(small, on, "left").drop(*[f"_r{i}" for i in range(len(keys))])


def averages(b: Bars, wanted: Sequence[Average], unit: str = "month") -> Bars:
    """All of ``wanted`` in blocks of a ``unit``, which should hold no more rows of
    a symbol than a task can sort. An alpha of one gives the values themselves."""
    b = b.put(**{a.out: F.col(a.x).cast("double") for a in wanted if a.step >= 1})
    wanted = [a for a in wanted if a.step < 1]
    if not wanted:
        return b
    each = list(enumerate(wanted))
    block, piece = [*b.by, "_block"], [*b.by, "_block", "_piece"]
    rows = min(int(RANGE / -math.log(a.keep)) for a in wanted)
    number = F.row_number().over(W.partitionBy(*block).orderBy(*b.order))
    so_far = W.partitionBy(*piece).orderBy(*b.order).rowsBetween(W.unboundedPreceding, 0)
    df = b.df.withColumn("_block", F.date_trunc(unit, b.order[0])).withColumn("_piece", F.floor((number - 1) / rows))
    df = df.withColumns({f"_j{i}": F.count(a.x).over(so_far) for i, a in each})
    own = lambda i, a: F.pow(F.lit(a.keep), F.col(f"_j{i}")) * F.sum(a.step * F.col(a.x) * F.pow(F.lit(a.keep), -F.col(f"_j{i}"))).over(so_far)
    df = _kept(df.withColumns({f"_v{i}": F.coalesce(own(i, a), F.lit(0.0)) for i, a in each}))

    pieces = df.groupBy(*piece).agg(*[x for i, _ in each for x in (F.max(f"_j{i}").alias(f"_c{i}"), F.max_by(f"_v{i}", F.struct(*b.order)).alias(f"_b{i}"))])
    steps = [(lambda keep=a.keep: _Starts(keep), [f"_c{i}", f"_b{i}"], [f"_y{i}", f"_o{i}"]) for i, a in each]
    starts = _kept(fold(Bars(pieces, b.by, ("_block", "_piece")), steps).df.drop(*[f"{c}{i}" for i, _ in each for c in "_c _b".split()]))

    # The mean of the first n values, less what they made from zero.
    k = lambda i: F.col(f"_o{i}") + F.col(f"_j{i}")
    early = starts.where(F.greatest(*[F.lit(a.n) - F.col(f"_o{i}") for i, a in each], F.lit(0)) > 0)
    first = df.select(*piece, *{a.x for a in wanted}, *[f"_j{i}" for i, _ in each])
    first = _beside(first, early, piece).where(F.col("_o0").isNotNull()).groupBy(*b.by).agg(
        *[F.sum(F.when(k(i) <= a.n, F.col(a.x) * (1 / a.n - a.step * F.pow(F.lit(a.keep), a.n - k(i))))).alias(f"_h{i}") for i, a in each]
    )
    df = _beside(df, _beside(starts, first, b.by), piece)
    value = lambda i, a: F.col(f"_v{i}") + F.pow(F.lit(a.keep), F.col(f"_j{i}")) * F.col(f"_y{i}") + F.pow(F.lit(a.keep), k(i) - a.n) * F.col(f"_h{i}")
    df = df.withColumns({a.out: F.when(F.col(a.x).isNotNull() & (k(i) >= a.n), value(i, a)) for i, a in each})
    return Bars(df.drop("_block", "_piece", *[f"{c}{i}" for i, _ in each for c in ("_j", "_v", "_y", "_o", "_h")]), b.by, b.order)


def before(b: Bars, x: str, out: str, unit: str = "month") -> Bars:
    """The value of the row before, across blocks."""
    block = [*b.by, "_block"]
    w = W.partitionBy(*block).orderBy(*b.order)
    df = b.df.withColumn("_block", F.date_trunc(unit, b.order[0]))
    df = _kept(df.withColumns({"_first": F.row_number().over(w) == 1, out: F.lag(x).over(w)}))
    ends = df.groupBy(*block).agg(F.max_by(x, F.struct(*b.order)).alias("_end"))
    ends = ends.select(*block, F.lag("_end").over(W.partitionBy(*b.by).orderBy("_block")).alias("_end"))
    df = _beside(df, ends, block)
    return Bars(df.withColumn(out, F.when(F.col("_first"), F.col("_end")).otherwise(F.col(out))).drop("_first", "_end", "_block"), b.by, b.order)


def ema(b: Bars, n: int = 30, x: str = "close", out: str = "ema", unit: str = "month") -> Bars:
    return averages(b, [Average(x, n, out)], unit)


def smma(b: Bars, n: int = 30, x: str = "close", out: str = "smma", unit: str = "month") -> Bars:
    return averages(b, [Average(x, n, out, 1.0 / n)], unit)


def macd(b: Bars, fast: int = 12, slow: int = 26, signal: int = 9, x: str = "close", out: str = "macd", unit: str = "month") -> Bars:
    """``out``, ``out``_signal and ``out``_histo, null until the signal is there."""
    b = averages(b, [Average(x, fast, "_fast"), Average(x, slow, "_slow")], unit).put(_m=F.col("_fast") - F.col("_slow"))
    b = averages(b, [Average("_m", signal, f"{out}_signal")], unit)
    there = F.col(f"{out}_signal").isNotNull()
    return b.put(**{out: F.when(there, F.col("_m")), f"{out}_histo": F.col("_m") - F.col(f"{out}_signal")}).drop("_fast", "_slow", "_m")


def rsi(b: Bars, n: int = 14, x: str = "close", out: str = "rsi", unit: str = "month") -> Bars:
    """Smoothed gains over losses: 100 without losses, 50 without both."""
    b = before(b, x, "_before", unit)
    d = F.col(x) - F.col("_before")
    positive = lambda v: F.when(d.isNotNull(), F.greatest(v, F.lit(0.0)))
    b = b.put(_gain=positive(d), _loss=positive(-d))
    b = averages(b, [Average("_gain", n, "_up", 1.0 / n), Average("_loss", n, "_down", 1.0 / n)], unit)
    up, down = F.col("_up"), F.col("_down")
    value: Column = F.when(down == 0, F.when(up == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + up / F.nullif(down, F.lit(0.0))))
    return b.put(**{out: value}).drop("_before", "_gain", "_loss", "_up", "_down")
