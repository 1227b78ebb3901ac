"""Entry and exit signals as 1.0 / 0.0 columns, and rules made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lines import flag, truth
from .folds import Counting, fold
from .frame import Bars, col

#: Kinds of signal: the sides they act on.
KINDS = ("LONGSHORT", "LONG", "LONG_INV", "LONG_ANY", "SHORT", "SHORT_INV", "SHORT_ANY", "LONGEXIT", "LONGEXIT_INV", "LONGEXIT_ANY", "SHORTEXIT", "SHORTEXIT_INV", "SHORTEXIT_ANY", "NONE")


def direction(kind: str, value: Column) -> Column:
    """What a value means to a kind of signal: 1 buy side, -1 sell side, 0 none.
    _INV turns the sign round and _ANY takes any value but zero."""
    v = F.coalesce(value.cast("double"), F.lit(0.0))
    if kind == "NONE":
        return F.lit(0.0)
    base = kind.removesuffix("_INV").removesuffix("_ANY")
    v = -v if kind.endswith("_INV") else v
    up, down = F.when(v > 0, 1.0).otherwise(0.0), F.when(v < 0, -1.0).otherwise(0.0)
    if kind.endswith("_ANY"):
        up, down = F.when(v != 0, 1.0).otherwise(0.0), F.when(v != 0, -1.0).otherwise(0.0)
    return {"LONGSHORT": up + down, "LONG": up, "SHORT": down, "LONGEXIT": down, "SHORTEXIT": up}[base]


def crossing(b: Bars, fast: str, slow: str, long: bool = True, out: str = "signal") -> Bars:
    """1 where fast turns from below slow to above it, or the other way."""
    below = F.when(col(fast) < col(slow), 1.0).when(col(fast) > col(slow), -1.0)
    b = b.put(_s=below)
    b = b.put(_was=F.last("_s", ignorenulls=True).over(b.w.rowsBetween(-(1 << 31) + 1, -1)))
    want = 1.0 if long else -1.0
    return b.put(**{out: flag((F.col("_was") == want) & (F.col("_s") == -want))}).drop("_s", "_was")


def simple(condition: Column) -> Column:
    return flag(F.coalesce(condition, F.lit(False)))


def threshold(b: Bars, x: str, level: float, above: bool = True, out: str = "signal") -> Bars:
    """1 where the value comes to be above (below) a level."""
    was = b.lag(x)
    hit = (was <= level) & (col(x) > level) if above else (was >= level) & (col(x) < level)
    return b.put(**{out: simple(hit)})


def composite(logic: str, *signals: Column) -> Column:
    """and, or, xor (exactly one), nand or nor of signals."""
    ts = [truth(s) for s in signals]
    every, some = reduce(lambda a, b: a & b, ts), reduce(lambda a, b: a | b, ts)
    one = reduce(lambda a, b: a + b, [t.cast("int") for t in ts]) == 1
    return flag({"and": every, "or": some, "xor": one, "nand": ~every, "nor": ~some}[logic])


def delayed(b: Bars, signal: str, n: int, out: str = "signal") -> Bars:
    return b.put(**{out: F.coalesce(b.lag(signal, n), F.lit(0.0))})


def filtered(signal: Column, condition: Column) -> Column:
    return flag(truth(signal) & truth(condition))


def counting(b: Bars, signal: str, k: int, reset: int = 0, out: str = "signal") -> Bars:
    """1 on every k-th hit; ``reset`` bars without one start over."""
    return fold(b, [(lambda: Counting(k, reset), [signal], [out])])
