"""Arithmetic and logic on value columns, with the rules of bar data: a null
or NaN makes comparisons false, truth is 1.0 or 0.0, and division never fails."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as _fold

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def known(*xs: Column) -> Column:
    return _fold(lambda a, b: a & b, [x.isNotNull() & ~F.isnan(x.cast("double")) for x in xs])


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def div(a: Column, b: Column) -> Column:
    """a / b; null where b is zero."""
    return F.when(b != 0, a / b)


def div_by_zero(a: Column, b: Column, zero: float = 0.0) -> Column:
    return F.when(b != 0, a / b).when(b == 0, F.lit(zero))


def div_zero_by_zero(a: Column, b: Column, single: float = float("inf"), dual: float = 0.0) -> Column:
    """x / 0 is ``single`` and 0 / 0 is ``dual``."""
    return F.when(b != 0, a / b).when((b == 0) & (a == 0), F.lit(dual)).when(b == 0, F.lit(single))


def lt(a, b): return flag(known(number(a), number(b)) & (number(a) < number(b)))  # noqa: E704
def le(a, b): return flag(known(number(a), number(b)) & (number(a) <= number(b)))  # noqa: E704
def gt(a, b): return flag(known(number(a), number(b)) & (number(a) > number(b)))  # noqa: E704
def ge(a, b): return flag(known(number(a), number(b)) & (number(a) >= number(b)))  # noqa: E704
def eq(a, b): return flag(known(number(a), number(b)) & (number(a) == number(b)))  # noqa: E704


def ne(a, b) -> Column:
    """True also where either is missing."""
    return flag(~known(number(a), number(b)) | (number(a) != number(b)))


def cmp(a: Column, b: Column) -> Column:
    return F.when(a < b, -1.0).when(a > b, 1.0).when(a == b, 0.0)


def cmp_ex(a: Column, b: Column, less: Column, same: Column, more: Column) -> Column:
    return F.when(a < b, less).when(a == b, same).when(a > b, more)


def if_(cond: Column, a: Column, b: Column) -> Column:
    """``a`` where the condition is neither zero, false nor missing."""
    return F.when(truth(cond), a).otherwise(b)


def truth(x: Column) -> Column:
    return F.coalesce(x.cast("double") != 0, F.lit(False))


def and_(*xs: Column) -> Column:
    return flag(_fold(lambda a, b: a & b, [truth(x) for x in xs]))


def or_(*xs: Column) -> Column:
    return flag(_fold(lambda a, b: a | b, [truth(x) for x in xs]))


all_, any_ = and_, or_


def not_(x: Column) -> Column:
    return flag(~truth(x))


def max_(*xs: Column) -> Column:
    return F.greatest(*xs) if len(xs) > 1 else xs[0]


def min_(*xs: Column) -> Column:
    return F.least(*xs) if len(xs) > 1 else xs[0]


def sum_(*xs: Column) -> Column:
    return _fold(lambda a, b: a + b, xs)


def reduce(f: Callable[[Column, Column], Column], *xs: Column) -> Column:
    return _fold(f, xs)
