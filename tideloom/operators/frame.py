"""Bars as a DataFrame, and window columns over them.

A bar frame has a row for each symbol and time with open, high, low, close,
volume and openinterest as doubles. All window columns of a frame share one
partitioning and one order, so Spark shuffles and sorts once however many
indicators are added.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume", "openinterest")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(df: DataFrame, by: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), rename: dict[str, str] | None = None) -> DataFrame:
    """Any frame as bars: names mapped, prices cast to double, NaN made null,
    missing fields null, and one row for each symbol and time (the last by all
    its values, so that repeated rows don't matter)."""
    for old, new in (rename or {}).items():
        df = df.withColumnRenamed(old, new)
    cells = []
    for f in FIELDS:
        x = F.col(f).cast("double") if f in df.columns else F.lit(None).cast("double")
        cells.append(F.when(~F.isnan(x), x).alias(f))
    keys = [*by, *order]
    best = F.max(F.struct(*FIELDS)).alias("_b")
    return df.select(*keys, *cells).groupBy(*keys).agg(best).select(*keys, "_b.*")


@dataclass(frozen=True)
class Bars:
    """A frame with its partitioning and order. Methods named after a window
    give Columns; ``put`` adds columns, which later windows may read."""

    df: DataFrame
    by: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)

    def put(self, **columns: Column) -> Bars:
        return Bars(self.df.withColumns(columns), self.by, self.order)

    def drop(self, *names: str) -> Bars:
        return Bars(self.df.drop(*names), self.by, self.order)

    def tidy(self) -> Bars:
        """Without the helper columns, whose names begin with an underscore."""
        return self.drop(*[c for c in self.df.columns if c.startswith("_")])

    @property
    def w(self):
        return W.partitionBy(*self.by).orderBy(*self.order)

    def last(self, n: int):
        """The last n rows."""
        return self.w.rowsBetween(-(n - 1), 0)

    @property
    def so_far(self):
        return self.w.rowsBetween(W.unboundedPreceding, 0)

    def number(self) -> Column:
        return F.row_number().over(self.w)

    def lag(self, x: str | Column, n: int = 1) -> Column:
        """n rows back, or ahead if negative."""
        return F.lag(col(x), n).over(self.w) if n >= 0 else F.lead(col(x), -n).over(self.w)

    def over(self, n: int, x: str | Column, agg: Callable[[Column], Column]) -> Column:
        """``agg`` of the last n values, null until n of them are there."""
        x = col(x)
        return F.when(F.count(x).over(self.last(n)) == n, agg(x).over(self.last(n)))

    def mean(self, x: str | Column, n: int) -> Column:
        return self.over(n, x, F.avg)

    def sum(self, x: str | Column, n: int) -> Column:
        return self.over(n, x, F.sum)

    def max(self, x: str | Column, n: int) -> Column:
        return self.over(n, x, F.max)

    def min(self, x: str | Column, n: int) -> Column:
        return self.over(n, x, F.min)

    def std(self, x: str | Column, n: int) -> Column:
        return self.over(n, x, F.stddev_pop)

    def values(self, x: str | Column, n: int) -> Column:
        """The last n values as an array, oldest first."""
        return self.over(n, x, F.collect_list)

    def weighted(self, x: str | Column, weights: Sequence[float]) -> Column:
        """Sum of the last len(weights) values by weight, oldest first."""
        n = len(weights)
        terms = [self.lag(x, n - 1 - i) * F.lit(float(w)) for i, w in enumerate(weights)]
        if n <= 12:
            out = terms[0]
            for t in terms[1:]:
                out = out + t
            return out
        arr = self.values(x, n)
        ws = F.array(*[F.lit(float(w)) for w in weights])
        return F.aggregate(F.zip_with(arr, ws, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def ratio(a: Column, b: Column, zero: Column | None = None) -> Column:
    """a / b; where b is zero ``zero``, or null."""
    return F.when(b != 0, a / b).otherwise(zero if zero is not None else F.lit(None).cast("double"))
