"""Recursions with coefficients of their own in pieces, for series too long for
one task.

A step y -> A y + b of a state of k numbers is an affine map, with coefficients that may differ
from row to row; maps one after another are again one. Rows of a series
are numbered without sorting it as a whole, dealt into pieces of ``rows`` rows
and composed within their piece, side by side; a fold over one row a piece
finds the state that each piece starts from, and a row's value is its composed
map of that state. What a coefficient reads of earlier rows comes with a halo: a
piece also gets the last rows of the one before. A start of a series is a map
with A = 0.

Results equal the folds of the same names up to rounding. Rows whose inputs are null
or NaN get nulls and leave the state alone. Times must be unique within a
series. Intermediate tables are written to the shared scratch folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import _beside, _kept
from .folds import fold
from .frame import Bars, ratio

ROWS = 100_000
NAN = float("nan")


def composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each map after all before it: a (n, k, k), b (n, k)."""
    a, b, d = a.copy(), b.copy(), 1
    while d < len(a):
        b[d:] = np.einsum("nij,nj->ni", a[d:], b[:-d]) + b[d:]
        a[d:] = a[d:] @ a[:-d]
        d *= 2
    return a, b


class _Piece:
    """Maps of a piece, row by row, composed. ``maps`` is given the inputs with ``halo`` rows
    before and the rows' numbers, and returns (a, b, whether there is a value)."""

    def __init__(self, maps: Callable[..., tuple], k: int, halo: int):
        self.maps, self.k, self.halo = maps, k, halo
        self.held: np.ndarray | None = None
        self.a, self.b = np.eye(k), np.zeros(k)

    def push(self, number: np.ndarray, own: np.ndarray, *inputs: np.ndarray) -> tuple[np.ndarray, ...]:
        x = np.stack(inputs)
        before = np.full((len(x), self.halo), NAN) if self.held is None else self.held
        wide = np.concatenate([before, x], axis=1)
        self.held = wide[:, wide.shape[1] - self.halo :]
        a, b, there = self.maps(wide, number.astype(np.int64))
        mine = own > 0
        out = np.full((len(number), self.k * self.k + self.k + 1), NAN)
        if mine.any():
            a, b = a[mine], b[mine]
            b[0] += a[0] @ self.b
            a[0] = a[0] @ self.a
            a, b = composed(a, b)
            self.a, self.b = a[-1], b[-1]
            out[mine] = np.concatenate([a.reshape(len(a), -1), b, there[mine][:, None]], axis=1)
        return tuple(out.T)


class _Starts:
    """From the whole maps of a series' pieces, in order, to the state each starts from."""

    def __init__(self, k: int):
        self.k, self.y = k, np.zeros(k)

    def push(self, *cells: np.ndarray) -> tuple[np.ndarray, ...]:
        out = []
        for row in np.stack(cells).T:
            out.append(self.y)
            self.y = row[: self.k**2].reshape(self.k, self.k) @ self.y + row[self.k**2 :]
        return tuple(np.array(out).reshape(-1, self.k).T)


def numbered(b: Bars, unit: str = "month") -> DataFrame:
    """Rows with their number in the series, from 1: rows of a time unit are
    numbered where they are, and a unit begins where those before it end."""
    block = [*b.by, "_block"]
    df = b.df.withColumn("_block", F.date_trunc(unit, b.order[0]))
    df = _kept(df.withColumn("_j", F.row_number().over(W.partitionBy(*block).orderBy(*b.order))))
    sizes = df.groupBy(*block).agg(F.count("*").alias("_c"))
    before = W.partitionBy(*b.by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*block, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    return _beside(df, starts, block).withColumn("_i", F.col("_o") + F.col("_j")).drop("_block", "_j", "_o")


def dealt(df: DataFrame, rows: int, halo: int) -> DataFrame:
    """Numbered rows by piece; the last ``halo`` of a piece also go to the next, as not its own."""
    at = F.col("_i") - 1
    piece = F.floor(at / rows)
    one = lambda p, own: F.struct(p.alias("_piece"), F.lit(own).alias("_own"))
    to = F.when(at % rows >= rows - halo, F.array(one(piece, 1.0), one(piece + 1, 0.0))).otherwise(F.array(one(piece, 1.0))) if halo else F.array(one(piece, 1.0))
    return df.withColumn("_to", F.explode(to)).select(*df.columns, "_to._piece", "_to._own")


def scan(df: DataFrame, by: Sequence[str], inputs: Sequence[str], maps: Callable[..., tuple], k: int, out: Sequence[str], rows: int = ROWS, halo: int = 0) -> DataFrame:
    """Numbered rows with the ``k`` columns ``out``: the state after each row."""
    if not 0 <= halo <= rows:
        raise ValueError("a halo longer than a piece")
    names = [f"_a{i}" for i in range(k * k)] + [f"_b{i}" for i in range(k)]
    piece = (*by, "_piece")
    got = fold(Bars(dealt(df, rows, halo), piece, ("_i",)), [(lambda: _Piece(maps, k, halo), ["_i", "_own", *inputs], [*names, "_there"])]).df
    got = _kept(got.where("_own > 0").drop("_own"))
    whole = got.groupBy(*piece).agg(*[F.max_by(c, "_i").alias(c) for c in names])
    starts = _kept(fold(Bars(whole, tuple(by), ("_piece",)), [(lambda: _Starts(k), names, [f"_y{i}" for i in range(k)])]).df.drop(*names))
    df = _beside(got, starts, piece)
    value = lambda r: reduce(lambda x, y: x + y, [F.col(f"_a{r * k + c}") * F.col(f"_y{c}") for c in range(k)], F.col(f"_b{r}"))
    df = df.withColumns({o: F.when(F.col("_there") > 0, value(r)) for r, o in enumerate(out)})
    return df.drop("_piece", "_there", *names, *[f"_y{i}" for i in range(k)])


def _split(b: Bars, inputs: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose inputs are all numbers, and the others."""
    good = reduce(lambda x, y: x & y, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in inputs])
    return b.df.where(good), b.df.where(~good)


def _joined(b: Bars, done: DataFrame, others: DataFrame, out: Sequence[str]) -> Bars:
    columns = [*b.df.columns, *out]
    others = others.withColumns({c: F.lit(None).cast("double") for c in out})
    return Bars(done.select(*columns).unionByName(others.select(*columns)), b.by, b.order)


def kama(b: Bars, n: int = 30, fast: int = 2, slow: int = 30, x: str = "close", out: str = "kama", stepped: bool = False, rows: int = ROWS, unit: str = "month") -> Bars:
    """``folds.Kama``: y -> (1 - c) y + c x, with c of the efficiency of the last n changes."""
    quick, calm = 2.0 / (fast + 1), 2.0 / (slow + 1)

    def maps(wide: np.ndarray, number: np.ndarray) -> tuple:
        v = wide[0]
        view = np.lib.stride_tricks.sliding_window_view(v, n + 1)
        view = view[len(view) - len(number) :]  # the last n + 1 values of each row
        now, first = view[:, -1], number == n + 1
        path = np.abs(np.diff(view, axis=1)).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio_ = np.where(path > 0, np.abs(now - view[:, 0]) / path, 0.0)
        c = (ratio_ * (quick - calm) + calm) ** 2
        seed = (1 - c) * view[:, :n].mean(axis=1) + c * now if stepped else view[:, 1:].mean(axis=1)
        there = number > n
        a = np.where(there & ~first, 1 - c, 0.0)
        step = np.where(first, seed, np.where(there, c * now, 0.0))
        return a[:, None, None], step[:, None], there

    good, others = _split(b, [x])
    done = scan(numbered(Bars(good, b.by, b.order), unit), b.by, [x], maps, 1, [out], max(rows, n + 1), n)
    return _joined(b, done, others, [out])


def laguerre(b: Bars, gamma: float = 0.5, n: int = 6, x: str = "close", out: str = "lagf", rsi: str = "lrsi", rows: int = ROWS, unit: str = "month") -> Bars:
    """``folds.Laguerre``: four stages, one map of four by four from the n-th row on."""
    g = gamma
    a = np.zeros((4, 4))
    c = np.zeros(4)
    a[0, 0], c[0] = g, 1 - g
    for r in range(1, 4):  # stage r is -g of the new stage before, the old one before, and g of its own
        a[r], c[r] = -g * a[r - 1], -g * c[r - 1]
        a[r, r - 1] += 1
        a[r, r] += g

    def maps(wide: np.ndarray, number: np.ndarray) -> tuple:
        there = number >= n
        return np.where(there[:, None, None], a, 0.0), np.where(there[:, None], wide[0][len(wide[0]) - len(number) :, None] * c, 0.0), there

    good, others = _split(b, [x])
    stages = [f"_l{i}" for i in range(4)]
    done = scan(numbered(Bars(good, b.by, b.order), unit), b.by, [x], maps, 4, stages, rows)
    s = [F.col(c) for c in stages]
    up = reduce(lambda p, q: p + q, [F.greatest(s[i] - s[i + 1], F.lit(0.0)) for i in range(3)])
    down = reduce(lambda p, q: p + q, [F.greatest(s[i + 1] - s[i], F.lit(0.0)) for i in range(3)])
    value = F.when(up + down != 0, up / (up + down)).otherwise(F.when(s[0].isNotNull(), 1.0))
    done = done.withColumns({out: (s[0] + 2 * s[1] + 2 * s[2] + s[3]) / 6, rsi: value}).drop(*stages)
    return _joined(b, done, others, [out, rsi])


def _smoothed(n: int, first: int) -> Callable[..., tuple]:
    """Smoothed averages of all inputs at once, seeded on row ``first`` by the mean of n."""

    def maps(wide: np.ndarray, number: np.ndarray) -> tuple:
        k, m = len(wide), len(number)
        now = wide[:, wide.shape[1] - m :].T
        b = now / n
        for i in np.flatnonzero(number == first):
            b[i] = wide[:, wide.shape[1] - m + i - n + 1 : wide.shape[1] - m + i + 1].mean(axis=1)
        a = np.where((number > first)[:, None, None], np.eye(k) * (1 - 1 / n), 0.0)
        return a, np.where((number >= first)[:, None], b, 0.0), number >= first

    return maps


def lagged(df: DataFrame, by: Sequence[str], columns: dict[str, str], n: int, rows: int) -> DataFrame:
    """Numbered rows with the values n rows back, across pieces."""
    w = W.partitionBy(*by, "_piece").orderBy("_i")
    out = dealt(df, rows, n).withColumns({o: F.lag(c, n).over(w) for c, o in columns.items()})
    return out.where("_own > 0").drop("_piece", "_own")


def directional(b: Bars, n: int = 14, rows: int = ROWS, unit: str = "month", out: Sequence[str] = ("adx", "adxr", "plus_di", "minus_di")) -> Bars:
    """``folds.Directional``: (adx, adxr, +di, -di) of high, low and close."""
    rows = max(rows, 3 * n + 1)
    good, others = _split(b, ["high", "low", "close"])
    df = lagged(numbered(Bars(good, b.by, b.order), unit), b.by, {"high": "_h", "low": "_l", "close": "_c"}, 1, rows)
    up, down = F.col("high") - F.col("_h"), F.col("_l") - F.col("low")
    df = df.withColumns({
        "_tr": F.greatest("high", "_c") - F.least("low", "_c"), "_plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "_minus": F.when((down > up) & (down > 0), down).otherwise(0.0),
    })
    df = scan(df, b.by, ["_tr", "_plus", "_minus"], _smoothed(n, n + 1), 3, ["_atr", "_p", "_m"], rows, n)
    plus, minus = ratio(100 * F.col("_p"), F.col("_atr")), ratio(100 * F.col("_m"), F.col("_atr"))
    df = df.withColumns({out[2]: plus, out[3]: minus})
    both = F.col(out[2]) + F.col(out[3])
    df = df.withColumn("_dx", F.coalesce(ratio(100 * F.abs(F.col(out[2]) - F.col(out[3])), both, F.lit(0.0)), F.lit(0.0)))
    df = scan(df, b.by, ["_dx"], _smoothed(n, 2 * n), 1, [out[0]], rows, n)
    df = lagged(df, b.by, {out[0]: "_back"}, n, rows).withColumn(out[1], (F.col(out[0]) + F.col("_back")) / 2)
    return _joined(b, df, others, out)
