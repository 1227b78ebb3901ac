"""Indicators over finite frames: plain window expressions.

Each takes a ``Bars`` and gives it back with the named columns added. They are
null until the frame is full; a null input makes the frames that hold it null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frame import Bars, col, ratio

# --- moving averages -------------------------------------------------------


def sma(b: Bars, n: int = 30, x: str = "close", out: str = "sma") -> Bars:
    """Mean of the last n values."""
    return b.put(**{out: b.mean(x, n)})


def wma(b: Bars, n: int = 30, x: str = "close", out: str = "wma") -> Bars:
    """Weights 1..n, the newest heaviest, over their sum."""
    return b.put(**{out: b.weighted(x, range(1, n + 1)) * F.lit(2.0 / (n * (n + 1)))})


def weighted_average(b: Bars, weights: Sequence[float], coef: float = 1.0, x: str = "close", out: str = "weighted") -> Bars:
    return b.put(**{out: b.weighted(x, weights) * F.lit(float(coef))})


def hma(b: Bars, n: int = 30, x: str = "close", out: str = "hma") -> Bars:
    """WMA over sqrt(n) of 2 WMA(n / 2) - WMA(n)."""
    half, root = n // 2, math.isqrt(n)
    b = wma(wma(b, half, x, "_h1"), n, x, "_h2").put(_h3=2 * F.col("_h1") - F.col("_h2"))
    return wma(b, root, "_h3", out).drop("_h1", "_h2", "_h3")


# --- momentum and oscillators ----------------------------------------------


def momentum(b: Bars, n: int = 12, x: str = "close", out: str = "momentum") -> Bars:
    return b.put(**{out: col(x) - b.lag(x, n)})


def momentum_oscillator(b: Bars, n: int = 12, x: str = "close", out: str = "momentumosc") -> Bars:
    return b.put(**{out: ratio(100 * col(x), b.lag(x, n))})


def roc(b: Bars, n: int = 12, x: str = "close", out: str = "roc", scale: float = 1.0) -> Bars:
    """Rate of change; ``scale`` 100 gives ROC100."""
    return b.put(**{out: ratio(col(x) - b.lag(x, n), b.lag(x, n)) * F.lit(float(scale))})


def percent_change(b: Bars, n: int = 30, x: str = "close", out: str = "pctchange") -> Bars:
    """As ROC; from zero it is infinite by the sign of the value."""
    past = b.lag(x, n)
    inf = F.when(col(x) >= 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return b.put(**{out: F.when(past.isNotNull(), ratio(col(x) - past, past, inf))})


def percent_rank(b: Bars, n: int = 50, x: str = "close", out: str = "pctrank") -> Bars:
    """Share of the last n values, itself included, below the value."""
    b = b.put(_pr=b.values(x, n))
    below = F.size(F.filter("_pr", lambda v: v < col(x)))
    return b.put(**{out: F.when(F.col("_pr").isNotNull(), below / F.lit(float(n)))}).drop("_pr")


def kst(b: Bars, rocs=(10, 15, 20, 30), means=(10, 10, 10, 10), factors=(1, 2, 3, 4), signal: int = 9, x: str = "close", out: str = "kst") -> Bars:
    """Weighted sum of four smoothed rates of change, and its mean."""
    names = [f"_k{i}" for i in range(len(rocs))]
    b = b.put(**{k: ratio(100 * (col(x) - b.lag(x, r)), b.lag(x, r)) for k, r in zip(names, rocs, strict=True)})
    total: Column = F.lit(0.0)
    for k, m, f in zip(names, means, factors, strict=True):
        total = total + b.mean(k, m) * F.lit(float(f))
    b = b.put(**{out: total}).drop(*names)
    return b.put(**{f"{out}_signal": b.mean(out, signal)})


def dpo(b: Bars, n: int = 20, x: str = "close", out: str = "dpo") -> Bars:
    """Value less its mean as of n / 2 - 1 bars ago."""
    b = b.put(_d=b.mean(x, n))
    return b.put(**{out: col(x) - b.lag("_d", n // 2 - 1)}).drop("_d")


def dv2(b: Bars, n: int = 252, mean: int = 2, out: str = "dv2") -> Bars:
    """Percent rank of the smoothed close over the middle of the bar."""
    b = b.put(_v=ratio(F.col("close"), (F.col("high") + F.col("low")) / 2))
    b = b.put(_m=b.mean("_v", mean))
    return percent_rank(b, n, "_m", "_p").put(**{out: F.col("_p") * 100}).drop("_v", "_m", "_p")


def cci(b: Bars, n: int = 20, factor: float = 0.015, out: str = "cci") -> Bars:
    """Typical price against its mean, by the mean of its past deviations."""
    b = b.put(_t=(F.col("high") + F.col("low") + F.col("close")) / 3)
    b = b.put(_m=b.mean("_t", n))
    b = b.put(_a=F.abs(F.col("_t") - F.col("_m")))
    return b.put(**{out: ratio(F.col("_t") - F.col("_m"), b.mean("_a", n) * F.lit(factor))}).drop("_t", "_m", "_a")


def ultimate(b: Bars, p1: int = 7, p2: int = 14, p3: int = 28, out: str = "uo") -> Bars:
    """Buying pressure over true range at three lengths, 4:2:1."""
    before = b.lag("close")
    low, high = F.least("low", before), F.greatest("high", before)
    b = b.put(_bp=F.when(before.isNotNull(), F.col("close") - low), _tr=F.when(before.isNotNull(), high - low))
    a = [ratio(b.sum("_bp", p), b.sum("_tr", p)) for p in (p1, p2, p3)]
    return b.put(**{out: 100 * (4 * a[0] + 2 * a[1] + a[2]) / 7}).drop("_bp", "_tr")


def stochastic(b: Bars, n: int = 14, k: int = 3, d: int = 3, out: str = "stoch") -> Bars:
    """Full stochastic: ``out``_raw, ``out``_k (slow %K) and ``out``_d. The fast
    one is raw and _k, the slow one _k and _d. Flat windows give null."""
    b = b.put(_hh=b.max("high", n), _ll=b.min("low", n))
    b = b.put(**{f"{out}_raw": ratio(100 * (F.col("close") - F.col("_ll")), F.col("_hh") - F.col("_ll"))}).drop("_hh", "_ll")
    b = b.put(**{f"{out}_k": b.mean(f"{out}_raw", k)})
    return b.put(**{f"{out}_d": b.mean(f"{out}_k", d)})


def williams_r(b: Bars, n: int = 14, out: str = "williamsr", flat: float | None = None) -> Bars:
    """-100 (highest - close) / (highest - lowest); ``flat`` where they meet."""
    b = b.put(_hh=b.max("high", n), _ll=b.min("low", n))
    zero = F.lit(flat).cast("double")
    r = F.when(F.col("_hh").isNotNull(), ratio(100 * (F.col("close") - F.col("_hh")), F.col("_hh") - F.col("_ll"), zero))
    return b.put(**{out: r}).drop("_hh", "_ll")


def williams_ad(b: Bars, out: str = "williamsad") -> Bars:
    """Running sum of close less true low on rises, less true high on falls."""
    before = b.lag("close")
    c = F.col("close")
    move = F.when(c > before, c - F.least("low", before)).when(c < before, c - F.greatest("high", before)).otherwise(0.0)
    b = b.put(_w=F.when(before.isNotNull(), move))
    return b.put(**{out: F.sum("_w").over(b.so_far)}).drop("_w")


def awesome(b: Bars, fast: int = 5, slow: int = 34, out: str = "ao") -> Bars:
    b = b.put(_m=(F.col("high") + F.col("low")) / 2)
    return b.put(**{out: b.mean("_m", fast) - b.mean("_m", slow)}).drop("_m")


def acceleration(b: Bars, n: int = 5, out: str = "accdec") -> Bars:
    """Awesome oscillator less its mean."""
    b = awesome(b, out="_ao")
    return b.put(**{out: F.col("_ao") - b.mean("_ao", n)}).drop("_ao")


# --- trend -------------------------------------------------------------------


def up_move(b: Bars, x: str = "close", out: str = "upmove") -> Bars:
    return b.put(**{out: col(x) - b.lag(x)})


def down_move(b: Bars, x: str = "close", out: str = "downmove") -> Bars:
    return b.put(**{out: b.lag(x) - col(x)})


def aroon(b: Bars, n: int = 14, out: str = "aroon", rows: int | None = None, newest: bool = True) -> Bars:
    """_up and _down: how recent the extreme is, and _osc, their difference.
    Looked at are ``rows`` bars (n + 1); of equal extremes the newest counts,
    or the oldest."""
    rows = rows or n + 1
    b = b.put(_hs=b.values("high", rows), _ls=b.values("low", rows))

    def recent(arr: str, best: Column) -> Column:
        if newest:
            ago = F.array_position(F.reverse(arr), best) - 1
        else:
            ago = F.lit(rows) - F.array_position(arr, best)
        return 100 * (F.lit(n) - ago) / F.lit(float(n))

    b = b.put(**{f"{out}_up": recent("_hs", F.array_max("_hs")), f"{out}_down": recent("_ls", F.array_min("_ls"))}).drop("_hs", "_ls")
    return b.put(**{f"{out}_osc": F.col(f"{out}_up") - F.col(f"{out}_down")})


def vortex(b: Bars, n: int = 14, out: str = "vortex") -> Bars:
    """_plus and _minus: |high - last low| and |low - last high| over true range."""
    h, lo, before = b.lag("high"), b.lag("low"), b.lag("close")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    b = b.put(_p=F.abs(F.col("high") - lo), _m=F.abs(F.col("low") - h), _t=F.when(before.isNotNull(), tr))
    zero = F.lit(0.0)
    total = b.sum("_t", n)
    made = {f"{out}_{k}": F.when(total.isNotNull(), ratio(b.sum(c, n), total, zero)) for k, c in (("plus", "_p"), ("minus", "_m"))}
    return b.put(**made).drop("_p", "_m", "_t")


def ichimoku(b: Bars, tenkan: int = 9, kijun: int = 26, senkou: int = 52, lead: int = 26, chikou: int = 26, out: str = "ichimoku") -> Bars:
    """Five lines; the two spans are ``lead`` bars old and the lagging span is
    the close ``chikou`` bars ahead, so it must not feed a strategy."""
    mid = lambda n: (b.max("high", n) + b.min("low", n)) / 2
    b2 = b.put(**{f"{out}_tenkan": mid(tenkan), f"{out}_kijun": mid(kijun), "_s": mid(senkou)})
    b2 = b2.put(_a=(F.col(f"{out}_tenkan") + F.col(f"{out}_kijun")) / 2)
    return b2.put(**{f"{out}_a": b2.lag("_a", lead), f"{out}_b": b2.lag("_s", lead), f"{out}_chikou": b2.lag("close", -chikou)}).drop("_a", "_s")


def fractal(b: Bars, n: int = 5, distance: float = 0.015, shift: int = 2, out: str = "fractal") -> Bars:
    """_bearish above a high that no other of its n bars reaches, _bullish below
    a low; written at the bar itself, so it looks ``shift`` bars ahead."""
    later = n - 1 - shift
    sides = [k for k in range(-later, shift + 1) if k]
    up, down = F.lit(True), F.lit(True)
    for k in sides:
        up, down = up & (F.col("high") > b.lag("high", k)), down & (F.col("low") < b.lag("low", k))
    return b.put(**{f"{out}_bearish": F.when(up, F.col("high") * (1 + distance)), f"{out}_bullish": F.when(down, F.col("low") * (1 - distance))})


# --- volatility and statistics -----------------------------------------------


def true_range(b: Bars, out: str = "tr") -> Bars:
    """_high, _low and the range itself, from the last close; null at the first."""
    before = b.lag("close")
    there = before.isNotNull()
    high, low = F.greatest("high", before), F.least("low", before)
    return b.put(**{f"{out}_high": F.when(there, high), f"{out}_low": F.when(there, low), out: F.when(there, high - low)})


def bollinger(b: Bars, n: int = 20, k: float = 2.0, x: str = "close", out: str = "bb") -> Bars:
    """_mid, _top, _bot and _pct; the deviation is the population's."""
    b = b.put(**{f"{out}_mid": b.mean(x, n), "_s": b.std(x, n)})
    b = b.put(**{f"{out}_top": F.col(f"{out}_mid") + k * F.col("_s"), f"{out}_bot": F.col(f"{out}_mid") - k * F.col("_s")}).drop("_s")
    width = F.col(f"{out}_top") - F.col(f"{out}_bot")
    return b.put(**{f"{out}_pct": F.when(width.isNotNull(), ratio(col(x) - F.col(f"{out}_bot"), width, F.lit(0.5)))})


def standard_deviation(b: Bars, n: int = 20, x: str = "close", out: str = "stddev") -> Bars:
    return b.put(**{out: b.std(x, n)})


def mean_deviation(b: Bars, n: int = 20, x: str = "close", out: str = "meandev") -> Bars:
    """Mean distance of the last n values from their mean."""
    b = b.put(_a=b.values(x, n), _m=b.mean(x, n))
    total = F.aggregate("_a", F.lit(0.0), lambda s, v: s + F.abs(v - F.col("_m")))
    return b.put(**{out: total / n}).drop("_a", "_m")


def hurst(b: Bars, n: int = 40, lag_start: int = 2, lag_end: int = 0, x: str = "close", out: str = "hurst") -> Bars:
    """Twice the slope of log10 of the root of the deviation of lagged
    differences against log10 of the lag, over the last n values."""
    lags = list(range(lag_start, lag_end or n // 2))
    logs = [math.log10(k) for k in lags]
    mean = sum(logs) / len(logs)
    spread = sum((v - mean) ** 2 for v in logs)
    b = b.put(**{f"_d{k}": F.col(x) - b.lag(x, k) for k in lags}, _full=b.over(n, x, F.count))
    slope: Column = F.lit(0.0)
    for k, v in zip(lags, logs, strict=True):
        tau = F.sqrt(F.sqrt(F.var_pop(f"_d{k}").over(b.last(n - k))))
        slope = slope + F.lit((v - mean) / spread) * F.when(F.col("_full").isNotNull() & (tau > 0), F.log10(tau))
    return b.put(**{out: 2 * slope}).drop("_full", *[f"_d{k}" for k in lags])


def ols(b: Bars, n: int = 10, y: str = "close", x: str = "close2", out: str = "ols") -> Bars:
    """Rolling least squares of y on x: _slope, _intercept and _beta (slope, 1
    where x doesn't vary); _spread with its rolling _zscore; _score and _pvalue
    of the simplified cointegration test."""
    full = (F.count(y).over(b.last(n)) == n) & (F.count(x).over(b.last(n)) == n)
    cov, var = F.covar_pop(y, x).over(b.last(n)), F.var_pop(x).over(b.last(n))
    slope = F.when(full & (var > 0), cov / F.nullif(var, F.lit(0.0)))
    b = b.put(**{f"{out}_slope": slope, f"{out}_beta": F.when(full, F.coalesce(slope, F.lit(1.0)))})
    b = b.put(**{f"{out}_intercept": b.mean(y, n) - F.col(f"{out}_slope") * b.mean(x, n)})
    b = b.put(**{f"{out}_spread": col(y) - (F.col(f"{out}_slope") * col(x) + F.col(f"{out}_intercept"))})
    s = f"{out}_spread"
    b = b.put(**{f"{out}_zscore": ratio(F.col(s) - b.mean(s, n), b.std(s, n))})
    r = F.abs(F.when(full, F.corr(y, x).over(b.last(n))))
    r = F.when(~F.isnan(r), r)
    return b.put(**{f"{out}_score": 10 * r, f"{out}_pvalue": 1 - r})


# --- window primitives ---------------------------------------------------------


def highest(b: Bars, n: int = 14, x: str = "close", out: str = "highest") -> Bars:
    return b.put(**{out: b.max(x, n)})


def lowest(b: Bars, n: int = 14, x: str = "close", out: str = "lowest") -> Bars:
    return b.put(**{out: b.min(x, n)})


def sum_n(b: Bars, n: int = 14, x: str = "close", out: str = "sumn") -> Bars:
    return b.put(**{out: b.sum(x, n)})


def any_n(b: Bars, n: int = 14, x: str = "close", out: str = "anyn") -> Bars:
    return b.put(**{out: b.max((col(x) != 0).cast("double"), n)})


def all_n(b: Bars, n: int = 14, x: str = "close", out: str = "alln") -> Bars:
    return b.put(**{out: b.min((col(x) != 0).cast("double"), n)})


def find_index(b: Bars, n: int = 14, x: str = "close", best: str = "max", newest: bool = True, out: str = "findindex") -> Bars:
    """Bars since the newest (or oldest) of the window's highest or lowest."""
    b = b.put(_a=b.values(x, n))
    top = F.array_max("_a") if best == "max" else F.array_min("_a")
    ago = F.array_position(F.reverse("_a"), top) - 1 if newest else F.lit(n) - F.array_position("_a", top)
    return b.put(**{out: ago.cast("double")}).drop("_a")


def find_where(b: Bars, f: Callable[[Column, Column], Column], n: int = 14, x: str = "close", newest: bool = True, out: str = "findindex") -> Bars:
    """Bars since the newest (or oldest) value v of the window for which
    ``f(v, now)`` holds, now being the value of the bar itself; null if none."""
    b = b.put(_a=b.values(x, n))
    hits = F.filter(F.transform("_a", lambda v, i: F.when(f(v, F.col(x)), i)), lambda i: i.isNotNull())
    at = F.array_max(hits) if newest else F.array_min(hits)
    return b.put(**{out: (F.lit(n - 1) - at).cast("double")}).drop("_a")


def apply_n(b: Bars, f: Callable[[Column], Column], n: int = 14, x: str = "close", out: str = "applyn") -> Bars:
    """``f`` of the array of the last n values, oldest first."""
    b = b.put(_a=b.values(x, n))
    return b.put(**{out: f(F.col("_a"))}).drop("_a")


def accum(b: Bars, x: str = "close", seed: float = 0.0, out: str = "accum") -> Bars:
    return b.put(**{out: F.lit(float(seed)) + F.sum(col(x)).over(b.so_far)})


# --- crossings, pivots, others ---------------------------------------------------


def nonzero_difference(b: Bars, x: str, y: str, out: str = "nzd") -> Bars:
    """The last difference that wasn't zero; null where either is null."""
    d = col(x) - col(y)
    held = F.last(F.nullif(d, F.lit(0.0)), ignorenulls=True).over(b.so_far)
    return b.put(**{out: F.when(d.isNotNull(), F.coalesce(held, F.lit(0.0)))})


def crossover(b: Bars, x: str, y: str, out: str = "cross") -> Bars:
    """_up and _down are 1 where x comes to be above or below y, else 0, and
    ``out`` is their difference; null until both have had a value before."""
    b = nonzero_difference(b, x, y, "_z")
    b = b.put(_before=b.lag("_z"))
    there = F.col("_before").isNotNull() & F.col("_z").isNotNull()
    up = F.when(there, ((F.col("_before") < 0) & (col(x) > col(y))).cast("double"))
    down = F.when(there, ((F.col("_before") > 0) & (col(x) < col(y))).cast("double"))
    return b.put(**{f"{out}_up": up, f"{out}_down": down, out: up - down}).drop("_z", "_before")


def pivots(b: Bars, kind: str = "classic", levels: Sequence[float] = (0.382, 0.618, 1.0), out: str = "pivot", use_open: bool = False, use_close: bool = False) -> Bars:
    """Support and resistance of each bar: classic, fibonacci or demark. The
    pivot of the first two is the mean of high, low and close; ``use_open`` takes
    the open too and ``use_close`` the close once more."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    if kind == "demark":
        x = F.when(c < o, h + 2 * lo + c).when(c > o, 2 * h + lo + c).otherwise(h + lo + 2 * c)
        return b.put(**{f"{out}_p": x / 4, f"{out}_s1": x / 2 - h, f"{out}_r1": x / 2 - lo})
    p = (h + lo + c + (o if use_open else 0) + (c if use_close else 0)) / (3 + use_open + use_close)
    if kind == "fibonacci":
        made = {f"{out}_p": p}
        for i, level in enumerate(levels, 1):
            made |= {f"{out}_s{i}": p - level * (h - lo), f"{out}_r{i}": p + level * (h - lo)}
        return b.put(**made)
    return b.put(**{f"{out}_p": p, f"{out}_s1": 2 * p - h, f"{out}_r1": 2 * p - lo, f"{out}_s2": p - (h - lo), f"{out}_r2": p + (h - lo)})


def mean_within_bar(b: Bars, n: int = 5, out: str = "within") -> Bars:
    """1 where the mean close lies between the bar's low and high."""
    m = b.mean("close", n)
    return b.put(**{out: F.when(m.isNotNull(), ((m > F.col("low")) & (m < F.col("high"))).cast("double"))})


def bars_last(b: Bars, condition: Column, out: str = "barslast") -> Bars:
    """Bars since ``condition`` was last true; null before it ever was."""
    b = b.put(_n=b.number())
    hit = F.last(F.when(condition, F.col("_n")), ignorenulls=True).over(b.so_far)
    return b.put(**{out: (F.col("_n") - hit).cast("double")}).drop("_n")


def new_diff(b: Bars, n: int = 5, out: str = "newdiff") -> Bars:
    """Rolling sum of the close less the true low on rises, true high on falls."""
    before, c = b.lag("close"), F.col("close")
    d = F.when(c == before, 0.0).when(c > before, c - F.least("low", before)).when(c < before, c - F.greatest("high", before))
    return b.put(_d=d).put(**{out: b.put(_d=d).sum("_d", n)}).drop("_d")
