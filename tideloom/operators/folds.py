"""Recursive indicators and state machines as folds over sorted partitions.

Rows are shuffled by symbol and sorted by time once; a task then reads its rows
in Arrow batches and carries a small state from batch to batch, so no series is
held in memory as a whole. All recursive columns of a query go in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .frame import Bars

NAN = float("nan")


class Ema:
    """Seeded exponential smoothing: the mean of the first n valid values, then
    alpha x + (1 - alpha) y. A NaN gives NaN and leaves the state alone."""

    def __init__(self, n: int, alpha: float | None = None):
        self.n, self.alpha = n, 2.0 / (n + 1) if alpha is None else alpha
        self.seen, self.total, self.y = 0, 0.0, NAN

    def push(self, x: np.ndarray) -> np.ndarray:
        out = []
        n, a, keep = self.n, self.alpha, 1 - self.alpha
        seen, total, y = self.seen, self.total, self.y
        for v in x.tolist():
            if v != v:
                out.append(NAN)
                continue
            if seen >= n:
                y = a * v + keep * y
            else:
                seen += 1
                total += v
                y = total / n if seen == n else NAN
            out.append(y)
        self.seen, self.total, self.y = seen, total, y
        return np.array(out)


class Smma(Ema):
    def __init__(self, n: int):
        super().__init__(n, 1.0 / n)


class Lag:
    """The value n rows back."""

    def __init__(self, n: int):
        self.held = np.full(n, NAN)

    def push(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.held, x])
        self.held = both[len(x) :]
        return both[: len(x)]


class Mean:
    """Mean of the last n; NaN while any of them is."""

    def __init__(self, n: int):
        self.n, self.held = n, np.full(n - 1, NAN)

    def push(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.held, x])
        self.held = both[len(x) :]
        return np.lib.stride_tricks.sliding_window_view(both, self.n).mean(axis=1) if len(x) else x


class Dema:
    def __init__(self, n: int):
        self.a, self.b = Ema(n), Ema(n)

    def push(self, x):
        one = self.a.push(x)
        return 2 * one - self.b.push(one)


class Tema:
    def __init__(self, n: int):
        self.a, self.b, self.c = Ema(n), Ema(n), Ema(n)

    def push(self, x):
        one = self.a.push(x)
        two = self.b.push(one)
        return 3 * one - 3 * two + self.c.push(two)


class Kama:
    """Adaptive average: the smoothing follows the efficiency ratio. The first
    output, on value n + 1, is the mean of the last n; ``stepped`` instead
    takes one step from the mean of the first n."""

    def __init__(self, n: int = 30, fast: int = 2, slow: int = 30, stepped: bool = False):
        self.stepped = stepped
        self.n, self.fast, self.slow = n, 2.0 / (fast + 1), 2.0 / (slow + 1)
        self.held: list[float] = []
        self.y = NAN

    def push(self, x):
        out, n = [], self.n
        for v in x.tolist():
            if v != v:
                out.append(NAN)
                continue
            self.held.append(v)
            if len(self.held) <= n:
                out.append(NAN)
                continue
            if len(self.held) > n + 1:
                self.held.pop(0)
            elif self.y != self.y and self.stepped:
                self.y = sum(self.held[:n]) / n
            elif self.y != self.y:
                self.y = sum(self.held[1:]) / n
                out.append(self.y)
                continue
            h = self.held
            path = sum(abs(h[i + 1] - h[i]) for i in range(n))
            er = abs(h[n] - h[0]) / path if path else 0.0
            sc = (er * (self.fast - self.slow) + self.slow) ** 2
            self.y += sc * (v - self.y)
            out.append(self.y)
        return np.array(out)


class Zlema:
    """EMA of 2 x - x[(n - 1) / 2 ago]."""

    def __init__(self, n: int):
        self.lag, self.ema = Lag((n - 1) // 2), Ema(n)

    def push(self, x):
        return self.ema.push(2 * x - self.lag.push(x))


class ZeroLag:
    """EMA with an error term whose gain is searched for at every bar."""

    def __init__(self, n: int, limit: int = 50):
        self.ema, self.alpha = Ema(n), 2.0 / (n + 1)
        self.gains = [g / 10.0 for g in range(-limit, limit + 1)]
        self.ec = NAN

    def push(self, x):
        out, a = [], self.alpha
        gains = np.array(self.gains)
        for v, e in zip(x.tolist(), self.ema.push(x).tolist(), strict=True):
            if e != e:
                out.append(NAN)
                continue
            if self.ec != self.ec:
                self.ec = e
            else:
                ecs = a * (e + gains * (v - self.ec)) + (1 - a) * self.ec
                self.ec = float(ecs[np.argmin(np.abs(v - ecs))])
            out.append(self.ec)
        return np.array(out)


class Wma:
    def __init__(self, n: int):
        self.n, self.held = n, np.full(n - 1, NAN)
        self.w = np.arange(1, n + 1) * 2.0 / (n * (n + 1))

    def push(self, x):
        both = np.concatenate([self.held, x])
        self.held = both[len(x) :]
        return np.lib.stride_tricks.sliding_window_view(both, self.n) @ self.w if len(x) else x


class Hma:
    def __init__(self, n: int):
        self.half, self.full, self.root = Wma(max(1, n // 2)), Wma(n), Wma(int(n**0.5))

    def push(self, x):
        return self.root.push(2 * self.half.push(x) - self.full.push(x))


class Dickson:
    """Mean of the zero-lag average and a Hull average."""

    def __init__(self, n: int = 30, limit: int = 50, hull: int = 7):
        self.ec, self.hma = ZeroLag(n, limit), Hma(hull)

    def push(self, x):
        return (self.ec.push(x) + self.hma.push(x)) / 2


class Rsi:
    """Smoothed gains over losses; ``lookback`` 5 gives RMI."""

    def __init__(self, n: int = 14, lookback: int = 1):
        self.lag, self.up, self.down = Lag(lookback), Smma(n), Smma(n)

    def push(self, x):
        d = x - self.lag.push(x)
        up = self.up.push(np.where(np.isnan(d), NAN, np.maximum(d, 0)))
        down = self.down.push(np.where(np.isnan(d), NAN, np.maximum(-d, 0)))
        with np.errstate(divide="ignore", invalid="ignore"):
            out = 100 - 100 / (1 + up / down)
        return np.where(down == 0, np.where(up == 0, 50.0, 100.0), out)


class Laguerre:
    """Four-stage Laguerre filter from zero; gives (filter, RSI). It starts on
    the n-th bar: 6 for the RSI, 1 for the filter."""

    def __init__(self, gamma: float = 0.5, n: int = 6):
        self.g, self.n, self.seen, self.l = gamma, n, 0, [0.0] * 4

    def push(self, x):
        out, g = [], self.g
        for v in x.tolist():
            if v != v:
                out.append((NAN, NAN))
                continue
            self.seen += 1
            if self.seen < self.n:
                out.append((NAN, NAN))
                continue
            a, b, c, d = self.l
            l0 = (1 - g) * v + g * a
            l1 = -g * l0 + a + g * b
            l2 = -g * l1 + b + g * c
            l3 = -g * l2 + c + g * d
            self.l = [l0, l1, l2, l3]
            up = max(l0 - l1, 0) + max(l1 - l2, 0) + max(l2 - l3, 0)
            down = max(l1 - l0, 0) + max(l2 - l1, 0) + max(l3 - l2, 0)
            rsi = up / (up + down) if up + down else 1.0
            out.append(((l0 + 2 * l1 + 2 * l2 + l3) / 6, rsi))
        return tuple(np.array(out).reshape(-1, 2).T)


class Macd:
    """(macd, signal, histogram), all null until the signal is there."""

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9):
        self.a, self.b, self.s = Ema(fast), Ema(slow), Ema(signal)

    def push(self, x):
        m = self.a.push(x) - self.b.push(x)
        s = self.s.push(m)
        return np.where(np.isnan(s), NAN, m), s, m - s


class PriceOscillator:
    def __init__(self, fast: int = 12, slow: int = 26):
        self.a, self.b = Ema(fast), Ema(slow)

    def push(self, x):
        return self.a.push(x) - self.b.push(x)


class Ppo:
    """(ppo, signal, histogram) in percent of the slow or the fast average."""

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9, short: bool = False):
        self.a, self.b, self.s, self.short = Ema(fast), Ema(slow), Ema(signal), short

    def push(self, x):
        a, b = self.a.push(x), self.b.push(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = 100 * (a - b) / (a if self.short else b)
        p = np.where(np.isfinite(p), p, NAN)
        s = self.s.push(p)
        return np.where(np.isnan(s), NAN, p), s, p - s


class Trix:
    """(trix, signal): percent change of a triple EMA, and its EMA."""

    def __init__(self, n: int = 15, back: int = 1, signal: int = 9):
        self.a, self.b, self.c, self.lag, self.s = Ema(n), Ema(n), Ema(n), Lag(back), Ema(signal)

    def push(self, x):
        e = self.c.push(self.b.push(self.a.push(x)))
        with np.errstate(divide="ignore", invalid="ignore"):
            t = 100 * (e / self.lag.push(e) - 1)
        t = np.where(np.isfinite(t), t, NAN)
        return t, self.s.push(t)


class Tsi:
    def __init__(self, slow: int = 25, fast: int = 13, back: int = 1):
        self.lag = Lag(back)
        self.m = [Ema(slow), Ema(fast)]
        self.a = [Ema(slow), Ema(fast)]

    def push(self, x):
        d = x - self.lag.push(x)
        up = self.m[1].push(self.m[0].push(d))
        full = self.a[1].push(self.a[0].push(np.abs(d)))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(full == 0, NAN, 100 * up / full)


class Atr:
    def __init__(self, n: int = 14):
        self.lag, self.smma = Lag(1), Smma(n)

    def push(self, high, low, close):
        before = self.lag.push(close)
        return self.smma.push(np.maximum(high, before) - np.minimum(low, before))


class PrettyGood:
    """(close - SMA) / ATR."""

    def __init__(self, n: int = 14):
        self.atr, self.mean = Atr(n), Mean(n)

    def push(self, high, low, close):
        atr = self.atr.push(high, low, close)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(atr == 0, NAN, (close - self.mean.push(close)) / atr)


class Directional:
    """(adx, adxr, +di, -di). ADX starts as the mean of the first n DX."""

    def __init__(self, n: int = 14):
        self.n, self.high, self.low = n, Lag(1), Lag(1)
        self.atr, self.plus, self.minus, self.adx, self.back = Atr(n), Smma(n), Smma(n), Smma(n), Lag(n)

    def push(self, high, low, close):
        up, down = high - self.high.push(high), self.low.push(low) - low
        plus = np.where(np.isnan(up), NAN, np.where((up > down) & (up > 0), up, 0.0))
        minus = np.where(np.isnan(down), NAN, np.where((down > up) & (down > 0), down, 0.0))
        atr = self.atr.push(high, low, close)
        with np.errstate(divide="ignore", invalid="ignore"):
            pdi, mdi = 100 * self.plus.push(plus) / atr, 100 * self.minus.push(minus) / atr
            dx = 100 * np.abs(pdi - mdi) / (pdi + mdi)
        dx = np.where(pdi + mdi == 0, 0.0, dx)
        adx = self.adx.push(dx)
        return adx, (adx + self.back.push(adx)) / 2, pdi, mdi


class Parabolic:
    """(sar, trend): stop and reverse, the stop clamped to the last two bars."""

    def __init__(self, n: int = 2, step: float = 0.02, most: float = 0.20):
        self.n, self.step, self.most = n, step, most
        self.bars: list[tuple[float, float]] = []
        self.seen, self.sar, self.up, self.ep, self.af = 0, NAN, True, NAN, step

    def push(self, high, low, close):
        out = []
        for h, lo, c in zip(high.tolist(), low.tolist(), close.tolist(), strict=True):
            if h != h or lo != lo or c != c:
                out.append((NAN, NAN))
                continue
            self.seen += 1
            if self.seen < self.n:
                self.first = c
                out.append((NAN, NAN))
            elif self.seen == self.n or self.sar != self.sar:
                self.up = not self.bars or c >= (self.first if self.n > 1 else c)
                highs, lows = [b[0] for b in self.bars] + [h], [b[1] for b in self.bars] + [lo]
                self.sar, self.ep = (min(lows), max(highs)) if self.up else (max(highs), min(lows))
                out.append((self.sar, 1.0 if self.up else -1.0))
            else:
                sar = self.sar + self.af * (self.ep - self.sar)
                if self.up:
                    sar = min(sar, *(b[1] for b in self.bars))
                    if lo < sar:
                        self.up, sar, self.ep, self.af = False, self.ep, lo, self.step
                    elif h > self.ep:
                        self.ep, self.af = h, min(self.most, self.af + self.step)
                else:
                    sar = max(sar, *(b[0] for b in self.bars))
                    if h > sar:
                        self.up, sar, self.ep, self.af = True, self.ep, h, self.step
                    elif lo < self.ep:
                        self.ep, self.af = lo, min(self.most, self.af + self.step)
                self.sar = sar
                out.append((sar, 1.0 if self.up else -1.0))
            self.bars = [*self.bars, (h, lo)][-2:]
        return tuple(np.array(out).reshape(-1, 2).T)


class HeikinAshi:
    """(open, high, low, close) smoothed; the first open is the middle of the
    body. ``first`` makes the first bar null, as the indicator does."""

    def __init__(self, first: bool = False):
        self.o = self.c = NAN
        self.skip = first

    def push(self, open_, high, low, close):
        out = []
        for o, h, lo, c in zip(open_.tolist(), high.tolist(), low.tolist(), close.tolist(), strict=True):
            hc = (o + h + lo + c) / 4
            ho = (o + c) / 2 if self.o != self.o else (self.o + self.c) / 2
            self.o, self.c = ho, hc
            out.append((NAN,) * 4 if self.skip else (ho, max(h, ho, hc), min(lo, ho, hc), hc))
            self.skip = False
        return tuple(np.array(out).reshape(-1, 4).T)


class DaySteps:
    """1 for rows at least ``days`` after the last row kept, the first included."""

    def __init__(self, days: float):
        self.days, self.last = days, None

    def push(self, seconds):
        out = []
        for s in seconds.tolist():
            keep = self.last is None or s - self.last >= self.days * 86400
            self.last = s if keep else self.last
            out.append(float(keep))
        return np.array(out)


class Counting:
    """1 on every k-th hit; a quiet spell of ``reset`` bars starts over."""

    def __init__(self, k: int, reset: int = 0):
        self.k, self.reset, self.hits, self.quiet = k, reset, 0, 0

    def push(self, signal):
        out = []
        for s in signal.tolist():
            fire = 0.0
            if s == s and s != 0:
                self.hits, self.quiet = self.hits + 1, 0
                if self.hits >= self.k:
                    fire, self.hits = 1.0, 0
            else:
                self.quiet += 1
                if self.reset and self.quiet >= self.reset:
                    self.hits = 0
            out.append(fire)
        return np.array(out)


Step = tuple[Callable[[], object], Sequence[str], Sequence[str]]


def fold(b: Bars, steps: Sequence[Step]) -> Bars:
    """Columns of ``steps`` = (make state, input columns, output columns), each
    with a state of its own for every symbol. NaN goes out as null."""
    names = list(dict.fromkeys(c for _, ins, _ in steps for c in ins))
    made = [o for _, _, outs in steps for o in outs]
    df = b.df
    schema = StructType(list(df.schema.fields))
    for o in made:
        schema = schema.add(o, "double")
    keys = list(b.by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, current = None, None
        for batch in batches:
            inputs = {c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names}
            outs: dict[str, list] = {o: [] for o in made}
            # A new run begins where the code of any key column changes.
            codes = [batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(len(batch), dtype=bool)
            for c in codes:
                new[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(new).tolist()] if len(batch) else []
            for at, to in zip(starts, [*starts[1:], len(batch)], strict=False):
                key = tuple(batch.column(k)[at].as_py() for k in keys)
                if states is None or key != current:
                    states, current = [make() for make, _, _ in steps], key
                for state, (_, ins, out) in zip(states, steps, strict=True):
                    got = state.push(*[inputs[c][at:to] for c in ins])
                    for o, v in zip(out, got if isinstance(got, tuple) else (got,), strict=True):
                        outs[o].append(v)
            cols = [pa.array(np.concatenate(v) if v else np.zeros(0), pa.float64(), from_pandas=True) for v in outs.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *made])

    ordered = df.repartition(*[F.col(k) for k in b.by]).sortWithinPartitions(*b.by, *b.order)
    return Bars(ordered.mapInArrow(run, schema), b.by, b.order)


AVERAGES: dict[str, Callable[[int], object]] = {"sma": Mean, "ema": Ema, "smma": Smma, "wma": Wma, "hma": Hma, "dema": Dema, "tema": Tema, "kama": Kama, "zlema": Zlema, "zlind": ZeroLag, "dma": Dickson}


def average(b: Bars, kind: str, n: int = 30, x: str = "close", out: str | None = None) -> Bars:
    """Any moving average by name."""
    return fold(b, [(lambda: AVERAGES[kind](n), [x], [out or kind])])


def envelope(b: Bars, kind: str = "sma", n: int = 30, percent: float = 2.5, x: str = "close", out: str = "env") -> Bars:
    """_mid, _top and _bot around a moving average. The adaptive one is stepped."""
    make = (lambda: Kama(n, stepped=True)) if kind == "kama" else (lambda: AVERAGES[kind](n))
    b = fold(b, [(make, [x], [f"{out}_mid"])])
    return b.put(**{f"{out}_top": F.col(f"{out}_mid") * (1 + percent / 100), f"{out}_bot": F.col(f"{out}_mid") * (1 - percent / 100)})


def oscillator(b: Bars, kind: str = "sma", n: int = 30, x: str = "close", out: str = "osc") -> Bars:
    """Value less its moving average."""
    b = average(b, kind, n, x, "_avg")
    return b.put(**{out: F.col(x) - F.col("_avg")}).drop("_avg")


def ha_delta(b: Bars, n: int = 3, out: str = "hadelta") -> Bars:
    """Heikin-Ashi close less open, and its mean."""
    b = fold(b, [(HeikinAshi, ["open", "high", "low", "close"], ["_o", "_h", "_l", "_c"])]).put(**{out: F.col("_c") - F.col("_o")})
    return b.put(**{f"{out}_smoothed": b.mean(out, n)}).drop("_o", "_h", "_l", "_c")


def chart(b: Bars, x: str = "close") -> Bars:
    """The usual recursive indicators, all in one pass."""
    hlc = ["high", "low", "close"]
    return fold(b, [
        (lambda: Ema(30), [x], ["ema"]), (lambda: Smma(30), [x], ["smma"]), (lambda: Dema(30), [x], ["dema"]), (lambda: Tema(30), [x], ["tema"]),
        (Kama, [x], ["kama"]), (lambda: Zlema(30), [x], ["zlema"]), (Rsi, [x], ["rsi"]), (lambda: Rsi(20, 5), [x], ["rmi"]),
        (Macd, [x], ["macd", "macd_signal", "macd_histo"]), (PriceOscillator, [x], ["priceosc"]), (Ppo, [x], ["ppo", "ppo_signal", "ppo_histo"]),
        (Trix, [x], ["trix", "trix_signal"]), (Tsi, [x], ["tsi"]), (Atr, hlc, ["atr"]), (PrettyGood, hlc, ["pgo"]), (Directional, hlc, ["adx", "adxr", "plus_di", "minus_di"]),
    ])
