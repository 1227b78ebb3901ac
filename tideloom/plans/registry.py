"""Indicators by name, with the short names they are known under."""

from __future__ import annotations

from collections.abc import Callable

from ..operators import folds, windows
from ..operators.frame import Bars

Indicator = Callable[..., Bars]
_HLC = ["high", "low", "close"]


def _fold(make: Callable[..., object], inputs: list[str], outputs: list[str]) -> Indicator:
    def run(b: Bars, *args, **kwargs) -> Bars:
        return folds.fold(b, [(lambda: make(*args, **kwargs), inputs, outputs)])

    return run


def _average(kind: str) -> Indicator:
    return lambda b, n=30, x="close", out=None: folds.average(b, kind, n, x, out)


INDICATORS: dict[str, Indicator] = {
    "sma": windows.sma, "wma": windows.wma, "hma": windows.hma,
    **{k: _average(k) for k in ("ema", "smma", "dema", "tema", "kama", "zlema", "zlind", "dma")},
    "rsi": _fold(folds.Rsi, ["close"], ["rsi"]), "rmi": _fold(lambda n=20, back=5: folds.Rsi(n, back), ["close"], ["rmi"]),
    "lrsi": _fold(folds.Laguerre, ["close"], ["lagf", "lrsi"]), "macd": _fold(folds.Macd, ["close"], ["macd", "macd_signal", "macd_histo"]),
    "priceosc": _fold(folds.PriceOscillator, ["close"], ["priceosc"]), "ppo": _fold(folds.Ppo, ["close"], ["ppo", "ppo_signal", "ppo_histo"]),
    "trix": _fold(folds.Trix, ["close"], ["trix", "trix_signal"]), "tsi": _fold(folds.Tsi, ["close"], ["tsi"]),
    "atr": _fold(folds.Atr, _HLC, ["atr"]), "pgo": _fold(folds.PrettyGood, _HLC, ["pgo"]), "dm": _fold(folds.Directional, _HLC, ["adx", "adxr", "plus_di", "minus_di"]),
    "psar": _fold(folds.Parabolic, _HLC, ["sar", "side"]), "heikinashi": _fold(folds.HeikinAshi, ["open", *_HLC], ["ha_open", "ha_high", "ha_low", "ha_close"]), "hadelta": folds.ha_delta,
    "momentum": windows.momentum, "momentumosc": windows.momentum_oscillator, "roc": windows.roc, "roc100": lambda b, n=12, **k: windows.roc(b, n, scale=100, **{"out": "roc100"} | k),
    "pctchange": windows.percent_change, "pctrank": windows.percent_rank, "kst": windows.kst, "dpo": windows.dpo, "dv2": windows.dv2, "cci": windows.cci, "uo": windows.ultimate,
    "stochastic": windows.stochastic, "williamsr": windows.williams_r, "williamsad": windows.williams_ad, "ao": windows.awesome, "accdec": windows.acceleration,
    "upmove": windows.up_move, "downmove": windows.down_move, "aroon": windows.aroon, "vortex": windows.vortex, "ichimoku": windows.ichimoku, "fractal": windows.fractal,
    "truerange": windows.true_range, "bbands": windows.bollinger, "stddev": windows.standard_deviation, "meandev": windows.mean_deviation, "hurst": windows.hurst, "ols": windows.ols,
    "highest": windows.highest, "lowest": windows.lowest, "sumn": windows.sum_n, "anyn": windows.any_n, "alln": windows.all_n, "findindex": windows.find_index, "accum": windows.accum,
    "envelope": folds.envelope, "oscillator": folds.oscillator, "pivots": windows.pivots, "crossover": windows.crossover, "newdiff": windows.new_diff,
}
#: Other names for the same.
ALIASES = {
    "movingaverage": "sma", "average": "sma", "exponentialmovingaverage": "ema", "weightedmovingaverage": "wma", "wilderma": "smma", "smoothedmovingaverage": "smma", "modifiedmovingaverage": "smma",
    "hullma": "hma", "adaptivemovingaverage": "kama", "zerolagindicator": "zlind", "ec": "zlind", "dicksonma": "dma", "apo": "priceosc", "stoch": "stochastic", "aroonindicator": "aroon", "vi": "vortex",
    "tr": "truerange", "bollingerbands": "bbands", "maxn": "highest", "minn": "lowest", "sum": "sumn", "cumsum": "accum", "wad": "williamsad", "had": "hadelta", "adx": "dm", "di": "dm", "ultimateoscillator": "uo", "awesomeoscillator": "ao",
}


def indicator(name: str) -> Indicator:
    """By name or alias, whatever the case; KeyError if there is none."""
    key = name.lower()
    return INDICATORS[ALIASES.get(key, key)]
