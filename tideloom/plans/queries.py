"""Queries over the driver's tables, one for each operator, and their SQL.

Bars are lineitem prices by return flag, in days; ticks are events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines
from ..operators import analyzers as an
from ..operators import affine, blocks, filters, folds, resample, signals, timers
from ..operators import windows as win
from ..operators.frame import Bars
from ..sources import readers
from ..streaming import bars as streams
from . import strategies, trading, trends
from . import streams as live
from . import recursive as rec
from . import sources as files
from . import units
from .bars import Query, days, rounded, table, ticks
from .sql import DAYS, ORDER, SO_FAR, Sql, agg, cross, lag, mean, over, ratio, values, weighted

def on(source: Callable, f: Callable[[Bars], Bars], *columns: str) -> Query:
    return lambda spark, sf_dir: rounded(f(Bars(source(spark, sf_dir))).tidy().df, *columns)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event prices by day, two means and their crossing."""
    ev = table(spark, sf_dir, "events")
    b = Bars(resample.from_ticks(ev, "event_type", "ts", "value", "day", ties=("event_id",)))
    b = b.put(sma10=b.mean("close", 10), sma20=b.mean("close", 20))
    b = win.crossover(b, "sma10", "sma20", "cross")
    return rounded(b.df, "open", "high", "low", "close", "volume", "sma10", "sma20", "cross")


FLAGSHIP_SQL = f"""WITH bars AS (
  SELECT event_type AS symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events WHERE value IS NOT NULL GROUP BY event_type, date_trunc('day', events.ts)
), m AS (SELECT *, {mean("close", 10)} AS sma10, {mean("close", 20)} AS sma20 FROM bars
), z AS (SELECT *, CASE WHEN sma10 - sma20 IS NOT NULL THEN coalesce(last_value(nullif(sma10 - sma20, 0) IGNORE NULLS) {SO_FAR}, 0) END AS z FROM m
), b AS (SELECT *, {lag("z")} AS before FROM z)
SELECT symbol, ts, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, round(volume, 4) AS volume, round(sma10, 4) AS sma10, round(sma20, 4) AS sma20,
       CASE WHEN before IS NOT NULL AND z IS NOT NULL THEN CASE WHEN before < 0 AND sma10 > sma20 THEN 1.0 WHEN before > 0 AND sma10 < sma20 THEN -1.0 ELSE 0.0 END END::DOUBLE AS cross
FROM b"""

OHLC = ["open", "high", "low", "close"]
HLC = OHLC[1:]
TP = "((high + low + close) / 3)"
HL2 = "((high + low) / 2)"
TR = f"(greatest(high, {lag('close')}) - least(low, {lag('close')}))"
TRN = f"CASE WHEN {lag('close')} IS NOT NULL THEN {TR} END"


def _vortex(s: Sql) -> str:
    s.put(_p=f"abs(high - {lag('low')})", _m=f"abs(low - {lag('high')})", _t=TRN)
    total = agg("sum", "_t", 14)
    return s.put(**{f"vortex_{k}": f"CASE WHEN ({total}) IS NOT NULL THEN coalesce({ratio(agg('sum', c, 14), total)}, 0) END" for k, c in (("plus", "_p"), ("minus", "_m"))}).select("vortex_plus", "vortex_minus")


def _ultimate(s: Sql) -> str:
    c1 = lag("close")
    s.put(_bp=f"CASE WHEN {c1} IS NOT NULL THEN close - least(low, {c1}) END", _tr=TRN)
    a = [ratio(agg("sum", "_bp", p), agg("sum", "_tr", p)) for p in (7, 14, 28)]
    return s.put(uo=f"100 * (4 * {a[0]} + 2 * {a[1]} + {a[2]}) / 7").select("uo")


def _stochastic(s: Sql) -> str:
    s.put(_h=agg("max", "high", 14), _l=agg("min", "low", 14)).put(stoch_raw=ratio("100 * (close - _l)", "_h - _l")).put(stoch_k=mean("stoch_raw", 3)).put(stoch_d=mean("stoch_k", 3))
    return s.select("stoch_raw", "stoch_k", "stoch_d")


def _kst(s: Sql) -> str:
    s.put(**{f"_k{i}": ratio(f"100 * (close - {lag('close', r)})", lag("close", r)) for i, r in enumerate((10, 15, 20, 30))})
    s.put(kst=" + ".join(f"{i + 1} * ({mean(f'_k{i}', 10)})" for i in range(4))).put(kst_signal=mean("kst", 9))
    return s.select("kst", "kst_signal")


def _aroon(s: Sql) -> str:
    s.put(_hs=values("high", 15), _ls=values("low", 15))
    pos = lambda a, f: f"100.0 * (14 - (list_position(list_reverse({a}), {f}({a})) - 1)) / 14"
    return s.put(aroon_up=pos("_hs", "list_max"), aroon_down=pos("_ls", "list_min")).put(aroon_osc="aroon_up - aroon_down").select("aroon_up", "aroon_down", "aroon_osc")


def _ichimoku(s: Sql) -> str:
    mid = lambda n: f"(({agg('max', 'high', n)}) + ({agg('min', 'low', n)})) / 2"
    s.put(ichimoku_tenkan=mid(9), ichimoku_kijun=mid(26), _s=mid(52)).put(_a="(ichimoku_tenkan + ichimoku_kijun) / 2")
    return s.put(ichimoku_a=lag("_a", 26), ichimoku_b=lag("_s", 26), ichimoku_chikou=lag("close", -26)).select("ichimoku_tenkan", "ichimoku_kijun", "ichimoku_a", "ichimoku_b", "ichimoku_chikou")


def _fractal(s: Sql) -> str:
    up = " AND ".join(f"high > {lag('high', k)}" for k in (-2, -1, 1, 2))
    down = " AND ".join(f"low < {lag('low', k)}" for k in (-2, -1, 1, 2))
    return s.put(fractal_bearish=f"CASE WHEN {up} THEN high * 1.0153 END", fractal_bullish=f"CASE WHEN {down} THEN low * 0.9847 END").select("fractal_bearish", "fractal_bullish")


def _ols(s: Sql) -> str:
    w = over(10)
    full = f"count(close) {w} = 10 AND count(open) {w} = 10"
    s.put(ols_slope=f"CASE WHEN {full} THEN covar_pop(close, open) {w} / nullif(var_pop(open) {w}, 0) END")
    s.put(ols_beta=f"CASE WHEN {full} THEN coalesce(ols_slope, 1) END", ols_intercept=f"({mean('close', 10)}) - ols_slope * ({mean('open', 10)})")
    s.put(ols_spread="close - (ols_slope * open + ols_intercept)").put(ols_zscore=ratio(f"ols_spread - ({mean('ols_spread', 10)})", agg("stddev_pop", "ols_spread", 10)))
    s.put(_r=f"CASE WHEN {full} THEN abs(corr(close, open) {w}) END").put(ols_score="10 * _r", ols_pvalue="1 - _r")
    return s.select("ols_slope", "ols_beta", "ols_intercept", "ols_spread", "ols_zscore", "ols_score", "ols_pvalue")


def _dv2(s: Sql) -> str:
    s.put(_v=ratio("close", HL2)).put(_m=mean("_v", 2)).put(_a=values("_m", 252))
    return s.put(dv2="CASE WHEN _a IS NOT NULL THEN len(list_filter(_a, lambda v: v < _m)) / 252.0 * 100 END").select("dv2")


def _meandev(s: Sql) -> str:
    s.put(_a=values("close", 20), _m=mean("close", 20))
    return s.put(meandev="list_avg(list_transform(_a, lambda v: abs(v - _m)))").select("meandev")


def _hma(s: Sql) -> str:
    w = lambda x, n: f"({weighted(x, range(1, n + 1))} * {2.0 / (n * (n + 1))})"
    return s.put(_x=f"2 * {w('close', 15)} - {w('close', 30)}").put(hma=w("_x", 5)).select("hma")


#: name: (Spark, SQL) over daily bars by plain windows.
WINDOWS: dict[str, tuple[Query, Callable[[Sql], str]]] = {
    "ma_sma": (on(days, win.sma, "sma"), lambda s: s.put(sma=mean("close", 30)).select("sma")),
    "ma_wma": (on(days, win.wma, "wma"), lambda s: s.put(wma=f"{weighted('close', range(1, 31))} * {2.0 / (30 * 31)}").select("wma")),
    "ma_hma": (on(days, win.hma, "hma"), _hma),
    "ma_weighted": (on(days, lambda b: win.weighted_average(b, (0.5, 0.3, 0.2)), "weighted"), lambda s: s.put(weighted=weighted("close", (0.5, 0.3, 0.2))).select("weighted")),
    "env_sma": (on(days, lambda b: b.put(env_mid=b.mean("close", 30)).put(env_top=F.col("env_mid") * 1.025, env_bot=F.col("env_mid") * 0.975), "env_mid", "env_top", "env_bot"), lambda s: s.put(env_mid=mean("close", 30)).put(env_top="env_mid * 1.025", env_bot="env_mid * 0.975").select("env_mid", "env_top", "env_bot")),
    "osc_sma": (on(days, lambda b: b.put(osc=F.col("close") - b.mean("close", 30)), "osc"), lambda s: s.put(osc=f"close - ({mean('close', 30)})").select("osc")),
    "mom_momentum": (on(days, win.momentum, "momentum"), lambda s: s.put(momentum=f"close - {lag('close', 12)}").select("momentum")),
    "mom_momentum_oscillator": (on(days, win.momentum_oscillator, "momentumosc"), lambda s: s.put(momentumosc=ratio("100 * close", lag("close", 12))).select("momentumosc")),
    "mom_roc": (on(days, win.roc, "roc"), lambda s: s.put(roc=ratio(f"close - {lag('close', 12)}", lag("close", 12))).select("roc")),
    "mom_roc100": (on(days, lambda b: win.roc(b, scale=100, out="roc100"), "roc100"), lambda s: s.put(roc100=f"100 * {ratio(f'close - {lag("close", 12)}', lag('close', 12))}").select("roc100")),
    "mom_percent_change": (on(days, win.percent_change, "pctchange"), lambda s: s.put(pctchange=ratio(f"close - {lag('close', 30)}", lag("close", 30))).select("pctchange")),
    "mom_percent_rank": (on(days, win.percent_rank, "pctrank"), lambda s: s.put(_a=values("close", 50)).put(pctrank="CASE WHEN _a IS NOT NULL THEN len(list_filter(_a, lambda v: v < close)) / 50.0 END").select("pctrank")),
    "mom_kst": (on(days, win.kst, "kst", "kst_signal"), _kst),
    "mom_dpo": (on(days, win.dpo, "dpo"), lambda s: s.put(_m=mean("close", 20)).put(dpo=f"close - {lag('_m', 9)}").select("dpo")),
    "mom_dv2": (on(days, win.dv2, "dv2"), _dv2),
    "mom_cci": (on(days, win.cci, "cci"), lambda s: s.put(_t=TP).put(_m=mean("_t", 20)).put(_a="abs(_t - _m)").put(cci=ratio("_t - _m", f"0.015 * ({mean('_a', 20)})")).select("cci")),
    "mom_ultimate": (on(days, win.ultimate, "uo"), _ultimate),
    "mom_stochastic": (on(days, win.stochastic, "stoch_raw", "stoch_k", "stoch_d"), _stochastic),
    "mom_williams_r": (on(days, win.williams_r, "williamsr"), lambda s: s.put(_h=agg("max", "high", 14), _l=agg("min", "low", 14)).put(williamsr=ratio("100 * (close - _h)", "_h - _l")).select("williamsr")),
    "mom_williams_ad": (on(days, win.williams_ad, "williamsad"), lambda s: s.put(_w=f"CASE WHEN {lag('close')} IS NOT NULL THEN CASE WHEN close > {lag('close')} THEN close - least(low, {lag('close')}) WHEN close < {lag('close')} THEN close - greatest(high, {lag('close')}) ELSE 0 END END").put(williamsad=f"sum(_w) {SO_FAR}").select("williamsad")),
    "mom_awesome": (on(days, win.awesome, "ao"), lambda s: s.put(_m=HL2).put(ao=f"({mean('_m', 5)}) - ({mean('_m', 34)})").select("ao")),
    "mom_acceleration": (on(days, win.acceleration, "accdec"), lambda s: s.put(_m=HL2).put(_ao=f"({mean('_m', 5)}) - ({mean('_m', 34)})").put(accdec=f"_ao - ({mean('_ao', 5)})").select("accdec")),
    "trend_up_down_move": (on(days, lambda b: win.down_move(win.up_move(b)), "upmove", "downmove"), lambda s: s.put(upmove=f"close - {lag('close')}", downmove=f"{lag('close')} - close").select("upmove", "downmove")),
    "trend_aroon": (on(days, win.aroon, "aroon_up", "aroon_down", "aroon_osc"), _aroon),
    "trend_vortex": (on(days, win.vortex, "vortex_plus", "vortex_minus"), _vortex),
    "trend_ichimoku": (on(days, win.ichimoku, "ichimoku_tenkan", "ichimoku_kijun", "ichimoku_a", "ichimoku_b", "ichimoku_chikou"), _ichimoku),
    "trend_fractal": (on(days, lambda b: win.fractal(b, distance=0.0153), "fractal_bearish", "fractal_bullish"), _fractal),
    "vol_true_range": (on(days, win.true_range, "tr", "tr_high", "tr_low"), lambda s: s.put(_c=lag("close")).put(tr="CASE WHEN _c IS NOT NULL THEN greatest(high, _c) - least(low, _c) END", tr_high="CASE WHEN _c IS NOT NULL THEN greatest(high, _c) END", tr_low="CASE WHEN _c IS NOT NULL THEN least(low, _c) END").select("tr", "tr_high", "tr_low")),
    "vol_bollinger": (on(days, win.bollinger, "bb_mid", "bb_top", "bb_bot", "bb_pct"), lambda s: s.put(bb_mid=mean("close", 20), _s=agg("stddev_pop", "close", 20)).put(bb_top="bb_mid + 2 * _s", bb_bot="bb_mid - 2 * _s").put(bb_pct="CASE WHEN bb_top IS NOT NULL THEN coalesce((close - bb_bot) / nullif(bb_top - bb_bot, 0), 0.5) END").select("bb_mid", "bb_top", "bb_bot", "bb_pct")),
    "vol_stddev": (on(days, win.standard_deviation, "stddev"), lambda s: s.put(stddev=agg("stddev_pop", "close", 20)).select("stddev")),
    "vol_mean_deviation": (on(days, win.mean_deviation, "meandev"), _meandev),
    "stat_ols": (on(days, lambda b: win.ols(b, y="close", x="open"), "ols_slope", "ols_beta", "ols_intercept", "ols_spread", "ols_zscore", "ols_score", "ols_pvalue"), _ols),
    "win_highest_lowest": (on(days, lambda b: win.lowest(win.highest(b)), "highest", "lowest"), lambda s: s.put(highest=agg("max", "close", 14), lowest=agg("min", "close", 14)).select("highest", "lowest")),
    "win_sum_any_all": (on(days, lambda b: win.all_n(win.any_n(win.sum_n(b.put(up=(F.col("close") > F.col("open")).cast("double"))), x="up"), x="up"), "sumn", "anyn", "alln"), lambda s: s.put(up="CASE WHEN close > open THEN 1.0 ELSE 0.0 END").put(sumn=agg("sum", "close", 14), anyn=agg("max", "up", 14), alln=agg("min", "up", 14)).select("sumn", "anyn", "alln")),
    "win_find_index": (on(days, lambda b: win.find_index(win.find_index(b, out="first_high"), best="min", newest=False, out="last_low"), "first_high", "last_low"), lambda s: s.put(_a=values("close", 14)).put(first_high="list_position(list_reverse(_a), list_max(_a)) - 1", last_low="14 - list_position(_a, list_min(_a))").select("first_high", "last_low")),
    "win_apply": (on(days, lambda b: win.apply_n(b, lambda a: F.array_max(a) - F.array_min(a)), "applyn"), lambda s: s.put(_a=values("close", 14)).put(applyn="list_max(_a) - list_min(_a)").select("applyn")),
    "win_accum": (on(days, lambda b: win.accum(b, seed=100), "accum"), lambda s: s.put(accum=f"100 + sum(close) {SO_FAR}").select("accum")),
    "sig_crossover": (on(days, lambda b: win.crossover(b.put(m=b.mean("close", 10)), "close", "m", "crossing"), "crossing_up", "crossing_down", "crossing"), lambda s: cross(s.put(m=mean("close", 10)), "close", "m", "crossing").select("crossing_up", "crossing_down", "crossing")),
    "sig_pivots": (on(days, win.pivots, "pivot_p", "pivot_s1", "pivot_r1", "pivot_s2", "pivot_r2"), lambda s: s.put(pivot_p=TP).put(pivot_s1="2 * pivot_p - high", pivot_r1="2 * pivot_p - low", pivot_s2="pivot_p - (high - low)", pivot_r2="pivot_p + (high - low)").select("pivot_p", "pivot_s1", "pivot_r1", "pivot_s2", "pivot_r2")),
    "sig_pivots_fibonacci": (on(days, lambda b: win.pivots(b, "fibonacci"), *[f"pivot_{k}" for k in ("p", "s1", "s2", "s3", "r1", "r2", "r3")]), lambda s: s.put(pivot_p=TP).put(**{f"pivot_{k}{i}": f"pivot_p {op} {v} * (high - low)" for i, v in enumerate((0.382, 0.618, 1.0), 1) for k, op in (("s", "-"), ("r", "+"))}).select(*[f"pivot_{k}" for k in ("p", "s1", "s2", "s3", "r1", "r2", "r3")])),
    "sig_pivots_demark": (on(days, lambda b: win.pivots(b, "demark"), "pivot_p", "pivot_s1", "pivot_r1"), lambda s: s.put(_x="CASE WHEN close < open THEN high + 2 * low + close WHEN close > open THEN 2 * high + low + close ELSE high + low + 2 * close END").put(pivot_p="_x / 4", pivot_s1="_x / 2 - high", pivot_r1="_x / 2 - low").select("pivot_p", "pivot_s1", "pivot_r1")),
    "sig_mean_within_bar": (on(days, win.mean_within_bar, "within"), lambda s: s.put(_m=mean("close", 5)).put(within="CASE WHEN _m IS NOT NULL THEN CASE WHEN _m > low AND _m < high THEN 1.0 ELSE 0.0 END END").select("within")),
    "sig_bars_last": (on(days, lambda b: win.bars_last(b, F.col("close") > 90), "barslast"), lambda s: s.put(_n=f"row_number() {ORDER}").put(barslast=f"_n - last_value(CASE WHEN close > 90 THEN _n END IGNORE NULLS) {SO_FAR}").select("barslast")),
    "sig_new_diff": (on(days, win.new_diff, "newdiff"), lambda s: s.put(_c=lag("close")).put(_d="CASE WHEN close = _c THEN 0 WHEN close > _c THEN close - least(low, _c) WHEN close < _c THEN close - greatest(high, _c) END").put(newdiff=agg("sum", "_d", 5)).select("newdiff")),
    "sig_threshold": (on(days, lambda b: signals.threshold(b, "close", 90.0), "signal"), lambda s: s.put(signal=f"CASE WHEN {lag('close')} <= 90 AND close > 90 THEN 1.0 ELSE 0.0 END").select("signal")),
    "sig_composite": (on(days, lambda b: b.put(a=signals.simple(F.col("close") > F.col("open")), c=signals.simple(F.col("close") > 50)).put(every_=signals.composite("and", F.col("a"), F.col("c")), one=signals.composite("xor", F.col("a"), F.col("c")), none=signals.composite("nor", F.col("a"), F.col("c"))), "every_", "one", "none"), lambda s: s.put(a="close > open", c="close > 50").put(every_="CASE WHEN a AND c THEN 1.0 ELSE 0.0 END", one="CASE WHEN a <> c THEN 1.0 ELSE 0.0 END", none="CASE WHEN NOT a AND NOT c THEN 1.0 ELSE 0.0 END").select("every_", "one", "none")),
    "proj_line_algebra": (on(days, lambda b: b.put(d=lines.div(F.col("close") - F.col("open"), F.col("high") - F.col("low")), cmp=lines.cmp(F.col("close"), F.col("open")), top=lines.max_(F.col("open"), F.col("close")), total=lines.sum_(F.col("open"), F.col("close")), pick=lines.if_(lines.gt(F.col("close"), F.col("open")), F.col("high"), F.col("low"))), "d", "cmp", "top", "total", "pick"), lambda s: s.put(d=ratio("close - open", "high - low"), cmp="sign(close - open)", top="greatest(open, close)", total="open + close", pick="CASE WHEN close > open THEN high ELSE low END").select("d", "cmp", "top", "total", "pick")),
    "proj_delay": (on(days, lambda b: b.put(back=b.lag("close", 3), ahead=b.lag("close", -2)), "back", "ahead"), lambda s: s.put(back=lag("close", 3), ahead=lag("close", -2)).select("back", "ahead")),
}


def _ema_on(kind: str, n: int = 30):
    return on(days, lambda b: folds.average(b, kind, n, out="v"), "v")


def _fold_on(make, ins, *outs):
    return on(days, lambda b: folds.fold(b, [(make, ins, list(outs))]), *outs)


def _dema(s: Sql, out: str = "v") -> Sql:
    return s.ema("close", 30, "_e1").ema("_e1", 30, "_e2").put(**{out: "2 * _e1 - _e2"})


def _tema(s: Sql, out: str = "v") -> Sql:
    return s.ema("close", 30, "_e1").ema("_e1", 30, "_e2").ema("_e2", 30, "_e3").put(**{out: "3 * _e1 - 3 * _e2 + _e3"})


def _rsi(s: Sql, n: int, back: int) -> str:
    s.put(_d=f"close - {lag('close', back)}").put(_u="CASE WHEN _d IS NOT NULL THEN greatest(_d, 0) END", _v="CASE WHEN _d IS NOT NULL THEN greatest(-_d, 0) END")
    s.smma("_u", n, "_up").smma("_v", n, "_dn")
    return s.put(v="CASE WHEN _dn = 0 THEN CASE WHEN _up = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + _up / _dn) END").select("v")


def _macd(s: Sql, prefix: str = "") -> str:
    signal, histo = f"{prefix}signal", f"{prefix}histo"
    s.ema("close", 12, "_a").ema("close", 26, "_b").put(_m="_a - _b").ema("_m", 9, signal).put(**{"macd": f"CASE WHEN {signal} IS NOT NULL THEN _m END", histo: f"_m - {signal}"})
    return s.select("macd", signal, histo)


def _ppo(s: Sql, base: str) -> str:
    s.ema("close", 12, "_a").ema("close", 26, "_b").put(_m=f"100 * (_a - _b) / {base}").ema("_m", 9, "signal").put(ppo="CASE WHEN signal IS NOT NULL THEN _m END", histo="_m - signal")
    return s.select("ppo", "signal", "histo")


def _trix(s: Sql) -> str:
    s.ema("close", 15, "_a").ema("_a", 15, "_b").ema("_b", 15, "_c").put(trix=f"100 * (_c / {lag('_c')} - 1)").ema("trix", 9, "signal")
    return s.select("trix", "signal")


def _tsi(s: Sql) -> str:
    s.put(_d=f"close - {lag('close')}").put(_e="abs(_d)").ema("_d", 25, "_a").ema("_a", 13, "_b").ema("_e", 25, "_f").ema("_f", 13, "_g")
    return s.put(v=ratio("100 * _b", "_g")).select("v")


def _atr(s: Sql, n: int = 14) -> Sql:
    return s.put(_tr=TRN).smma("_tr", n, "_atr")


def _directional(s: Sql) -> str:
    s.put(_u=f"high - {lag('high')}", _d=f"{lag('low')} - low")
    s.put(_p="CASE WHEN _u IS NOT NULL THEN CASE WHEN _u > _d AND _u > 0 THEN _u ELSE 0 END END", _m="CASE WHEN _d IS NOT NULL THEN CASE WHEN _d > _u AND _d > 0 THEN _d ELSE 0 END END")
    _atr(s).smma("_p", 14, "_sp").smma("_m", 14, "_sm").put(plus_di="100 * _sp / _atr", minus_di="100 * _sm / _atr")
    s.put(_dx="CASE WHEN plus_di + minus_di = 0 THEN 0 ELSE 100 * abs(plus_di - minus_di) / (plus_di + minus_di) END").smma("_dx", 14, "adx").put(adxr=f"(adx + {lag('adx', 14)}) / 2")
    return s.select("adx", "adxr", "plus_di", "minus_di")


def _zlema(s: Sql) -> str:
    return s.put(_x=f"2 * close - {lag('close', 14)}").ema("_x", 30, "v").select("v")


def _heikin(s: Sql) -> str:
    # open_i = (open_{i-1} + close_{i-1}) / 2 is an average of alpha one half.
    s.put(hc="(open + high + low + close) / 4", _k=f"row_number() {ORDER}").put(_x=f"CASE WHEN _k = 1 THEN (open + close) / 2 ELSE {lag('hc')} END")
    s.ema("_x", 1, "ho", 0.5).put(hh="greatest(high, ho, hc)", hl="least(low, ho, hc)")
    return s.select("ho", "hh", "hl", "hc")


def _heikin_bars() -> str:
    s = Sql()
    _heikin(s)
    cells = ", ".join(f"round({x}, 4) + 0.0 AS {c}" for x, c in (("ho", "open"), ("hh", "high"), ("hl", "low"), ("hc", "close"), ("volume", "volume")))
    return f"{s.text} SELECT symbol, ts, {cells} FROM {s.table}"


def _chart(_: Sql) -> str:
    w = lambda f: f(Sql())
    one = lambda name, f: w(lambda s: f(s).put(**{name: "v"}).select(name))
    named = lambda sql, old, new: f"SELECT symbol, ts, {old} AS {new} FROM ({sql})"
    return rec.together(
        one("ema", lambda s: s.ema("close", 30, "v")), one("smma", lambda s: s.smma("close", 30, "v")), one("kama", rec.kama), named(w(lambda s: _rsi(s, 14, 1)), "v", "rsi"), named(w(_macd), "macd", "macd"),
        named(w(lambda s: _ppo(s, "_b")), "ppo", "ppo"), named(w(_trix), "trix", "trix"), named(w(_tsi), "v", "tsi"), one("atr", lambda s: _atr(s).put(v="_atr")),
        one("pgo", lambda s: _atr(s).put(v=ratio(f"close - ({mean('close', 14)})", "_atr"))), named(w(_directional), "adx", "adx"),
    )


#: name: (Spark, SQL) over daily bars by folds.
FOLDS: dict[str, tuple[Query, Callable[[Sql], str]]] = {
    "ma_ema": (_ema_on("ema"), lambda s: s.ema("close", 30, "v").select("v")),
    "ma_ema_blocks": (on(days, lambda b: blocks.ema(b, out="v"), "v"), lambda s: s.ema("close", 30, "v").select("v")),
    "mom_rsi_blocks": (on(days, lambda b: blocks.rsi(b, out="v"), "v"), lambda s: _rsi(s, 14, 1)),
    "mom_macd_blocks": (on(days, lambda b: blocks.macd(b), "macd", "macd_signal", "macd_histo"), lambda s: _macd(s, "macd_")),
    "ma_kama_blocks": (on(days, lambda b: affine.kama(b, out="v", rows=500), "v"), lambda s: rec.kama(s).select("v")),
    "mom_laguerre_blocks": (on(days, lambda b: affine.laguerre(b, rows=500), "lagf", "lrsi"), rec.laguerre),
    "trend_directional_blocks": (on(days, lambda b: affine.directional(b, rows=500), "adx", "adxr", "plus_di", "minus_di"), _directional),
    "ma_smma": (_ema_on("smma"), lambda s: s.smma("close", 30, "v").select("v")),
    "ma_dema": (_ema_on("dema"), lambda s: _dema(s).select("v")),
    "ma_tema": (_ema_on("tema"), lambda s: _tema(s).select("v")),
    "ma_zlema": (_ema_on("zlema"), _zlema),
    "ma_kama": (_ema_on("kama"), lambda s: rec.kama(s).select("v")),
    "ma_zlind": (_ema_on("zlind"), lambda s: rec.zero_lag(s).select("v")),
    "ma_dma": (_ema_on("dma"), rec.dickson),
    "ma_exponential_smoothing": (_fold_on(lambda: folds.Ema(10, 0.3), ["close"], "v"), lambda s: s.ema("close", 10, "v", 0.3).select("v")),
    **{f"env_{k}": (on(days, lambda b, k=k: folds.envelope(b, k), "env_mid", "env_top", "env_bot"), (lambda s, f=f: f(s).put(env_top="env_mid * 1.025", env_bot="env_mid * 0.975").select("env_mid", "env_top", "env_bot")) if f else None) for k, f in (("ema", lambda s: s.ema("close", 30, "env_mid")), ("smma", lambda s: s.smma("close", 30, "env_mid")), ("dema", lambda s: _dema(s, "env_mid")), ("tema", lambda s: _tema(s, "env_mid")), ("wma", lambda s: s.put(env_mid=f"{weighted('close', range(1, 31))} * {2.0 / (30 * 31)}")), ("kama", lambda s: rec.kama(s, "env_mid", stepped=True)))},
    **{f"osc_{k}": (on(days, lambda b, k=k: folds.oscillator(b, k), "osc"), (lambda s, f=f: f(s).put(osc="close - _avg").select("osc")) if f else None) for k, f in (("ema", lambda s: s.ema("close", 30, "_avg")), ("smma", lambda s: s.smma("close", 30, "_avg")), ("dema", lambda s: _dema(s, "_avg")), ("tema", lambda s: _tema(s, "_avg")), ("wma", lambda s: s.put(_avg=f"{weighted('close', range(1, 31))} * {2.0 / (30 * 31)}")), ("kama", lambda s: rec.kama(s, "_avg")))},
    "mom_rsi": (_fold_on(folds.Rsi, ["close"], "v"), lambda s: _rsi(s, 14, 1)),
    "mom_rmi": (_fold_on(lambda: folds.Rsi(20, 5), ["close"], "v"), lambda s: _rsi(s, 20, 5)),
    "mom_laguerre": (_fold_on(folds.Laguerre, ["close"], "lagf", "lrsi"), rec.laguerre),
    "mom_macd": (_fold_on(folds.Macd, ["close"], "macd", "signal", "histo"), _macd),
    "mom_price_oscillator": (_fold_on(folds.PriceOscillator, ["close"], "v"), lambda s: s.ema("close", 12, "_a").ema("close", 26, "_b").put(v="_a - _b").select("v")),
    "mom_ppo": (_fold_on(folds.Ppo, ["close"], "ppo", "signal", "histo"), lambda s: _ppo(s, "_b")),
    "mom_ppo_short": (_fold_on(lambda: folds.Ppo(short=True), ["close"], "ppo", "signal", "histo"), lambda s: _ppo(s, "_a")),
    "mom_trix": (_fold_on(folds.Trix, ["close"], "trix", "signal"), _trix),
    "mom_tsi": (_fold_on(folds.Tsi, ["close"], "v"), _tsi),
    "mom_pretty_good": (_fold_on(folds.PrettyGood, HLC, "v"), lambda s: _atr(s).put(v=ratio(f"close - ({mean('close', 14)})", "_atr")).select("v")),
    "trend_directional": (_fold_on(folds.Directional, HLC, "adx", "adxr", "plus_di", "minus_di"), _directional),
    "trend_parabolic": (_fold_on(folds.Parabolic, HLC, "sar", "side"), rec.parabolic),
    "vol_atr": (_fold_on(folds.Atr, HLC, "v"), lambda s: _atr(s).put(v="_atr").select("v")),
    "vol_hurst": (on(days, win.hurst, "hurst"), rec.hurst),
    "sig_heikin_ashi": (_fold_on(folds.HeikinAshi, OHLC, "ho", "hh", "hl", "hc"), _heikin),
    "sig_counting": (on(days, lambda b: signals.counting(b.put(up=signals.simple(F.col("close") > F.col("open"))), "up", 3, 4), "signal"), rec.counting),
    "talib_chart": (on(days, folds.chart, "ema", "smma", "kama", "rsi", "macd", "ppo", "trix", "tsi", "atr", "pgo", "adx"), _chart),
}


def _plain(f: Callable[[DataFrame], DataFrame], *columns: str, source: Callable = days) -> Query:
    return lambda spark, sf_dir: rounded(f(source(spark, sf_dir)), *columns)


BAR = ("open", "high", "low", "close", "volume")
RB = ", ".join(f"round({c}, 4) AS {c}" for c in BAR)


def _period(unit: str) -> str:
    return f"""WITH {DAYS} SELECT symbol, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS ts, round(arg_min(open, ts), 4) AS open, round(max(high), 4) AS high, round(min(low), 4) AS low, round(arg_max(close, ts), 4) AS close, round(sum(volume), 4) AS volume
FROM bars GROUP BY symbol, date_trunc('{unit}', ts)"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = days(spark, sf_dir)
    out = resample.chain([d.where("ts < '1998-01-01'"), d.where("ts >= '1997-06-01' and ts < '2000-01-01'"), d.where("ts >= '1999-01-01'")])
    return out.groupBy("symbol", "feed").agg(F.count("*").alias("n"), F.round(F.sum("close"), 3).alias("total"))


def _roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = days(spark, sf_dir)
    out = resample.roll_over([d.where("ts < '1998-01-01'"), d.where("ts >= '1997-06-01'").withColumn("volume", F.col("volume") * 2)])
    return out.groupBy("symbol", "contract").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = days(spark, sf_dir)
    out = resample.asof(d, resample.resample(d, "month"), ["close", "high"])
    return rounded(out, "close", "slow_close", "slow_high")


def _align(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = days(spark, sf_dir)
    out = resample.align(d, d, ["close"], pairs=[("A", "R"), ("N", "A"), ("R", "N")])
    return out.select("symbol", "symbol2", "ts", F.round("close", 4).alias("close"), F.round("close2", 4).alias("close2"))


def _measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = readers.measurement(table(spark, sf_dir, "events"), fields={"value": "mean"}, tags={"event_type": "click"}, start="2024-01-05", end="2024-01-20", unit="hour", n=6)
    return q.select("ts", F.round("mean_value", 4).alias("mean_value"))


def _equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes as a value curve, for figures that SQL can repeat."""
    return days(spark, sf_dir).select("symbol", "ts", F.col("close").alias("value"))


def _table_of(f: Callable[[DataFrame], DataFrame], digits: int = 4) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(_equity(spark, sf_dir))
        return out.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])

    return run


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots of line items as fills: returned ones sell, the others buy."""
    li = table(spark, sf_dir, "lineitem")
    f = li.groupBy(F.col("l_linestatus").alias("symbol"), F.col("l_shipdate").alias("ts"), (F.col("l_returnflag") == "R").alias("sells")).agg(F.sum("l_quantity").alias("q"), F.max("l_extendedprice").alias("price"))
    f = f.select("symbol", "ts", F.when(F.col("sells"), -F.col("q")).otherwise(F.col("q")).alias("size"), "price")
    return an.round_trips(f).groupBy("symbol").agg(F.round(F.sum("quantity"), 4).alias("quantity"), F.count("*").alias("trips"))


TRIPS_SQL = """WITH f AS (
  SELECT l_linestatus AS symbol, l_shipdate AS ts, l_returnflag = 'R' AS sells, sum(l_quantity) AS q, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL
), c AS (SELECT *, sum(q) OVER (PARTITION BY symbol, sells ORDER BY ts) AS hi FROM f), d AS (SELECT *, hi - q AS lo FROM c)
SELECT a.symbol, round(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)), 4) AS quantity, count(*) AS trips
FROM d a JOIN d b ON a.symbol = b.symbol AND NOT a.sells AND b.sells AND least(a.hi, b.hi) > greatest(a.lo, b.lo) GROUP BY a.symbol"""


def _returns_sql(unit: str) -> str:
    return f"""WITH {DAYS}, p AS (SELECT symbol, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS period, arg_min(close, ts) AS first, arg_max(close, ts) AS last FROM bars GROUP BY symbol, date_trunc('{unit}', ts)
), r AS (SELECT symbol, period, last / coalesce(lag(last) OVER (PARTITION BY symbol ORDER BY period), first) - 1 AS ret, first, last FROM p)"""


DRAWDOWN_SQL = f"""WITH {DAYS}, p AS (SELECT symbol, ts, close, max(close) {SO_FAR} AS peak, row_number() {ORDER} AS n FROM bars
), d AS (SELECT *, max(CASE WHEN close >= peak THEN n END) {SO_FAR} AS top FROM p)"""



def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"flagship_event_cross": flagship}
    out |= {k: q for k, (q, _) in WINDOWS.items()} | {k: q for k, (q, _) in FOLDS.items()}
    out |= {
        "src_between": _plain(lambda d: readers.between(d, "1996-01-01", "1997-12-31"), *BAR),
        "src_measurement": _measure,
        "agg_resample_day": _plain(lambda d: d, *BAR),
        "agg_resample_week": _plain(lambda d: resample.resample(d, "week"), *BAR),
        "agg_resample_month": _plain(lambda d: resample.resample(d, "month"), *BAR),
        "agg_resample_year": _plain(lambda d: resample.resample(d, "year"), *BAR),
        "agg_resample_ordinal": _plain(lambda d: resample.resample_ordinal(d, "week"), *BAR),
        "agg_replay": _plain(lambda d: resample.replay(d, "week"), *BAR),
        "join_asof": _asof,
        "join_align": _align,
        "set_chain": _chain,
        "set_roll_over": _roll,
        "flt_calendar_days": _plain(lambda d: filters.calendar_days(d, months=(1, 2, 3)), *BAR),
        "flt_data_filter": _plain(lambda d: filters.keep(d, F.col("close") > 50), *BAR),
        "flt_day_steps": _plain(lambda d: filters.day_steps(d, 10), *BAR),
        "flt_data_filler": _plain(lambda d: filters.fill(d.where("dayofmonth(ts) > 3"), 86400), *BAR),
        "flt_splits": lambda s, d: rounded(filters.split_adjust(days(s, d), days(s, d).where("month(ts) = 7 and dayofmonth(ts) = 1").select("symbol", "ts", F.lit(2.0).alias("ratio"))), *BAR),
        "flt_heikin_ashi": _plain(filters.heikin_ashi, *BAR),
        "flt_renko": lambda s, d: filters.renko(days(s, d), 5.0).select("symbol", "ts", "box", *[F.round(c, 4).alias(c) for c in OHLC]),
        "an_annual_return": _table_of(an.annual_return),
        "an_time_return": _table_of(lambda e: an.time_return(e, "month").select("symbol", "period", "ret")),
        "an_returns": _table_of(lambda e: an.returns(e).select("symbol", "rtot", "ravg")),
        "an_rolling_log_returns": _table_of(an.rolling_log_returns),
        "an_drawdown": _table_of(an.drawdown),
        "an_max_drawdown": _table_of(an.max_drawdown),
        "an_time_drawdown": _table_of(an.time_drawdown),
        "an_calmar": _table_of(an.calmar),
        "an_sharpe": _table_of(lambda e: an.sharpe(e, "month", annualize=True)),
        "an_vwr": _table_of(an.vwr),
        "an_round_trips": _trips,
        "an_round_trips_whole": _trips,
        "an_total_value": _table_of(an.total_value),
        "obs_log_returns": _table_of(an.log_returns),
        "obs_fund": _table_of(an.fund),
        "obs_benchmark": lambda s, d: an.benchmark(_equity(s, d), days(s, d).select("symbol", "ts", F.col("open").alias("value"))).select("symbol", *[F.round(c, 4).alias(c) for c in ("beta", "correlation", "tracking_error")]),
        "str_timers": lambda s, d: timers.timers(resample.from_ticks(table(s, d, "events"), "event_type", "ts", "value", "hour", ties=("event_id",)), "06:30:00", repeat=6 * 3600, weekdays=(1, 3, 5)),
        "str_tumbling": lambda s, d: rounded(streams.tumbling(ticks(s, d), "6 hours", tie="event_id"), *BAR),
        "str_sessions": lambda s, d: streams.sessions(ticks(s, d), "20 minutes").select("symbol", "ts", "until", F.round("high", 4).alias("high"), F.round("low", 4).alias("low"), "ticks"),
    }
    return out | trading.queries() | strategies.queries() | live.queries() | trends.queries() | files.queries() | units.queries()


def oracle_sql() -> dict[str, str]:
    out = {"flagship_event_cross": FLAGSHIP_SQL}
    out |= {k: f(Sql()) for k, (_, f) in WINDOWS.items()}
    out |= {k: f(Sql()) for k, (_, f) in FOLDS.items()}
    month = _returns_sql("month")
    out |= {
        "src_between": f"WITH {DAYS} SELECT symbol, ts, {RB} FROM bars WHERE ts >= '1996-01-01' AND ts <= '1997-12-31'",
        "src_measurement": "SELECT time_bucket(INTERVAL '6 hours', ts) AS ts, round(avg(value), 4) AS mean_value FROM events WHERE event_type = 'click' AND ts >= '2024-01-05' AND ts < '2024-01-20' GROUP BY 1",
        "agg_resample_day": f"WITH {DAYS} SELECT symbol, ts, {RB} FROM bars",
        "agg_resample_week": _period("week"),
        "agg_resample_month": _period("month"),
        "agg_resample_year": _period("year"),
        "agg_resample_ordinal": f"WITH {DAYS}, n AS (SELECT *, (row_number() {ORDER} - 1) // 5 AS p FROM bars) SELECT symbol, max(ts) AS ts, round(arg_min(open, ts), 4) AS open, round(max(high), 4) AS high, round(min(low), 4) AS low, round(arg_max(close, ts), 4) AS close, round(sum(volume), 4) AS volume FROM n GROUP BY symbol, p",
        "agg_replay": f"WITH {DAYS}, b AS (SELECT *, date_trunc('week', ts) AS p FROM bars) SELECT symbol, ts, round(first_value(open) OVER w, 4) AS open, round(max(high) OVER w, 4) AS high, round(min(low) OVER w, 4) AS low, round(close, 4) AS close, round(sum(volume) OVER w, 4) AS volume FROM b WINDOW w AS (PARTITION BY symbol, p ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        "join_asof": f"WITH {DAYS}, m AS (SELECT symbol, CAST(date_trunc('month', ts) AS TIMESTAMP) AS mts, arg_max(close, ts) AS c, max(high) AS h FROM bars GROUP BY symbol, date_trunc('month', ts)) SELECT b.symbol, b.ts, round(close, 4) AS close, round(c, 4) AS slow_close, round(h, 4) AS slow_high FROM bars b ASOF LEFT JOIN m ON b.symbol = m.symbol AND b.ts >= m.mts",
        "join_align": f"WITH {DAYS} SELECT a.symbol, b.symbol AS symbol2, a.ts, round(a.close, 4) AS close, round(b.close, 4) AS close2 FROM bars a JOIN bars b ON a.ts = b.ts WHERE (a.symbol, b.symbol) IN (('A', 'R'), ('N', 'A'), ('R', 'N'))",
        "set_chain": f"WITH {DAYS}, f AS (SELECT *, 0 AS feed FROM bars WHERE ts < '1998-01-01' UNION ALL SELECT *, 1 FROM bars WHERE ts >= '1997-06-01' AND ts < '2000-01-01' UNION ALL SELECT *, 2 FROM bars WHERE ts >= '1999-01-01'), e AS (SELECT symbol, feed, max(ts) AS e FROM f GROUP BY ALL), g AS (SELECT symbol, feed, max(e) OVER (PARTITION BY symbol ORDER BY feed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e) SELECT f.symbol, CAST(f.feed AS INTEGER) AS feed, count(*) AS n, round(sum(close), 3) AS total FROM f JOIN g ON f.symbol = g.symbol AND f.feed = g.feed WHERE b IS NULL OR ts > b GROUP BY f.symbol, f.feed",
        "set_roll_over": f"WITH {DAYS}, c AS (SELECT * FROM bars WHERE ts < '1998-01-01'), n AS (SELECT symbol, ts, volume * 2 AS volume FROM bars WHERE ts >= '1997-06-01'), r AS (SELECT c.symbol, min(c.ts) AS r FROM c JOIN n ON c.symbol = n.symbol AND c.ts = n.ts WHERE n.volume > c.volume GROUP BY c.symbol), u AS (SELECT symbol, ts, 0 AS contract FROM c JOIN r USING (symbol) WHERE ts < r UNION ALL SELECT symbol, ts, 1 FROM n JOIN r USING (symbol) WHERE ts >= r) SELECT symbol, CAST(contract AS INTEGER) AS contract, count(*) AS n, min(ts) AS first, max(ts) AS last FROM u GROUP BY symbol, contract",
        "flt_calendar_days": f"WITH {DAYS} SELECT symbol, ts, {RB} FROM bars WHERE isodow(ts) <= 5 AND month(ts) IN (1, 2, 3)",
        "flt_data_filter": f"WITH {DAYS} SELECT symbol, ts, {RB} FROM bars WHERE close > 50",
        "flt_data_filler": f"WITH {DAYS}, b AS (SELECT *, {lag('ts', -1)} AS nxt FROM bars WHERE day(ts) > 3), n AS (SELECT *, CASE WHEN nxt - ts > INTERVAL 36 HOURS THEN date_diff('day', ts, nxt) - 1 ELSE 0 END AS n FROM b), e AS (SELECT *, unnest(range(0, n + 1)) AS i FROM n) SELECT symbol, ts + to_days(CAST(i AS INTEGER)) AS ts, {', '.join(f'round(CASE WHEN i > 0 THEN close ELSE {c} END, 4) AS {c}' for c in OHLC)}, round(CASE WHEN i > 0 THEN 0 ELSE volume END, 4) AS volume FROM e",
        "flt_splits": f"WITH {DAYS}, s AS (SELECT symbol, ts AS sts, 2.0 AS r FROM bars WHERE month(ts) = 7 AND day(ts) = 1), j AS (SELECT b.*, coalesce(r, 1.0) AS r FROM bars b ASOF LEFT JOIN s ON b.symbol = s.symbol AND b.ts >= s.sts) SELECT symbol, ts, {', '.join(f'round({c} / r, 4) AS {c}' for c in OHLC)}, round(volume * r, 4) AS volume FROM j",
        "flt_heikin_ashi": _heikin_bars(),
        "an_annual_return": _returns_sql("year") + " SELECT symbol, CAST(year(period) AS INTEGER) AS year, round(ret, 4) + 0.0 AS ret FROM r",
        "an_time_return": month + " SELECT symbol, period, round(ret, 4) + 0.0 AS ret FROM r",
        "an_returns": f"WITH {DAYS}, l AS (SELECT symbol, ln(close / {lag('close')}) AS l FROM bars) SELECT symbol, round(sum(l), 4) + 0.0 AS rtot, round(avg(l), 4) + 0.0 AS ravg FROM l GROUP BY symbol",
        "an_rolling_log_returns": f"WITH {DAYS}, l AS (SELECT symbol, ts, ln(close / first_value(close) {over(20)}) AS logret FROM bars), m AS (SELECT *, avg(logret) {SO_FAR} AS mean, stddev_pop(logret) {SO_FAR} AS std FROM l) SELECT symbol, ts, round(logret, 4) + 0.0 AS logret, round(mean, 4) + 0.0 AS mean, round(std, 4) + 0.0 AS std, round(mean / nullif(std, 0), 4) + 0.0 AS sharpe FROM m",
        "an_drawdown": DRAWDOWN_SQL + " SELECT symbol, ts, round(close, 4) AS value, round(peak, 4) AS peak, round(peak - close, 4) AS money, round(100 * (peak - close) / peak, 4) AS drawdown, CAST(n - top AS INTEGER) AS length FROM d",
        "an_max_drawdown": DRAWDOWN_SQL + " SELECT symbol, round(max(peak - close), 4) AS money, round(max(100 * (peak - close) / peak), 4) AS drawdown, CAST(max(n - top) AS INTEGER) AS length FROM d GROUP BY symbol",
        "an_sharpe": month + ", x AS (SELECT symbol, ret - (pow(1.01, 1.0 / 12) - 1) AS x FROM r) SELECT symbol, round(avg(x) / nullif(stddev_pop(x), 0) * sqrt(12), 4) AS sharpe FROM x GROUP BY symbol",
        "an_time_drawdown": f"WITH {DAYS}, m AS (SELECT symbol, date_trunc('month', ts) AS ts, arg_max(close, ts) AS close FROM bars GROUP BY symbol, date_trunc('month', ts)), p AS (SELECT symbol, ts, close, max(close) {SO_FAR} AS peak, row_number() {ORDER} AS n FROM m), d AS (SELECT *, max(CASE WHEN close >= peak THEN n END) {SO_FAR} AS top FROM p) SELECT symbol, round(max(peak - close), 4) AS money, round(max(100 * (peak - close) / peak), 4) AS drawdown, CAST(max(n - top) AS INTEGER) AS length FROM d GROUP BY symbol",
        "an_calmar": month + f", g AS (SELECT symbol, avg(ln(last / first)) AS mean FROM r GROUP BY symbol), q AS (SELECT symbol, close, max(close) {SO_FAR} AS peak FROM bars), x AS (SELECT symbol, max(100 * (peak - close) / peak) AS drawdown FROM q GROUP BY symbol) SELECT symbol, round(mean, 4) + 0.0 AS mean, round(drawdown, 4) AS drawdown, round(CASE WHEN drawdown > 0 THEN mean / (drawdown / 100) ELSE 'inf'::DOUBLE END, 4) + 0.0 AS calmar FROM g JOIN x USING (symbol)",
        "an_vwr": month + ", l AS (SELECT symbol, ret, ln(1 + ret) AS l FROM r WHERE ret > -1), a AS (SELECT *, avg(l) OVER (PARTITION BY symbol) AS m FROM l), g AS (SELECT symbol, exp(avg(l)) - 1 AS mean, stddev_samp(l) AS std, avg(pow(l - m, 3)) / pow(avg(pow(l - m, 2)), 1.5) AS skew, sqrt(avg(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END)) AS downside FROM a GROUP BY symbol) SELECT symbol, round(mean, 4) + 0.0 AS mean, round(std, 4) AS std, round(skew, 4) + 0.0 AS skew, round(downside, 4) AS downside, round(mean / nullif(std, 0), 4) + 0.0 AS vwr, round(mean / nullif(std, 0) * sqrt(12), 4) + 0.0 AS vwr_annual FROM g",
        "an_round_trips": TRIPS_SQL,
        "an_round_trips_whole": TRIPS_SQL,
        "an_total_value": f"WITH {DAYS} SELECT symbol, round(arg_min(close, ts), 4) AS first, round(arg_max(close, ts), 4) AS last, round(min(close), 4) AS least, round(max(close), 4) AS most FROM bars GROUP BY symbol",
        "obs_log_returns": f"WITH {DAYS}, l AS (SELECT symbol, ts, ln(close / {lag('close')}) AS l FROM bars) SELECT symbol, ts, round(l, 4) + 0.0 AS logret, round(sum(l) {SO_FAR}, 4) + 0.0 AS total, round(avg(l) {SO_FAR} * 252, 4) + 0.0 AS annual FROM l",
        "obs_fund": f"WITH {DAYS}, f AS (SELECT symbol, ts, close, first_value(close) {ORDER} AS f FROM bars) SELECT symbol, ts, round(close / f * 100, 4) AS fund_value, round(f / 100, 4) AS fund_shares FROM f",
        "obs_benchmark": f"WITH {DAYS}, r AS (SELECT symbol, close / {lag('close')} - 1 AS a, open / {lag('open')} - 1 AS b FROM bars) SELECT symbol, round(covar_pop(a, b) / var_pop(b), 4) AS beta, round(corr(a, b), 4) AS correlation, round(stddev_pop(a - b), 4) AS tracking_error FROM r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY symbol",
        "str_timers": "WITH b AS (SELECT DISTINCT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts FROM events WHERE value IS NOT NULL), d AS (SELECT DISTINCT symbol, CAST(ts AS DATE) AS d FROM b WHERE isodow(ts) IN (1, 3, 5)), c AS (SELECT symbol, d, CAST(d AS TIMESTAMP) + to_minutes(390 + 360 * i) AS due FROM d, range(0, 3) t(i)) SELECT c.symbol, due, min(b.ts) AS ts FROM c JOIN b ON b.symbol = c.symbol AND CAST(b.ts AS DATE) = d AND b.ts >= due GROUP BY c.symbol, due",
        "str_tumbling": "SELECT event_type AS symbol, time_bucket(INTERVAL '6 hours', events.ts) AS ts, round(first(value ORDER BY events.ts, event_id), 4) AS open, round(max(value), 4) AS high, round(min(value), 4) AS low, round(last(value ORDER BY events.ts, event_id), 4) AS close, round(CAST(count(*) AS DOUBLE), 4) AS volume FROM events WHERE value IS NOT NULL GROUP BY event_type, time_bucket(INTERVAL '6 hours', events.ts)",
        "str_sessions": "WITH o AS (SELECT event_type AS symbol, ts, value, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS b FROM events WHERE value IS NOT NULL), g AS (SELECT *, sum(CASE WHEN b IS NULL OR ts - b >= INTERVAL 20 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM o) SELECT symbol, min(ts) AS ts, max(ts) + INTERVAL 20 MINUTES AS until, round(max(value), 4) AS high, round(min(value), 4) AS low, count(*) AS ticks FROM g GROUP BY symbol, s",
    }
    out |= {"flt_day_steps": rec.day_steps(Sql(), RB), "flt_renko": rec.renko(Sql())}
    return out | trading.oracle_sql() | strategies.oracle_sql() | live.oracle_sql() | trends.oracle_sql() | files.oracle_sql() | units.oracle_sql()
