"""Queries of what lines say of a trend, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, readings
from ..operators import windows as win
from ..operators.frame import Bars
from .bars import Query, days
from .sql import ORDER, Sql, agg, lag, mean, ratio
from .trading import _r, near

UP, DOWN = "vortex_plus", "vortex_minus"


def _lines(s: SparkSession, d: str) -> Bars:
    return win.vortex(Bars(days(s, d)))


def _readings(s: SparkSession, d: str) -> DataFrame:
    b = readings.readings(_lines(s, d), UP, DOWN)
    return near(b.df.select("symbol", "ts", *[f"trend_{c}" for c in ("strength", "direction", "grade", "momentum", "regime")]))


def _divergences(s: SparkSession, d: str) -> DataFrame:
    b = readings.divergences(_lines(s, d), F.col(UP) - F.col(DOWN), lookback=2)
    b = readings.divergences(folds.ha_delta(b), "hadelta", lookback=1, out="ha_divergence")
    return near(b.df.select("symbol", "ts", "divergence", "ha_divergence"))


def queries() -> dict[str, Query]:
    return {
        "trend_readings": _readings,
        "trend_validated": lambda s, d: near(readings.validated(_lines(s, d), UP, DOWN)),
        "trend_line_stats": lambda s, d: near(readings.line_stats(_lines(s, d), UP, DOWN)),
        "trend_divergences": _divergences,
    }


def _vortex() -> Sql:
    tr = f"CASE WHEN {lag('close')} IS NOT NULL THEN greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END"
    s = Sql().put(_p=f"abs(high - {lag('low')})", _m=f"abs(low - {lag('high')})", _t=tr)
    total = agg("sum", "_t", 14)
    s.put(**{f"vortex_{k}": f"CASE WHEN ({total}) IS NOT NULL THEN coalesce({ratio(agg('sum', c, 14), total)}, 0) END" for k, c in (("plus", "_p"), ("minus", "_m"))})
    return s.put(d=f"{UP} - {DOWN}")


def _diverging(x: str, price: str, n: int) -> str:
    side = lambda f, c, a, b: f"{f}({c}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {a} AND {b})"
    past, ahead = (f"{n} PRECEDING", "1 PRECEDING"), ("1 FOLLOWING", f"{n} FOLLOWING")
    above = lambda c: f"({c} > {side('max', c, *past)} AND {c} > {side('max', c, *ahead)})"
    below = lambda c: f"({c} < {side('min', c, *past)} AND {c} < {side('min', c, *ahead)})"
    return f"CASE WHEN {side('count', x, f'{n} PRECEDING', f'{n} FOLLOWING')} = {2 * n + 1} THEN CASE WHEN {above(x)} AND {below(price)} THEN 1.0 WHEN {below(x)} AND {above(price)} THEN -1.0 ELSE 0.0 END END"


def oracle_sql() -> dict[str, str]:
    read = _vortex().put(_u="CASE WHEN d IS NOT NULL THEN CASE WHEN d > 0.05 THEN 1.0 ELSE 0.0 END END", _w="CASE WHEN d IS NOT NULL THEN CASE WHEN d < -0.05 THEN 1.0 ELSE 0.0 END END")
    read.put(_us=mean("_u", 20), _ws=mean("_w", 20)).put(trend_regime="CASE WHEN _us > 0.6 THEN 'up' WHEN _ws > 0.6 THEN 'down' WHEN 1 - _us - _ws > 0.6 THEN 'ranging' WHEN _us IS NOT NULL THEN 'volatile' END", _mom=f"d - {lag('d', 3)}")
    grade = " + ".join(f"CASE WHEN abs(d) >= {g} THEN 1.0 ELSE 0.0 END" for g in (0.05, 0.1, 0.2, 0.35))
    kept = _vortex().put(_b=lag("d")).put(_x="CASE WHEN d > 0 AND _b <= 0 THEN 1 WHEN d < 0 AND _b >= 0 THEN -1 END", _e=lag("close", -5)).put(_g="_x * (_e - close) / close")
    stats = _vortex()
    ha = _vortex().put(_c="(open + high + low + close) / 4", _k=f"row_number() {ORDER}")
    ha.put(_x=f"CASE WHEN _k = 1 THEN (open + close) / 2 ELSE {lag('_c')} END").ema("_x", 1, "_o", 0.5).put(hadelta="_c - _o")
    ha.put(divergence=_diverging("d", "close", 2), ha_divergence=_diverging("hadelta", "close", 1))
    return {
        "trend_readings": f"{read.text} SELECT symbol, ts, {_r(trend_strength='abs(d)', trend_direction='sign(d)', trend_grade=f'CASE WHEN d IS NOT NULL THEN {grade} END', trend_momentum='_mom')}, trend_regime FROM {read.table}",
        "trend_validated": f"{kept.text} SELECT symbol, count(*) AS signals, CAST(sum(CASE WHEN _g > 0 THEN 1 ELSE 0 END) AS BIGINT) AS correct, {_r(accuracy='avg(CASE WHEN _g > 0 THEN 1.0 ELSE 0.0 END)', average='avg(_g)', best='max(_g)', worst='min(_g)')} FROM {kept.table} WHERE _g IS NOT NULL GROUP BY symbol",
        "trend_line_stats": f"{stats.text}, g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back, d > 0 AS above, lag(d > 0) {ORDER} AS was FROM {stats.table} WHERE d IS NOT NULL), h AS (SELECT * REPLACE (CASE WHEN back < 100 THEN was END AS was) FROM g WHERE back <= 100) SELECT symbol, {_r(**{f'{k}_{n}': f'{f}({c})' for k, c in (('up', UP), ('down', DOWN)) for n, f in (('average', 'avg'), ('most', 'max'), ('least', 'min'))})}, CAST(sum(CASE WHEN above AND NOT was THEN 1 ELSE 0 END) AS BIGINT) AS rises, CAST(sum(CASE WHEN NOT above AND was THEN 1 ELSE 0 END) AS BIGINT) AS falls FROM h GROUP BY symbol",
        "trend_divergences": f"{ha.text} SELECT symbol, ts, {_r(divergence='divergence', ha_divergence='ha_divergence')} FROM {ha.table}",
    }
