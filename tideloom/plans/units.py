"""Queries of line functions, dates, signals, streams and things of one's own
making, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, lines
from ..operators import filters, folds, resample, signals
from ..operators import windows as win
from ..operators.frame import Bars
from .bars import Query, days, hours, rounded, table, ticks
from .registry import indicator
from .sources import HOURS
from .sql import DAYS, ORDER, SO_FAR, Sql, agg, lag, mean, ratio, values

BAR = ("open", "high", "low", "close", "volume")


class RisingRun:
    """An indicator of one's own: bars in a row that closed higher."""

    def __init__(self):
        self.last, self.n = float("nan"), 0

    def push(self, x):
        out = []
        for v in x.tolist():
            self.n = self.n + 1 if v > self.last else 0
            self.last = v
            out.append(float(self.n))
        return np.array(out)


def ulcer(equity: DataFrame) -> DataFrame:
    """An analyzer of one's own: root mean square of the drawdown."""
    from ..operators.analyzers import drawdown

    return drawdown(equity).groupBy("symbol").agg(F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown"))).alias("ulcer"))


def _two(b: Bars) -> Bars:
    return b.put(a=lines.gt(F.col("close"), F.col("open")), c=lines.gt(F.col("close"), F.lit(50.0)))


def _zeros(b: Bars) -> Bars:
    return b.put(x=F.when(F.dayofmonth("ts") == 1, 0.0).otherwise(F.col("open")), y=F.when(F.dayofmonth("ts") <= 2, 0.0).otherwise(F.col("close")))


def _on(f: Callable[[Bars], Bars], *columns: str, source: Callable = days) -> Query:
    return lambda s, d: rounded(f(Bars(source(s, d))).df, *columns)


def _holes(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"close": F.when(F.dayofmonth("ts") % 7 == 3, 0.0).otherwise(F.col("close")), "open": F.when(F.dayofmonth("ts") % 5 != 2, F.col("open"))})


def _numbers(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", "ts", dates.date2num(F.col("ts")).alias("num"), dates.time2num(F.col("ts")).alias("part"))
    back = F.unix_micros(dates.num2date(F.col("num"))) - F.unix_micros("ts")
    return e.select("event_id", (F.col("num") * 100_000).cast("bigint").alias("num"), (F.abs(back) < 100).alias("same"), F.round("part", 8).alias("part"), dates.num2time(F.col("part")).alias("time"))


def _zones(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", "ts")
    here = dates.localize(F.col("ts"), "America/New_York")
    return e.select("event_id", here.alias("here"), dates.to_utc(here, "America/New_York").alias("back"))


HOLIDAYS, EARLY = ("2024-01-01", "2024-01-15"), {"2024-01-05": "13:00:00", "2024-01-19": "12:15:00"}


def _calendar(s: SparkSession, d: str) -> DataFrame:
    """The trading days of the events' time, with the events of each."""
    e = table(s, d, "events")
    days_ = dates.calendar_of(e, holidays=HOLIDAYS, early=EARLY)
    n = e.groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("events"))
    return days_.join(n, "date", "left").withColumns({"events": F.coalesce("events", F.lit(0)), **{c: F.col(c).cast("timestamp") for c in ("date", "next_day")}})


def _sessions(**options) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        e = table(s, d, "events")
        b = resample.session_bars(e, dates.calendar_of(e, holidays=HOLIDAYS, early=EARLY), "event_type", "ts", "value", ties=("event_id",), **options)
        return b.select("symbol", "ts", F.col("session").cast("timestamp").alias("session"), "closes", *[F.round(c, 4).alias(c) for c in BAR])

    return run


def queries() -> dict[str, Query]:
    return {
        "proj_logic": _on(lambda b: _two(b).put(each_=lines.and_(F.col("a"), F.col("c")), either=lines.or_(F.col("a"), F.col("c")), every_=lines.all_(F.col("a"), F.col("c")), some_=lines.any_(F.col("a"), F.col("c")), no=lines.not_(F.col("a"))), "each_", "either", "every_", "some_", "no"),
        "proj_unary": _on(lambda b: b.put(neg=-(F.col("close") - F.col("open")), size=F.abs(F.col("close") - F.col("open")), square=F.pow(F.col("close") - F.col("open"), F.lit(2.0))), "neg", "size", "square"),
        "proj_compare": _on(lambda b: b.put(p=b.lag("close")).put(lt=lines.lt(F.col("close"), F.col("p")), le=lines.le(F.col("close"), F.col("p")), gt=lines.gt(F.col("close"), F.col("p")), ge=lines.ge(F.col("close"), F.col("p")), eq=lines.eq(F.col("close"), F.col("p")), ne=lines.ne(F.col("close"), F.col("p"))), "lt", "le", "gt", "ge", "eq", "ne"),
        "proj_div_by_zero": _on(lambda b: _zeros(b).put(one=lines.div_by_zero(F.col("x"), F.col("y"), -1.0), two=lines.div_zero_by_zero(F.col("x"), F.col("y"), 99.0, -1.0)), "one", "two"),
        "proj_cmp_ex": _on(lambda b: b.put(pick=lines.cmp_ex(F.col("close"), F.col("open"), F.col("low"), F.col("volume"), F.col("high"))), "pick"),
        "proj_reduce": _on(lambda b: b.put(total=lines.reduce(lambda x, y: x * 2 + y, F.col("open"), F.col("high"), F.col("low")), top=lines.max_(F.col("open"), F.col("close")), bottom=lines.min_(F.col("open"), F.col("close"))), "total", "top", "bottom"),
        "dat_numbers": _numbers,
        "dat_zones": _zones,
        "dat_calendar": _calendar,
        "agg_resample_session": _sessions(seconds=5400, take_late=1800),
        "agg_resample_session_whole": _sessions(edge="last"),
        "flt_session_fill": lambda s, d: filters.session_fill(hours(s, d), 3600, "09:00:00", "16:00:00").select("symbol", "ts", *[F.round(c, 4).alias(c) for c in BAR], "filled"),
        "flt_fill_median": lambda s, d: filters.fill(days(s, d).where("dayofmonth(ts) > 3"), 86400, "median", 1.0).select("symbol", "ts", *[F.round(c, 4).alias(c) for c in BAR], "filled"),
        "flt_repair": lambda s, d: filters.repair(_holes(days(s, d))).select("symbol", "ts", *[F.round(c, 4).alias(c) for c in BAR], "repaired"),
        "agg_resample_offset": lambda s, d: rounded(resample.resample(hours(s, d), "day", offset=6 * 3600), *BAR),
        "sig_kinds": _on(lambda b: b.put(**{k.lower(): signals.direction(k, F.col("close") - F.col("open")) for k in signals.KINDS}), *[k.lower() for k in signals.KINDS]),
        "sig_crossing": _on(lambda b: signals.crossing(signals.crossing(b.put(f=b.mean("close", 5), s=b.mean("close", 10)), "f", "s"), "f", "s", False, "fall"), "signal", "fall"),
        "sig_delayed": _on(lambda b: signals.delayed(b.put(up=signals.simple(F.col("close") > F.col("open"))), "up", 2), "signal"),
        "sig_filtered": _on(lambda b: b.put(signal=signals.filtered(lines.gt(F.col("close"), F.col("open")), F.col("volume") > 100)), "signal"),
        "sig_ha_delta": _on(folds.ha_delta, "hadelta", "hadelta_smoothed"),
        "sig_pivots_open": _on(lambda b: win.pivots(win.pivots(b, use_open=True, out="o"), "fibonacci", use_close=True, out="c"), "o_p", "o_s1", "o_r2", "c_p", "c_s1", "c_r3"),
        "win_find_where": _on(lambda b: win.find_where(win.find_where(b, lambda v, now: v > now + 10, out="newest"), lambda v, now: v > now + 10, newest=False, out="oldest"), "newest", "oldest"),
        "ind_by_name": _on(lambda b: indicator("WilliamsR")(indicator("BollingerBands")(indicator("MovingAverage")(b, 10))), "sma", "bb_mid", "bb_top", "williamsr"),
        "ind_custom": _on(lambda b: folds.fold(b, [(RisingRun, ["close"], ["run"])]), "run"),
        "an_custom": lambda s, d: ulcer(days(s, d).select("symbol", "ts", F.col("close").alias("value"))).select("symbol", F.round("ulcer", 4).alias("ulcer")),
    }


def _two_sql() -> Sql:
    return Sql().put(a="close > open", c="close > 50")


def _ha_sql() -> str:
    s = Sql().put(_c="(open + high + low + close) / 4", _k=f"row_number() {ORDER}")
    s.put(_x=f"CASE WHEN _k = 1 THEN (open + close) / 2 ELSE {lag('_c')} END").ema("_x", 1, "_o", 0.5)
    return s.put(hadelta="_c - _o").put(hadelta_smoothed=mean("hadelta", 3)).select("hadelta", "hadelta_smoothed")


def _kinds_sql() -> str:
    v, cells = "(close - open)", {}
    for k in signals.KINDS:
        base, x = k.removesuffix("_INV").removesuffix("_ANY"), f"(-{v})" if k.endswith("_INV") else v
        up, down = f"CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END", f"CASE WHEN {x} < 0 THEN -1.0 ELSE 0.0 END"
        if k.endswith("_ANY"):
            up, down = f"CASE WHEN {x} <> 0 THEN 1.0 ELSE 0.0 END", f"CASE WHEN {x} <> 0 THEN -1.0 ELSE 0.0 END"
        cells[k.lower()] = {"LONGSHORT": f"{up} + {down}", "LONG": up, "SHORT": down, "LONGEXIT": down, "SHORTEXIT": up, "NONE": "0.0"}[base]
    return Sql().put(**{f'"{k}"': e for k, e in cells.items()}).select(*[f'"{k}"' for k in cells])


CALENDAR = "WITH d AS (SELECT CAST(g AS DATE) AS date, CAST(g AS TIMESTAMP) + INTERVAL 570 MINUTES AS opens, CAST(g AS TIMESTAMP) + CASE CAST(g AS DATE) WHEN DATE '2024-01-05' THEN INTERVAL 780 MINUTES WHEN DATE '2024-01-19' THEN INTERVAL 735 MINUTES ELSE INTERVAL 960 MINUTES END AS closes FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS g FROM events) WHERE isodow(g) <= 5 AND CAST(g AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-01-15'))"


def _session_sql(width: str, late: int, when: str) -> str:
    us = lambda x: f"(epoch_us(TIMESTAMP '2000-01-01' + ({x})) - epoch_us(TIMESTAMP '2000-01-01'))"
    e = f"e AS (SELECT event_type AS symbol, events.ts AS came, event_id, value, date, opens, closes, {us(width)} AS w, epoch_us(closes) - epoch_us(opens) AS len, epoch_us(events.ts) - epoch_us(opens) AS x FROM events JOIN d ON CAST(events.ts AS DATE) = date WHERE value IS NOT NULL AND events.ts >= opens AND events.ts <= closes + to_seconds({late}))"
    s = "s AS (SELECT *, least(x // w, (len + w - 1) // w - 1) AS k FROM e), t AS (SELECT *, least(opens + to_microseconds((k + 1) * w), closes) AS right_ FROM s)"
    return f"{CALENDAR}, {e}, {s} SELECT symbol, {when} AS ts, CAST(date AS TIMESTAMP) AS session, right_ = closes AS closes, round(first(value ORDER BY came, event_id), 4) AS open, round(max(value), 4) AS high, round(min(value), 4) AS low, round(last(value ORDER BY came, event_id), 4) AS close, CAST(count(*) AS DOUBLE) AS volume FROM t s GROUP BY symbol, date, right_, closes"


def oracle_sql() -> dict[str, str]:
    flag = lambda x: f"CASE WHEN {x} THEN 1.0 ELSE 0.0 END"
    zero = "WITH " + DAYS + ", z AS (SELECT *, CASE WHEN day(ts) = 1 THEN 0 ELSE open END AS x, CASE WHEN day(ts) <= 2 THEN 0 ELSE close END AS y FROM bars)"
    crossing = Sql().put(_f=mean("close", 5), _s=mean("close", 10)).put(_z="CASE WHEN _f < _s THEN 1 WHEN _f > _s THEN -1 END")
    crossing.put(_was="last_value(_z IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").put(signal=flag("_was = 1 AND _z = -1"), fall=flag("_was = -1 AND _z = 1"))
    find = lambda f: f"CASE WHEN _a IS NOT NULL THEN 14 - {f}(list_filter(range(1, 15), lambda i: _a[i] > close + 10)) END"
    named = Sql().put(sma=mean("close", 10), bb_mid=mean("close", 20), _d=agg("stddev_pop", "close", 20), _h=agg("max", "high", 14), _l=agg("min", "low", 14)).put(bb_top="bb_mid + 2 * _d", williamsr=ratio("100 * (close - _h)", "_h - _l"))
    return {
        "proj_logic": _two_sql().put(each_=flag("a AND c"), either=flag("a OR c"), every_=flag("a AND c"), some_=flag("a OR c"), no=flag("NOT a")).select("each_", "either", "every_", "some_", "no"),
        "proj_unary": Sql().put(neg="open - close", size="abs(close - open)", square="pow(close - open, 2)").select("neg", "size", "square"),
        "proj_compare": Sql().put(_p=lag("close")).put(lt=flag("close < _p"), le=flag("close <= _p"), gt=flag("close > _p"), ge=flag("close >= _p"), eq=flag("close = _p"), ne=flag("_p IS NULL OR close <> _p")).select("lt", "le", "gt", "ge", "eq", "ne"),
        "proj_div_by_zero": zero + " SELECT symbol, ts, round(CASE WHEN y <> 0 THEN x / y ELSE -1 END, 4) + 0.0 AS one, round(CASE WHEN y <> 0 THEN x / y WHEN x = 0 THEN -1 ELSE 99 END, 4) + 0.0 AS two FROM z",
        "proj_cmp_ex": Sql().put(pick="CASE WHEN close < open THEN low WHEN close = open THEN volume ELSE high END").select("pick"),
        "proj_reduce": Sql().put(total="(open * 2 + high) * 2 + low", top="greatest(open, close)", bottom="least(open, close)").select("total", "top", "bottom"),
        "dat_numbers": "WITH e AS (SELECT event_id, ts, epoch_us(ts) / 86400000000.0 AS num, (hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) / 86400.0 AS part FROM events) SELECT event_id, CAST(floor(num * 100000) AS BIGINT) AS num, true AS same, round(part, 8) AS part, strftime(ts, '%H:%M:%S') AS time FROM e",
        "dat_zones": "SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS here, CAST(ts AS TIMESTAMP) AS back FROM events",
        "dat_calendar": f"{CALENDAR}, n AS (SELECT *, lead(date) OVER (ORDER BY date) AS next_day FROM d), c AS (SELECT CAST(ts AS DATE) AS date, count(*) AS events FROM events GROUP BY 1) SELECT CAST(date AS TIMESTAMP) AS date, opens, closes, CAST(next_day AS TIMESTAMP) AS next_day, coalesce(date_trunc('week', date) <> date_trunc('week', next_day), true) AS last_of_week, coalesce(date_trunc('month', date) <> date_trunc('month', next_day), true) AS last_of_month, coalesce(year(date) <> year(next_day), true) AS last_of_year, coalesce(events, 0) AS events FROM n LEFT JOIN c USING (date)",
        "agg_resample_session": _session_sql("INTERVAL 90 MINUTES", 1800, "s.right_"),
        "agg_resample_session_whole": _session_sql("closes - opens", 0, "max(came)"),
        "flt_session_fill": f"WITH {HOURS}, g AS (SELECT DISTINCT symbol, CAST(ts AS DATE) AS d FROM bars), grid AS (SELECT symbol, CAST(d AS TIMESTAMP) + to_hours(h) AS ts FROM g, range(9, 17) t(h)), f AS (SELECT symbol, ts, open, high, low, close, volume FROM grid FULL JOIN bars USING (symbol, ts)), c AS (SELECT *, last_value(close IGNORE NULLS) {SO_FAR} AS c FROM f) SELECT symbol, ts, {', '.join(f'round(coalesce({x}, c), 4) AS {x}' for x in BAR[:4])}, round(coalesce(volume, 0), 4) AS volume, close IS NULL AS filled FROM c WHERE c IS NOT NULL",
        "flt_fill_median": f"WITH {DAYS}, b AS (SELECT *, {lag('ts', -1)} AS nxt, (open + high + low + close - greatest(open, high, low, close) - least(open, high, low, close)) / 2 AS m FROM bars WHERE day(ts) > 3), n AS (SELECT *, CASE WHEN nxt - ts > INTERVAL 36 HOURS THEN date_diff('day', ts, nxt) - 1 ELSE 0 END AS n FROM b), e AS (SELECT *, unnest(range(0, n + 1)) AS i FROM n) SELECT symbol, ts + to_days(CAST(i AS INTEGER)) AS ts, {', '.join(f'round(CASE WHEN i > 0 THEN m ELSE {c} END, 4) AS {c}' for c in BAR[:4])}, round(CASE WHEN i > 0 THEN 1 ELSE volume END, 4) AS volume, i > 0 AS filled FROM e",
        "flt_repair": f"WITH {DAYS}, h AS (SELECT * REPLACE (CASE WHEN day(ts) % 7 = 3 THEN NULL ELSE close END AS close, CASE WHEN day(ts) % 5 = 2 THEN NULL ELSE open END AS open) FROM bars), k AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM h) SELECT symbol, ts, round(coalesce(open, known), 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(coalesce(close, known, 0), 4) AS close, round(volume, 4) AS volume, open IS NULL OR close IS NULL AS repaired FROM k",
        "agg_resample_offset": f"WITH {HOURS}, p AS (SELECT *, date_trunc('day', ts - INTERVAL 6 HOURS) + INTERVAL 6 HOURS AS p FROM bars) SELECT symbol, CAST(p AS TIMESTAMP) AS ts, round(arg_min(open, ts), 4) AS open, round(max(high), 4) AS high, round(min(low), 4) AS low, round(arg_max(close, ts), 4) AS close, round(sum(volume), 4) AS volume FROM p GROUP BY symbol, p",
        "sig_kinds": _kinds_sql(),
        "sig_crossing": crossing.select("signal", "fall"),
        "sig_delayed": Sql().put(_up=flag("close > open")).put(signal=f"coalesce({lag('_up', 2)}, 0)").select("signal"),
        "sig_filtered": Sql().put(signal=flag("close > open AND volume > 100")).select("signal"),
        "sig_ha_delta": _ha_sql(),
        "sig_pivots_open": Sql().put(o_p="(high + low + close + open) / 4", c_p="(high + low + 2 * close) / 4").put(o_s1="2 * o_p - high", o_r2="o_p + (high - low)", c_s1="c_p - 0.382 * (high - low)", c_r3="c_p + (high - low)").select("o_p", "o_s1", "o_r2", "c_p", "c_s1", "c_r3"),
        "win_find_where": Sql().put(_a=values("close", 14)).put(newest=find("list_max"), oldest=find("list_min")).select("newest", "oldest"),
        "ind_by_name": named.select("sma", "bb_mid", "bb_top", "williamsr"),
        "ind_custom": Sql().put(_c=lag("close")).scan({"run": "0"}, {"run": "CASE WHEN b.close > b._c THEN r.run + 1 ELSE 0 END"}).select("run"),
        "an_custom": f"WITH {DAYS}, p AS (SELECT symbol, close, max(close) {SO_FAR} AS peak FROM bars) SELECT symbol, round(sqrt(avg(pow(100 * (peak - close) / peak, 2))), 4) AS ulcer FROM p GROUP BY symbol",
    }
