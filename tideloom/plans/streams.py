"""Queries of streams and their SQL. The tables arrive in parts, out of order;
each part is a run from the checkpoint of the one before."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, rolling
from ..sources.scratch import scratch
from ..streaming import bars as streams
from ..streaming import replay, state
from .bars import Query, days, hours, rounded, ticks
from .sources import HOURS
from .sql import Sql, agg, mean
from .strategies import RULES, Doubling, _doubling
from .trading import _r, near

BAR = ("open", "high", "low", "close", "volume")
END = "~end"


def streamed(parts: list[dict[str, DataFrame]], change: Callable[..., DataFrame]) -> DataFrame:
    """What a stream gives whose inputs get ``parts`` one after another; between
    them it is stopped, and goes on from its checkpoint."""
    first = next(iter(parts[0].values()))
    spark = first.sparkSession
    at = scratch(spark)
    schemas = {name: df.schema for p in parts for name, df in p.items()}
    for p in parts:
        for name, df in p.items():
            df.write.mode("append").parquet(f"{at}/in/{name}")
        sources = {name: spark.readStream.schema(s).parquet(f"{at}/in/{name}") for name, s in schemas.items()}
        run = change(**sources).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{at}/state").format("parquet").start(f"{at}/out")
        run.awaitTermination()
    return spark.read.parquet(f"{at}/out")


def ends(df: DataFrame, *after: int) -> list[DataFrame]:
    """For each number of days a row of a far later time, by which all before is complete."""
    last = df.agg(F.max("ts")).first()[0]
    row = lambda k: [F.lit(END).alias(c) if c == "symbol" else (F.lit(last) + F.expr(f"INTERVAL {k} DAYS")).alias(c) if c == "ts" else F.lit(0).cast(t).alias(c) for c, t in df.dtypes]
    return [df.limit(1).select(*row(k)) for k in after]


def shuffled(df: DataFrame) -> list[DataFrame]:
    """Odd days of the first years, then the even ones and the rest, and the end."""
    early, odd = F.year("ts") <= 1996, F.dayofyear("ts") % 2 == 1
    return [df.where(early & odd), df.where(~early | ~odd), *ends(df, 4000)]


def bars_of(change: Callable[[DataFrame], DataFrame]) -> Query:
    """A query of daily bars that come out of order."""
    return lambda s, d: streamed([{"bars": b} for b in shuffled(days(s, d))], lambda bars: change(bars)).where(F.col("symbol") != END)


LATE = "2500 days"


class Crossing(Doubling):
    """The reactive strategy, which makes its own indicator of the bars it is given."""

    def start(self) -> None:
        super().start()
        self.mean, self.side = rolling.Mean(15), None

    def next(self, bar) -> None:
        m = float(self.mean.push(np.array([bar.close]))[0])
        cross, gap = 0.0, bar.close - m
        if m == m:
            cross = (gap > 0) - (gap < 0) if self.side is not None and self.side * gap < 0 else 0.0
            self.side = gap or self.side or 0.0
        super().next(_Crossed(bar.close, cross))


class _Crossed:
    def __init__(self, close: float, cross: float):
        self.close, self.cross = close, cross


def _late(s: SparkSession, d: str) -> DataFrame:
    """All ticks; then copies of them, which come days too late; then the end."""
    t = ticks(s, d)
    one, two = ends(t, 20, 40)
    late = t.where(F.col("ts") < F.lit(t.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 2 DAYS")).withColumn("price", F.col("price") * 10)
    out = streamed([{"ticks": x} for x in (t, one, late, two)], lambda ticks: streams.tumbling(ticks, "6 hours", "1 hour", tie="event_id"))
    return rounded(out.where(F.col("symbol") != END), *BAR)


def _coupled(s: SparkSession, d: str) -> DataFrame:
    """Hourly bars with the last close of the day before; days come later than hours."""
    fast = hours(s, d).select("symbol", "ts", "close")
    slow = fast.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.max_by("close", "ts").alias("close")).select("symbol", (F.col("day") + F.expr("INTERVAL 1 DAY")).alias("ts"), "close")
    (e,), (f,) = ends(fast, 500), ends(slow, 500)
    parts = [{"fast": fast, "slow": slow.limit(0)}, {"fast": e, "slow": slow}, {"fast": e, "slow": f}]
    out = streamed(parts, lambda fast, slow: state.coupled(fast, slow, late="400 days"))
    return near(out.where(F.col("symbol") != END).select("symbol", "ts", "close", "slow_ts", "slow_close"))


WHEN = state.day_times(17 * 3_600_000_000, range(1, 6))


def _timers(s: SparkSession, d: str) -> DataFrame:
    """At five in the afternoon from Monday to Friday: the last tick and how many came."""
    t = ticks(s, d)
    even = F.pmod(F.col("event_id"), F.lit(2)) == 0
    parts = [t.where(even), t.where(~even), *ends(t, 500)]
    out = streamed([{"ticks": x} for x in parts], lambda ticks: state.timed(ticks, WHEN, order=("event_id",), late="400 days"))
    return near(out.where(F.col("symbol") != END))


def _replay(s: SparkSession, d: str) -> DataFrame:
    """Ticks in three parts of time; bars as they are after the last, complete ones and others."""
    t = ticks(s, d)
    at = scratch(s)
    for lo, hi in ((0, 10), (10, 20), (20, 31)):
        t.where((F.dayofmonth("ts") > lo) & (F.dayofmonth("ts") <= hi)).write.mode("append").parquet(f"{at}/in")
        source = s.readStream.schema(t.schema).parquet(f"{at}/in")
        replay.replay(replay.growing(source, "6 hours", "2 days", "event_id"), f"{at}/bars", f"{at}/state").awaitTermination()
    out = replay.table(s, f"{at}/bars", "2 days")
    return out.select("symbol", "ts", *[F.round(c, 4).alias(c) for c in BAR], "complete")


def queries() -> dict[str, Query]:
    windows = [(lambda: rolling.Mean(15), ["close"], ["sma"]), (lambda: rolling.Extreme(10), ["high"], ["highest"]), (lambda: rolling.Extreme(10, False), ["low"], ["lowest"])]
    averages = [(lambda: folds.Ema(30), ["close"], ["ema"])]
    return {
        "str_late": _late,
        "str_stateful": lambda s, d: rounded(bars_of(lambda b: state.folded(b, averages, late=LATE))(s, d), "close", "ema"),
        "str_sliding": lambda s, d: rounded(bars_of(lambda b: state.folded(b, windows, ("close", "high", "low"), late=LATE))(s, d), "close", "sma", "highest", "lowest"),
        "str_strategy": lambda s, d: near(bars_of(lambda b: state.traded(b, Crossing, RULES, late=LATE))(s, d).select("symbol", "ts", "cash", "value", "position")),
        "str_coupled": _coupled,
        "str_event_timers": _timers,
        "str_replay": _replay,
    }


def oracle_sql() -> dict[str, str]:
    d = _doubling(8.0)
    return {
        "str_late": "SELECT event_type AS symbol, time_bucket(INTERVAL '6 hours', events.ts) AS ts, round(first(value ORDER BY events.ts, event_id), 4) AS open, round(max(value), 4) AS high, round(min(value), 4) AS low, round(last(value ORDER BY events.ts, event_id), 4) AS close, round(CAST(count(*) AS DOUBLE), 4) AS volume FROM events WHERE value IS NOT NULL GROUP BY event_type, time_bucket(INTERVAL '6 hours', events.ts)",
        "str_replay": "WITH b AS (SELECT event_type AS symbol, time_bucket(INTERVAL '6 hours', events.ts) AS ts, round(first(value ORDER BY events.ts, event_id), 4) AS open, round(max(value), 4) AS high, round(min(value), 4) AS low, round(last(value ORDER BY events.ts, event_id), 4) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE value IS NOT NULL GROUP BY event_type, time_bucket(INTERVAL '6 hours', events.ts)), m AS (SELECT max(ts) AS seen FROM events WHERE value IS NOT NULL) SELECT b.*, b.ts + INTERVAL 6 HOURS <= seen - INTERVAL 2 DAYS AS complete FROM b, m",
        "str_stateful": Sql().ema("close", 30, "ema").select("close", "ema"),
        "str_sliding": Sql().put(sma=mean("close", 15), highest=agg("max", "high", 10), lowest=agg("min", "low", 10)).select("close", "sma", "highest", "lowest"),
        "str_strategy": f"{d.text} SELECT symbol, ts, {_r(cash='cash', value='value', position='position')} FROM {d.table}",
        "str_coupled": f"WITH {HOURS}, slow AS (SELECT symbol, date_trunc('day', ts) + INTERVAL 1 DAY AS ts, arg_max(close, ts) AS close FROM bars GROUP BY symbol, date_trunc('day', ts)) SELECT f.symbol, f.ts, round(f.close, 4) + 0.0 AS close, s.ts AS slow_ts, round(s.close, 4) + 0.0 AS slow_close FROM bars f ASOF LEFT JOIN slow s ON f.symbol = s.symbol AND f.ts >= s.ts",
        "str_event_timers": "WITH e AS (SELECT event_type AS symbol, events.ts AS came, event_id, value, date_trunc('day', events.ts - INTERVAL 17 HOURS - INTERVAL 1 MICROSECOND) + INTERVAL 41 HOURS AS t FROM events WHERE value IS NOT NULL), w AS (SELECT *, t + CASE isodow(t) WHEN 6 THEN INTERVAL 2 DAYS WHEN 7 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAYS END AS ts FROM e) SELECT symbol, ts, max(came) AS last_ts, round(last(value ORDER BY came, event_id), 4) + 0.0 AS price, count(*) AS n FROM w GROUP BY symbol, ts",
    }
