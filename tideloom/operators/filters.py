"""Transforms of a bar frame that drop, add or rewrite rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import DaySteps, HeikinAshi, fold
from .frame import Bars
from .resample import asof


def keep(bars: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition holds."""
    return bars.where(condition)


def calendar_days(bars: DataFrame, weekends: bool = False, weekdays: Sequence[int] = (), months: Sequence[int] = (), days: Sequence[int] = (), holidays: DataFrame | None = None) -> DataFrame:
    """Without weekends, unlisted weekdays (Monday 1), months and days of the
    month, and without dates of ``holidays(date)``; an empty list allows all."""
    day = F.expr("weekday(ts) + 1")
    out = bars if weekends else bars.where(day <= 5)
    for allowed, x in ((weekdays, day), (months, F.month("ts")), (days, F.dayofmonth("ts"))):
        if allowed:
            out = out.where(x.isin(list(allowed)))
    if holidays is not None:
        out = out.join(holidays.select(F.col("date").alias("_day")), F.col("ts").cast("date") == F.col("_day"), "left_anti")
    return out


def day_steps(bars: DataFrame, days: float) -> DataFrame:
    """A row, then the next at least so many days later, and so on."""
    b = Bars(bars.withColumn("_s", F.unix_micros("ts") / 1e6))
    return fold(b, [(lambda: DaySteps(days), ["_s"], ["_keep"])]).df.where("_keep = 1").drop("_s", "_keep")


def split_adjust(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Prices over, volume times the ratio of the latest of
    ``splits(symbol, ts, ratio)`` at or before the bar."""
    b = asof(bars, splits, ["ratio"], "_")
    r = F.coalesce("_ratio", F.lit(1.0))
    b = b.withColumns({c: F.col(c) / r for c in ("open", "high", "low", "close")} | {"volume": F.col("volume") * r})
    return b.drop("_ratio")


def _price_of(price: str) -> Column:
    four = [F.col(c) for c in ("open", "high", "low", "close")]
    total = four[0] + four[1] + four[2] + four[3]
    if price == "median":
        return (total - F.greatest(*four) - F.least(*four)) / 2
    return total / 4 if price == "mean" else F.col(price)


def fill(bars: DataFrame, step_seconds: int, price: str = "close", volume: float = 0.0, most: float = 1.5) -> DataFrame:
    """Missing bars, where two are further apart than ``most`` steps: prices are
    the last bar's ``price`` (a column, or mean or median of its four prices), the volume is given. Each bar makes the rows of
    its own gap, so nothing is gathered."""
    w = W.partitionBy("symbol").orderBy("ts")
    nxt = F.lead("ts").over(w)
    gap = (F.unix_micros(nxt) - F.unix_micros("ts")) / 1_000_000
    n = F.when(gap > most * step_seconds, F.ceil(gap / step_seconds) - 1).otherwise(0).cast("int")
    b = bars.withColumn("_n", F.coalesce(n, F.lit(0))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    made = F.col("_i") > 0
    cells = {c: F.when(made, _price_of(price)).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}
    cells |= {"volume": F.when(made, F.lit(float(volume))).otherwise(F.col("volume")), "ts": F.timestamp_micros(F.unix_micros("ts") + F.col("_i").cast("bigint") * step_seconds * 1_000_000), "filled": made}
    return b.select(*[cells.get(c, F.col(c)).alias(c) for c in [*bars.columns, "filled"]])


def repair(bars: DataFrame, price: str = "close") -> DataFrame:
    """Prices that are missing or zero become the ``price`` (as of ``fill``) of
    the last bar that has it, with ``repaired`` where a bar had any; bars before
    the first such bar stay as they are."""
    four = ("open", "high", "low", "close")
    b = bars.withColumns({f"_{c}": F.col(c) for c in four}).withColumns({c: F.when((F.col(c) != 0) & ~F.isnan(c), F.col(c)) for c in four})
    known = F.last(_price_of(price), ignorenulls=True).over(W.partitionBy("symbol").orderBy("ts").rowsBetween(W.unboundedPreceding, -1))
    b = b.withColumn("_known", known)
    had = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    cells = {c: F.coalesce(F.col(c), F.col("_known"), F.col(f"_{c}")) for c in four}
    return b.select(*[cells.get(c, F.col(c)).alias(c) for c in bars.columns], had.alias("repaired"))


def session_fill(bars: DataFrame, step_seconds: int, opens: str = "09:30:00", closes: str = "16:00:00") -> DataFrame:
    """Bars of each day's session that are missing, at the previous close."""
    day = F.to_date("ts")
    at = lambda t: F.to_timestamp(F.concat_ws(" ", F.col("_d").cast("string"), F.lit(t)))
    days = bars.select("symbol", day.alias("_d")).distinct()
    grid = days.select("symbol", F.explode(F.sequence(at(opens), at(closes), F.expr(f"INTERVAL {step_seconds} SECOND"))).alias("ts"))
    b = bars.withColumn("_there", F.lit(True))
    full = grid.join(b, ["symbol", "ts"], "full")
    w = W.partitionBy("symbol").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    full = full.withColumn("_c", F.last("close", ignorenulls=True).over(w)).withColumn("filled", F.col("_there").isNull()).where("_c is not null")
    full = full.withColumns({c: F.coalesce(c, "_c") for c in ("open", "high", "low", "close")} | {"volume": F.coalesce("volume", F.lit(0.0))})
    return full.select(*bars.columns, "filled")


def heikin_ashi(bars: DataFrame) -> DataFrame:
    """Prices replaced by Heikin-Ashi prices."""
    cols = ["open", "high", "low", "close"]
    b = fold(Bars(bars), [(HeikinAshi, cols, [f"_{c}" for c in cols])]).df
    return b.select(*[F.col(f"_{c}").alias(c) if c in cols else F.col(c) for c in bars.columns])


def renko(bars: DataFrame, size: float) -> DataFrame:
    """Boxes of ``size`` from the last level, none or several a bar, with their
    number within it. The first close is the first level."""
    schema = "symbol string, ts timestamp, box int, open double, high double, low double, close double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, level = None, None
        for b in batches:
            rows: list[tuple] = []
            for symbol, ts, close in zip(*(b.column(c).to_pylist() for c in ("symbol", "ts", "close")), strict=True):
                if close is None:
                    continue
                if symbol != current:
                    current, level = symbol, close
                    continue
                box = 0
                while abs(close - level) >= size:
                    to = level + size if close > level else level - size
                    rows.append((symbol, ts, box, level, max(level, to), min(level, to), to))
                    level, box = to, box + 1
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.string(), b.schema.field("ts").type, pa.int32(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["symbol", "ts", "box", "open", "high", "low", "close"])

    return bars.select("symbol", "ts", "close").repartition("symbol").sortWithinPartitions("symbol", "ts").mapInArrow(run, schema)
