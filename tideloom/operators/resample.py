"""Bars from ticks and from smaller bars, and feeds put together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNITS = ("second", "minute", "hour", "day", "week", "month", "year")
#: Bars in a period where periods go by bar number.
ORDINAL = {"week": 5, "month": 21, "year": 252}


def bucket(ts: Column, unit: str, n: int = 1, sunday: bool = False) -> Column:
    """Start of the period of ``n`` units that ``ts`` is in. Weeks begin on
    Monday, or on Sunday."""
    ts = ts.cast("timestamp")
    if unit in ("month", "year"):
        months = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
        size = n * (12 if unit == "year" else 1)
        return F.add_months(F.lit("1970-01-01").cast("date"), (F.floor(months / size) * size).cast("int")).cast("timestamp")
    if unit == "week":
        back = 4 if sunday else 3  # 1970-01-01 was a Thursday
        day = F.floor((F.unix_date(ts.cast("date")) + back) / (7 * n)) * (7 * n) - back
        return F.date_from_unix_date(day.cast("int")).cast("timestamp")
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit] * n
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / 1_000_000 / seconds).cast("bigint") * seconds)


def _bars(df: DataFrame, keys: list[Column], order: list[str], price: str | None, volume: str | None) -> DataFrame:
    at = F.struct(*order)
    o, h, lo, c = ([price] * 4) if price else ("open", "high", "low", "close")
    vol = F.sum(volume) if volume else F.count("*").cast("double")
    oi = F.max_by("openinterest", at) if not price and "openinterest" in df.columns else F.lit(0.0)
    return df.groupBy(*keys).agg(
        F.min_by(o, at).alias("open"), F.max(h).alias("high"), F.min(lo).alias("low"), F.max_by(c, at).alias("close"),
        vol.alias("volume"), oi.alias("openinterest"),
    )


def from_ticks(df: DataFrame, symbol: str, ts: str, price: str, unit: str, n: int = 1, volume: str | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Ticks to bars: first, highest, lowest and last price, summed volume (or
    the number of ticks). ``ties`` order ticks of one time. One partial
    aggregation before the shuffle, so a busy symbol isn't gathered anywhere."""
    keys = [F.col(symbol).alias("symbol"), bucket(F.col(ts), unit, n).alias("ts")]
    return _bars(df.where(F.col(price).isNotNull()), keys, [ts, *ties], price, volume)


def resample(bars: DataFrame, unit: str, n: int = 1, right_edge: bool = False, sunday: bool = False, offset: int = 0) -> DataFrame:
    """Bars to larger bars by calendar; the bar's time is the start of its
    period, or with ``right_edge`` that of its last bar. Periods begin
    ``offset`` seconds later than those of the calendar."""
    shifted = F.timestamp_micros(F.unix_micros("ts") - offset * 1_000_000)
    b = bars.withColumn("_p", F.timestamp_micros(F.unix_micros(bucket(shifted, unit, n, sunday)) + offset * 1_000_000) if offset else bucket(F.col("ts"), unit, n, sunday))
    out = b.groupBy("symbol", "_p").agg(F.max("ts").alias("_last"), *_parts())
    return out.select("symbol", F.col("_last" if right_edge else "_p").alias("ts"), "open", "high", "low", "close", "volume", "openinterest")


def session_bars(ticks: DataFrame, calendar: DataFrame, symbol: str, ts: str, price: str, seconds: int | None = None, volume: str | None = None, ties: Sequence[str] = (), take_late: int = 0, edge: str = "right") -> DataFrame:
    """Ticks to bars that keep to the sessions of a calendar (date, opens, closes):
    a session is cut into bars of ``seconds`` from its opening, or is one bar; the last bar ends with the session, early
    closes included. Ticks outside sessions belong nowhere, but those up to ``take_late`` seconds
    after the close belong to the last bar, and one at the closing time is of the last bar.

    A bar's time is the ``right`` edge of its slot, the ``left`` one, or that of its ``last`` tick;
    ``session`` is its day and ``closes`` says whether the session ends with it. Ticks meet their session by
    day, an equality join, not by a range of times; sessions don't cross midnight."""
    at = F.col(ts)
    days = calendar.select(F.col("date").alias("session"), F.unix_micros("opens").alias("_opens"), F.unix_micros("closes").alias("_closes"))
    t = ticks.where(F.col(price).isNotNull()).withColumns({"session": F.to_date(at), "_at": F.unix_micros(at)}).join(days, "session")
    t = t.where((F.col("_at") >= F.col("_opens")) & (F.col("_at") <= F.col("_closes") + take_late * 1_000_000))
    width = F.lit(seconds * 1_000_000) if seconds else F.col("_closes") - F.col("_opens")
    last = F.ceil((F.col("_closes") - F.col("_opens")) / width) - 1
    t = t.withColumn("_slot", F.least(F.floor((F.col("_at") - F.col("_opens")) / width), last))
    t = t.withColumns({"_from": F.col("_opens") + F.col("_slot") * width, "_to": F.least(F.col("_opens") + (F.col("_slot") + 1) * width, F.col("_closes"))})
    keys = [F.col(symbol).alias("symbol"), F.col("session"), F.timestamp_micros("_from").alias("_left"), F.timestamp_micros("_to").alias("_right"), (F.col("_to") == F.col("_closes")).alias("closes")]
    order = F.struct(ts, *ties)
    out = t.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        (F.sum(volume) if volume else F.count("*").cast("double")).alias("volume"), F.max(ts).alias("_last"),
    )
    when = {"right": "_right", "left": "_left", "last": "_last"}[edge]
    return out.select("symbol", F.col(when).alias("ts"), "session", "closes", "open", "high", "low", "close", "volume")


def _parts() -> list[Column]:
    return [F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.max_by("openinterest", "ts").alias("openinterest")]


def resample_ordinal(bars: DataFrame, unit: str, n: int = 1) -> DataFrame:
    """Larger bars of 5, 21 or 252 bars whatever the calendar; the last may be
    partial. A bar's time is its last bar's."""
    size = ORDINAL.get(unit, 1) * n
    b = bars.withColumn("_p", F.floor((F.row_number().over(W.partitionBy("symbol").orderBy("ts")) - 1) / size))
    out = b.groupBy("symbol", "_p").agg(F.max("ts").alias("_last"), *_parts())
    return out.select("symbol", F.col("_last").alias("ts"), "open", "high", "low", "close", "volume", "openinterest")


def replay(bars: DataFrame, unit: str, n: int = 1) -> DataFrame:
    """The larger bar as it grows with each smaller one; ``complete`` marks the
    last of each period."""
    b = bars.withColumn("period", bucket(F.col("ts"), unit, n))
    w = W.partitionBy("symbol", "period").orderBy("ts")
    far = w.rowsBetween(W.unboundedPreceding, 0)
    return b.select(
        "symbol", "ts", "period", F.first("open").over(far).alias("open"), F.max("high").over(far).alias("high"), F.min("low").over(far).alias("low"),
        "close", F.sum("volume").over(far).alias("volume"), F.lead("ts").over(w).isNull().alias("complete"),
    )


def asof(fast: DataFrame, slow: DataFrame, columns: Sequence[str], prefix: str = "slow_") -> DataFrame:
    """Each row of ``fast`` with the latest values of ``slow`` at or before its
    time, by symbol. A union and one window instead of a range join."""
    cells = F.struct(*[F.col(c) for c in columns])
    left = fast.withColumn("_v", F.lit(None).cast(slow.select(cells.alias("s")).schema["s"].dataType)).withColumn("_side", F.lit(1))
    right = slow.select("symbol", "ts", cells.alias("_v"), F.lit(0).alias("_side"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = W.partitionBy("symbol").orderBy("ts", "_side").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_held", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*fast.columns, *[F.col(f"_held.{c}").alias(f"{prefix}{c}") for c in columns])


def align(a: DataFrame, b: DataFrame, columns: Sequence[str], suffix: str = "2", by_number: bool = False, pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Two feeds side by side, symbol by symbol: rows of the same time, or of the
    same number. ``pairs`` names the symbol of ``b`` that goes beside each of
    ``a`` (several, if it is named several times), as ``symbol`` with the suffix."""
    key = "ts"
    if by_number:
        n = F.row_number().over(W.partitionBy("symbol").orderBy("ts"))
        a, b, key = a.withColumn("_n", n), b.withColumn("_n", n), "_n"
    other = b.select("symbol", key, *[F.col(c).alias(f"{c}{suffix}") for c in columns])
    if pairs:
        beside = F.create_map(*[x for right in dict.fromkeys(r for _, r in pairs) for x in (F.lit(right), F.array(*[F.lit(left) for left, r in pairs if r == right]))])
        other = other.withColumnRenamed("symbol", f"symbol{suffix}").withColumn("symbol", F.explode(beside[F.col(f"symbol{suffix}")]))
    return a.join(other, ["symbol", key]).drop("_n")


def chain(feeds: Sequence[DataFrame], strict: bool = True) -> DataFrame:
    """Feeds one after another as ``feed`` 0, 1, ...; a strict chain drops rows
    not later than what earlier feeds have already given."""
    both = feeds[0].withColumn("feed", F.lit(0))
    for i, f in enumerate(feeds[1:], 1):
        both = both.unionByName(f.withColumn("feed", F.lit(i)))
    if not strict:
        return both
    ends = both.groupBy("symbol", "feed").agg(F.max("ts").alias("_end"))
    w = W.partitionBy("symbol").orderBy("feed").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.max("_end").over(w)).drop("_end")
    return both.join(ends, ["symbol", "feed"]).where("_before is null or ts > _before").drop("_before")


def roll_over(contracts: Sequence[DataFrame], condition: Column | None = None) -> DataFrame:
    """One continuous series from contracts in order. The series moves to the
    next contract on the first day both trade on which ``condition`` over the
    columns of the current and, with suffix ``_next``, the next one holds
    (default: the next has more volume), or when the current one ends. A
    contract that has ended before its turn is passed over.

    Contracts are one frame; the days on which one may roll come from one join,
    and the rolls of a symbol from one pass over its contracts."""
    condition = condition if condition is not None else F.col("volume_next") > F.col("volume")
    both = contracts[0].withColumn("contract", F.lit(0))
    for i, c in enumerate(contracts[1:], 1):
        both = both.unionByName(c.withColumn("contract", F.lit(i)))
    fields = ("open", "high", "low", "close", "volume", "openinterest")
    nxt = both.select("symbol", "ts", (F.col("contract") - 1).alias("contract"), *[F.col(x).alias(f"{x}_next") for x in fields])
    met = both.join(nxt, ["symbol", "contract", "ts"]).where(condition).groupBy("symbol", "contract").agg(F.array_sort(F.collect_set("ts")).alias("met"))
    ends = both.groupBy("symbol", "contract").agg(F.max("ts").alias("end")).join(met, ["symbol", "contract"], "left")
    turns = ends.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("contract", "end", "met"))).alias("all"))
    start = "timestamp'0001-01-01 00:00:00'"
    rolls = F.expr(f"""aggregate(all, named_struct('since', {start}, 'out', cast(array() as array<struct<contract:int,since:timestamp,until:timestamp>>)), (s, c) ->
        transform(array(coalesce(filter(c.met, t -> t >= s.since)[0], greatest(c.end + interval 1 microsecond, s.since))), u ->
            named_struct('since', u, 'out', concat(s.out, array(named_struct('contract', c.contract, 'since', s.since, 'until', u)))))[0]).out""")
    spans = turns.select("symbol", F.explode(rolls).alias("r")).select("symbol", "r.contract", "r.since", "r.until")
    last = F.col("contract") == len(contracts) - 1
    out = both.join(spans, ["symbol", "contract"]).where((F.col("ts") >= F.col("since")) & (last | (F.col("ts") < F.col("until"))))
    return out.select(*contracts[0].columns, "contract")
