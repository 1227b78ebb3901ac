"""Machines with state on streams.

Rows of a key are held in its state until the watermark has passed them, then
given to the key's machine in order of time, however they arrived; so a stream
gives the rows that the same machine gives over the sorted table. What a machine
remembers is stored with the key and survives a restart from the checkpoint.

State is kept by the RocksDB provider, as Spark asks for timers.
"""

from __future__ import annotations

import heapq
import pickle
from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.broker import Rules
from ..operators.strategy import BAR, Session, Strategy, as_dicts, result_schema

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a block that waits in the state.
BLOCK = 100
#: Rows that a machine is given at once.
AT_ONCE = 10_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _tuples(frame: pd.DataFrame, columns: Sequence[str]) -> list[tuple]:
    cells = [[None if v is None or v != v else v for v in frame[c].tolist()] for c in columns]
    return list(zip(*cells, strict=True))


def _place(row: tuple) -> tuple:
    """Of rows in order: by time, then by the other columns, nulls last."""
    return tuple((v is None, v if v is not None else 0) for v in row)


class _Keyed(StatefulProcessor):
    """Rows (time in microseconds first) of a key, later than all that is done."""

    def __init__(self, columns: Sequence[str], out: Sequence[str]):
        self.columns, self.out = columns, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "done long, blob binary")

    def close(self) -> None:
        pass

    def recalled(self) -> tuple[int, bytes | None]:
        if not self.memory.exists():
            return -(1 << 62), None
        done, blob = self.memory.get()
        return done, bytes(blob) if blob is not None else None

    def new(self, frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        """A list for each frame, so that a key's rows are never all in memory."""
        done, _ = self.recalled()
        for f in frames:
            yield [(int(r[0]), *r[1:]) for r in _tuples(f, self.columns) if r[0] is not None and r[0] > done]

    def frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        cells = list(zip(*rows, strict=True)) if rows else [()] * (len(self.out) - len(key))
        out = {c: [k] * len(rows) for c, k in zip(self.out, key, strict=False)}
        out |= {c: list(v) for c, v in zip(self.out[len(key) :], cells, strict=True)}
        return pd.DataFrame(out, columns=list(self.out), dtype=object)


class InOrder(_Keyed):
    """Gives rows to the machine of their key in order of time. They wait in sorted
    blocks, of which only those that overlap are read side by side."""

    def __init__(self, make: Callable[[tuple], Any], *args: Any):
        super().__init__(*args)
        self.make = make

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.blocks = handle.getMapState("blocks", "first long, number long", "rows binary")
        self.numbers = handle.getValueState("numbers", "next long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        number = self.numbers.get()[0] if self.numbers.exists() else 0
        first = None
        for new in self.new(rows):
            new.sort(key=_place)
            for at in range(0, len(new), BLOCK):
                self.blocks.updateValue((new[at][0], number), (pickle.dumps(new[at : at + BLOCK]),))
                number += 1
            if new:
                first = new[0][0] if first is None else min(first, new[0][0])
        if first is not None:
            self.numbers.update((number,))
            self.handle.registerTimer(-(-first // 1000))
        yield self.frame(key, [])

    def due(self, until: int, rest: list[int]) -> Iterator[tuple]:
        """Rows up to a time, in order; they leave the state. ``rest`` gets times of which
        the least is that of the first row that stays."""
        keys: list[tuple[int, int]] = []
        for first, number in self.blocks.keys():
            if first <= until:
                keys.append((first, number))
            else:
                rest[:] = [min([first, *rest])]
        keys.sort(reverse=True)
        open_: list[tuple] = []
        while keys or open_:
            # Every block that may hold the next row is open before that row is given.
            while keys and (not open_ or keys[-1][0] <= open_[0][2][0]):
                first, number = keys.pop()
                rows = pickle.loads(self.blocks.getValue((first, number))[0])
                self.blocks.removeKey((first, number))
                stay = [r for r in rows if r[0] > until]
                if stay:
                    self.blocks.updateValue((stay[0][0], number), (pickle.dumps(stay),))
                    rest[:] = [min([stay[0][0], *rest])]
                more = iter(rows[: len(rows) - len(stay)])
                row = next(more)
                heapq.heappush(open_, (_place(row), number, row, more))
            _, number, row, more = open_[0]
            after = next(more, None)
            if after is None:
                heapq.heappop(open_)
            else:
                heapq.heapreplace(open_, (_place(after), number, after, more))
            yield row

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        rest: list[int] = []
        due = self.due(timerValues.getCurrentWatermarkInMs() * 1000, rest)
        machine = None
        while some := list(islice(due, AT_ONCE)):
            if machine is None:
                _, blob = self.recalled()
                machine = self.make(key)
                if blob is not None:
                    machine.remember(pickle.loads(blob))
            done = some[-1][0]
            yield self.frame(key, machine.rows(some))
        if machine is not None:
            self.memory.update((done, cloudpickle.dumps(machine.memory())))
        if rest:
            self.handle.registerTimer(-(-rest[0] // 1000))
        yield self.frame(key, [])


class AtTimes(_Keyed):
    """Fires at times of its own: by the watermark, with no row to set it off. A timer keeps
    the last of its rows and their number, so state doesn't grow with the rows."""

    def __init__(self, next_time: Callable[[int], int], *args: Any):
        super().__init__(*args)
        self.next_time = next_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.timers = handle.getMapState("timers", "ms long", "last binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came: dict[int, tuple[tuple, int]] = {}
        for new in self.new(rows):
            for r in new:
                ms = -(-self.next_time(r[0]) // 1000)
                last, n = came.get(ms, (r, 0))
                came[ms] = (max(last, r, key=_place), n + 1)
        for ms, (last, n) in came.items():
            if self.timers.containsKey((ms,)):
                before, m = pickle.loads(self.timers.getValue((ms,))[0])
                last, n = max(before, last, key=_place), m + n
            else:
                self.handle.registerTimer(ms)
            self.timers.updateValue((ms,), (pickle.dumps((last, n)),))
        yield self.frame(key, [])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        last, n = pickle.loads(self.timers.getValue((ms,))[0])
        self.timers.removeKey((ms,))
        self.memory.update((ms * 1000, None))
        yield self.frame(key, [(ms * 1000, last[0], last[-1], n)])


def _transformed(rows: DataFrame, by: Sequence[str], columns: Sequence[str], out: str, late: str, processor: Callable[..., _Keyed]) -> DataFrame:
    """Rows dealt by key to a processor; ``out`` are the result's columns after the key's."""
    use_rocksdb(rows.sparkSession)
    rows = rows.withWatermark("ts", late).select(*by, "ts", F.unix_micros("ts").alias("us_"), *columns)
    kinds = dict(rows.dtypes)
    schema = StructType.fromDDL(", ".join(f"`{k}` {kinds[k]}" for k in by) + ", " + out)
    made = processor(("us_", *columns), schema.names)
    return rows.groupBy(*by).transformWithStateInPandas(made, schema, "Append", "EventTime")


class _Folds:
    def __init__(self, steps: Sequence[tuple], columns: Sequence[str]):
        self.steps, self.columns, self.folds = steps, columns, [make() for make, _, _ in steps]

    def memory(self) -> Any:
        return self.folds

    def remember(self, folds: Any) -> None:
        self.folds = folds

    def rows(self, due: list[tuple]) -> list[tuple]:
        cells = {c: np.array([np.nan if r[i + 1] is None else r[i + 1] for r in due], dtype=float) for i, c in enumerate(self.columns)}
        for fold, (_, inputs, outputs) in zip(self.folds, self.steps, strict=True):
            got = fold.push(*(cells[c] for c in inputs))
            cells |= dict(zip(outputs, got if isinstance(got, tuple) else (got,), strict=True))
        names = [*self.columns, *(c for _, _, outputs in self.steps for c in outputs)]
        return [(r[0], *v) for r, v in zip(due, zip(*([None if x != x else x for x in cells[c].tolist()] for c in names), strict=True), strict=True)]


def folded(bars: DataFrame, steps: Sequence[tuple], columns: Sequence[str] = ("close",), by: tuple[str, ...] = ("symbol",), late: str = "1 hour") -> DataFrame:
    """``operators.folds.fold`` on a stream: (make, inputs, outputs) for each machine."""
    names = [*columns, *(c for _, _, outputs in steps for c in outputs)]
    bars = bars.withColumns({c: F.col(c).cast("double") for c in columns})
    out = _transformed(bars, by, columns, "us_ bigint, " + ", ".join(f"`{c}` double" for c in names), late, lambda *a: InOrder(lambda key: _Folds(steps, columns), *a))
    return out.select(*by, F.timestamp_micros("us_").alias("ts"), *names)


class _Trader:
    def __init__(self, make: Callable[..., Strategy], rules: Rules, columns: Sequence[str]):
        self.make, self.rules, self.columns, self.session = make, rules, columns, None
        self.bar = namedtuple("bar", [*BAR, *columns])

    def memory(self) -> Any:
        return self.session.memory()

    def remember(self, memory: Any) -> None:
        self.session = Session.remembered(memory, self.rules)

    def rows(self, due: list[tuple]) -> list[tuple]:
        if self.session is None:
            self.session = Session(self.make, self.rules)
        out = []
        for us, *cells in due:
            bar = self.bar(pd.Timestamp(us, unit="us").to_pydatetime(), *cells)
            *numbers, fills, trades, orders = self.session.step(None, bar)
            out.append((us, bar.close, *numbers, as_dicts("fills", fills), as_dicts("trades", trades), as_dicts("orders", orders)))
        return out


def traded(bars: DataFrame, make: Callable[..., Strategy], rules: Rules = Rules(), columns: Sequence[str] = (), by: tuple[str, ...] = ("symbol",), late: str = "1 hour") -> DataFrame:
    """``operators.strategy.run_strategy`` on a stream of bars: cash, position, the open trade, pending
    orders and the strategy itself are the key's state. ``columns`` come with the
    bars; a strategy may instead keep what it needs of them. Times that it sees are UTC."""
    bars = bars.withColumns({c: F.col(c).cast("double") for c in BAR[1:]}).where("open is not null and high is not null and low is not null and close is not null")
    out = _transformed(bars, by, (*BAR[1:], *columns), "us_ bigint, " + result_schema().removeprefix("ts timestamp, "), late, lambda *a: InOrder(lambda key: _Trader(make, rules, columns), *a))
    return out.select(*by, F.timestamp_micros("us_").alias("ts"), *[c for c in out.columns if c not in (*by, "us_")])


class _Coupler:
    """The last slow value, for fast rows."""

    def __init__(self) -> None:
        self.last: tuple | None = None

    def memory(self) -> Any:
        return self.last

    def remember(self, last: Any) -> None:
        self.last = last

    def rows(self, due: list[tuple]) -> list[tuple]:
        out = []
        for us, side, value in due:
            if side == 0:
                self.last = (us, value)
            else:
                out.append((us, value, *(self.last or (None, None))))
        return out


def coupled(fast: DataFrame, slow: DataFrame, x: str = "close", by: tuple[str, ...] = ("symbol",), late: str = "1 hour") -> DataFrame:
    """Each row of a fast stream with the last value of a slow one at or before
    its time. The watermark is the lesser of the two streams', so fast
    rows wait for the slow stream. Two rows of one side at one time: all fast ones
    come, of slow ones the greatest value counts."""
    one = lambda df, side: df.withWatermark("ts", late).select(*by, "ts", F.lit(side).alias("side_"), F.col(x).cast("double").alias("x_"))
    use_rocksdb(fast.sparkSession)
    both = one(slow, 0).unionByName(one(fast, 1)).withColumn("us_", F.unix_micros("ts"))
    kinds = dict(both.dtypes)
    schema = StructType.fromDDL(", ".join(f"`{k}` {kinds[k]}" for k in by) + ", us_ bigint, value double, since_ bigint, slow double")
    made = InOrder(lambda key: _Coupler(), ("us_", "side_", "x_"), schema.names)
    out = both.groupBy(*by).transformWithStateInPandas(made, schema, "Append", "EventTime")
    return out.select(*by, F.timestamp_micros("us_").alias("ts"), F.col("value").alias(x), F.timestamp_micros("since_").alias("slow_ts"), F.col("slow").alias(f"slow_{x}"))


DAY = 86_400_000_000


def day_times(at: int, weekdays: Sequence[int] = range(1, 8)) -> Callable[[int], int]:
    """From a time (microseconds, UTC) to the next time of day ``at`` (microseconds
    since midnight), itself included, on one of the weekdays (Monday is 1)."""

    def of(us: int) -> int:
        day = us // DAY
        if day * DAY + at < us:
            day += 1
        while (day + 3) % 7 + 1 not in weekdays:
            day += 1
        return day * DAY + at

    return of


def timed(ticks: DataFrame, next_time: Callable[[int], int], x: str = "price", order: Sequence[str] = (), by: tuple[str, ...] = ("symbol",), late: str = "1 hour") -> DataFrame:
    """A row each time the timer of a key fires: when, the last row's time and value
    by then (of rows at one time the greatest by ``order``), and the rows since it fired before. The timer is set by
    a row and fires when the watermark passes its time, whether or not another row ever comes. Times are whole
    milliseconds; ``next_time`` of one of its times is that time, and it never decreases."""
    ticks = ticks.where(F.col(x).isNotNull()).withColumn(x, F.col(x).cast("double"))
    out = _transformed(ticks, by, (*order, x), f"us_ bigint, last_ bigint, `{x}` double, n bigint", late, lambda *a: AtTimes(next_time, *a))
    return out.select(*by, F.timestamp_micros("us_").alias("ts"), F.timestamp_micros("last_").alias("last_ts"), x, "n")
