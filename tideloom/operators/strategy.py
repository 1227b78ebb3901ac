"""Strategies that react to what becomes of their orders.

A strategy is an object in the fold of a series: on each bar its pending orders
are worked first, it is told of their changes and of closed trades, then asked
what to do. Its indicators are columns of the bars, made by window expressions
beforehand. State is the strategy, its cash, positions and pending orders.

Orders may trail the close, expire, hang on a parent and cancel each other:
children sleep until their parent is completed and are worked from the bar after;
when a child is completed its siblings are cancelled; they end with a
parent that ends unfilled.
"""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .broker import FILL, TRADE, Account, Book, Order, Rules, bar_percent, matched

ALIVE = ("Submitted", "Accepted", "Partial")


@dataclass
class Ticket(Order):
    """An order with its state. ``trail`` is a distance from the close, or
    ``trail_percent`` a hundredth part of it; ``until`` the last time, and ``bars`` the
    number of bars, on which it is worked."""

    trail: float | None = None
    trail_percent: float | None = None
    until: Any = None
    bars: int | None = None
    parent: int | None = None
    feed: Any = None
    status: str = "Submitted"
    #: The bar since which it is worked from the next on; None while it sleeps.
    since: int | None = None

    @property
    def alive(self) -> bool:
        return self.status in ALIVE

    def follow(self, close: float) -> None:
        """A trailing stop moves with the close, one way only; its limit keeps its distance."""
        if (self.trail is None and self.trail_percent is None) or self.triggered:
            return
        gap = self.trail if self.trail is not None else close * self.trail_percent / 100
        new = close - gap if self.size < 0 else close + gap
        if self.price is None or (new > self.price if self.size < 0 else new < self.price):
            if self.limit is not None and self.price is not None:
                self.limit += new - self.price
            self.price = new

    def expired(self, ts: Any, bar: int) -> bool:
        return (self.until is not None and ts > self.until) or (self.bars is not None and self.since is not None and bar > self.since + self.bars)


Trade = namedtuple("Trade", "opened closed size entry exit pnl pnlcomm bars")


class Desk(Account):
    """Works the tickets of one feed."""

    def __init__(self, rules: Rules, book: Book, feed: Any = None):
        super().__init__(rules, book)
        self.feed, self.events = feed, []

    def tell(self, x: Ticket, status: str, price: float | None = None) -> None:
        x.status = status
        self.events.append((x, (x.id, x.parent, x.kind, status, x.size, price if price is not None else x.price, x.left)))

    def end(self, x: Ticket, status: str) -> None:
        """An order that ends unfilled takes its children along."""
        self.tell(x, status)
        for y in self.pending:
            if y.parent == x.id and y.alive:
                self.end(y, "Canceled")

    def submit(self, x: Ticket, close: float) -> None:
        """Takes an order or refuses it for want of cash."""
        held = self.position.size
        x.follow(close)
        self.tell(x, "Submitted")
        if x.parent is None:
            cost = self.r.commission.cost(x.size, close) + self.r.commission.fee(x.size, close, self.book.traded)
            if x.size * held >= 0 and cost > self.book.cash:
                self.tell(x, "Margin")
                return
            x.since = self.bar
            self.tell(x, "Accepted")
        elif not any(p.id == x.parent and p.alive for p in self.pending):
            self.tell(x, "Rejected")
            return
        self.pending.append(x)

    def work(self, ts: Any, o: float, h: float, lo: float, c: float, volume: float | None) -> tuple[list, list]:
        """Orders pending before this bar, on this bar."""
        fills: list[tuple] = []
        trades: list[tuple] = []
        self.bar += 1
        for x in list(self.pending):
            if not x.alive or x.since is None or x.since >= self.bar:
                continue
            if x.expired(ts, self.bar):
                self.end(x, "Expired")
                continue
            at = matched(x, h, lo, o, c, self.r.instant_stop_limit)
            if at is None:
                x.follow(c)
                continue
            at = self.r.slipped(at, x.left > 0, h, lo)
            size = x.left
            if self.r.fill_percent is not None:
                size = math.copysign(bar_percent(abs(x.left), volume or 0.0, self.r.fill_percent), x.left)
            if self.r.filler is not None:
                size = math.copysign(max(0.0, self.r.filler(abs(size), volume or 0.0, h, lo, at)), x.left)
            if not size:
                continue
            self._execute(ts, x, size, at, fills, trades)
            x.left -= size
            self.tell(x, "Partial" if x.left else "Completed", at)
            if x.left:
                continue
            for y in self.pending:
                if y.parent == x.id and y.alive:
                    y.since = self.bar
                    self.tell(y, "Accepted")
                elif x.parent is not None and y.parent == x.parent and y is not x and y.alive:
                    self.end(y, "Canceled")
        self.pending = [x for x in self.pending if x.alive]
        if not self.r.commission.stock and self.position.size:
            self.book.cash += self.r.commission.pnl(self.position.size, self.mark, c)
            self.mark = c
        return fills, trades


class Strategy:
    """Override what is of use. ``bar`` has the columns of the row by name."""

    def __init__(self, **params: Any):
        self.params = params

    def start(self) -> None:
        """Before the first bar."""

    def next(self, bar: Any) -> None:
        """On each bar, after its fills."""

    def notify_order(self, order: Ticket, status: str) -> None:
        """After each change of an order's state, in turn."""

    def notify_trade(self, trade: Trade) -> None:
        """After a position is closed."""

    # What it has

    @property
    def cash(self) -> float:
        return self._session.book.cash

    @property
    def value(self) -> float:
        return self._session.value

    def position(self, feed: Any = None) -> float:
        return self._session.desk(feed).position.size

    def pending(self, feed: Any = None) -> list[Ticket]:
        return [x for x in self._session.desk(feed).pending if x.alive]

    # What it does

    def order(self, size: float, kind: str = "Market", price: float | None = None, limit: float | None = None, feed: Any = None, **more: Any) -> Ticket:
        """A signed size; ``more`` are a ticket's trail, trail_percent, until, bars and parent (a ticket)."""
        return self._session.submit(size, kind, price, limit, feed, more)

    def buy(self, size: float | None = None, kind: str = "Market", price: float | None = None, **more: Any) -> Ticket:
        return self.order(self._session.sized(size, more.get("feed"), 1.0), kind, price, **more)

    def sell(self, size: float | None = None, kind: str = "Market", price: float | None = None, **more: Any) -> Ticket:
        return self.order(-self._session.sized(size, more.get("feed"), -1.0), kind, price, **more)

    def close(self, feed: Any = None) -> Ticket | None:
        held = self.position(feed)
        return self.order(-held, feed=feed) if held else None

    def target(self, size: float, feed: Any = None) -> Ticket | None:
        """To hold ``size``."""
        change = size - self.position(feed)
        return self.order(change, feed=feed) if change else None

    def cancel(self, order: Ticket) -> None:
        if order.alive:
            self._session.desk(order.feed).end(order, "Canceled")

    def bracket(self, size: float, stop: float, target: float, kind: str = "Market", price: float | None = None, **more: Any) -> tuple[Ticket, Ticket, Ticket]:
        """An order and, once it is completed, a stop and a limit that close it, the one or the other."""
        main = self.order(size, kind, price, **more)
        feed = {"feed": more["feed"]} if "feed" in more else {}
        return main, self.order(-size, "Stop", stop, parent=main, **feed), self.order(-size, "Limit", target, parent=main, **feed)


class Session:
    """A strategy at work: its cash, a desk for each feed and the last bar."""

    def __init__(self, make: Callable[..., Strategy], rules: Rules, params: dict[str, Any] | None = None):
        self.rules, self.book, self.desks = rules, Book(rules.cash), {}
        self.worth: dict[Any, float] = {}
        self.now, self.close, self.orders = None, {}, 0
        self.strategy = make(**(params or {}))
        self.strategy._session = self
        self.strategy.start()

    def desk(self, feed: Any = None) -> Desk:
        feed = self.now if feed is None else feed
        return self.desks.get(feed) or self.desks.setdefault(feed, Desk(self.rules, self.book, feed))

    @property
    def value(self) -> float:
        return self.book.cash + sum(self.worth.values())

    def sized(self, size: float | None, feed: Any, side: float) -> float:
        if size is not None or self.rules.sizer is None:
            return abs(1.0 if size is None else size)
        feed = self.now if feed is None else feed
        return abs(self.rules.sizer(self.book.cash, self.close[feed], self.desk(feed).position.size, side))

    def submit(self, size: float, kind: str, price: float | None, limit: float | None, feed: Any, more: dict) -> Ticket:
        feed = self.now if feed is None else feed
        self.orders += 1
        parent = more.pop("parent", None)
        x = Ticket(self.orders, float(size), kind, price, limit, self.close.get(feed, 0.0), parent=parent.id if parent else None, feed=feed, **more)
        if not size or (parent and not parent.alive):
            self.desk(feed).tell(x, "Rejected")
        else:
            self.desk(feed).submit(x, self.close.get(feed, 0.0))
        return x

    def memory(self) -> dict[str, Any]:
        """All but the rules, to be kept between the batches of a stream."""
        self.strategy._session = None
        for d in self.desks.values():
            d.r = None
        return {k: v for k, v in self.__dict__.items() if k != "rules"}

    @classmethod
    def remembered(cls, memory: dict[str, Any], rules: Rules) -> Session:
        out = cls.__new__(cls)
        out.__dict__.update(memory, rules=rules)
        for d in out.desks.values():
            d.r = rules
        out.strategy._session = out
        return out

    def step(self, feed: Any, bar: Any) -> tuple:
        """(cash, value, position, price, fills, trades, events) after the bar."""
        self.now = feed
        desk = self.desk(feed)
        fills, trades = desk.work(bar.ts, bar.open, bar.high, bar.low, bar.close, bar.volume)
        self.close[feed] = bar.close
        self.worth[feed] = desk.worth(bar.close)
        out: list[tuple] = []
        self._notify(out)
        for t in trades:
            self.strategy.notify_trade(Trade(*t))
        self.strategy.next(bar)
        self._notify(out)
        for d in self.desks.values():
            if not all(x.alive for x in d.pending):
                d.pending = [x for x in d.pending if x.alive]
        self.worth[feed] = desk.worth(bar.close)
        return self.book.cash, self.value, desk.position.size, desk.position.price, fills, trades, out

    def _notify(self, out: list[tuple]) -> None:
        """Tells the strategy of all changes, those that its answers make included."""
        while found := [e for d in self.desks.values() for e in d.events]:
            for d in self.desks.values():
                d.events = []
            for x, event in found:
                out.append(event)
                self.strategy.notify_order(x, event[3])


EVENT = "struct<order:int,parent:int,kind:string,status:string,size:double,price:double,left:double>"
_NAMES = {"fills": ("order", "size", "price", "fee", "pnl"), "trades": Trade._fields, "orders": ("order", "parent", "kind", "status", "size", "price", "left")}
BAR = ("ts", "open", "high", "low", "close", "volume")


def arrow_types(ts: pa.DataType) -> dict[str, pa.StructType]:
    f8 = pa.float64()
    return {
        "fills": pa.struct([("order", pa.int32()), *[(c, f8) for c in _NAMES["fills"][1:]]]),
        "trades": pa.struct([("opened", ts), ("closed", ts), *[(c, f8) for c in Trade._fields[2:7]], ("bars", pa.int32())]),
        "orders": pa.struct([("order", pa.int32()), ("parent", pa.int32()), ("kind", pa.string()), ("status", pa.string()), *[(c, f8) for c in _NAMES["orders"][4:]]]),
    }


def as_dicts(name: str, rows: Sequence[tuple]) -> list[dict]:
    return [dict(zip(_NAMES[name], r, strict=True)) for r in rows]


def result_schema() -> str:
    return f"ts timestamp, close double, cash double, value double, position double, price double, fills array<{FILL}>, trades array<{TRADE}>, orders array<{EVENT}>"


def prepared(bars: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys, bars as doubles and the strategy's columns; bars without prices go."""
    df = bars.select(*keys, "ts", *[F.col(c).cast("double").alias(c) for c in BAR[1:]], *columns)
    return df.where("open is not null and high is not null and low is not null and close is not null")


def run_strategy(bars: DataFrame, make: Callable[..., Strategy], rules: Rules = Rules(), columns: Sequence[str] = (), by: tuple[str, ...] = ("symbol",), feed: str | None = None, params: Sequence[str] = ()) -> DataFrame:
    """A strategy over each series of ``by``, made by ``make``, which is given those columns of ``by`` that
    ``params`` names. ``columns`` are what it sees of a bar beside its prices.

    With ``feed`` a series has several feeds under one cash account, taken in
    order of time, then feed; series run side by side. One row a bar: cash, value,
    position, price, fills, trades, and ``orders``, each change of an order's state.
    Bars without a price are left out; an empty frame gives no rows; a null key is a key.
    A null is None to the strategy."""
    keys = (*by, feed) if feed else by
    df = prepared(bars, keys, columns)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + result_schema()
    at = F.col("ts")
    ordered = df.repartition(*[F.col(k) for k in by]).sortWithinPartitions(*by, at, *([feed] if feed else []))
    row_of = namedtuple("bar", [*BAR, *columns])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, current = None, None
        for b in batches:
            owners = list(zip(*(b.column(k).to_pylist() for k in by), strict=True))
            feeds = b.column(feed).to_pylist() if feed else [None] * len(owners)
            out = []
            for owner, name, row in zip(owners, feeds, zip(*(b.column(c).to_pylist() for c in (*BAR, *columns)), strict=True), strict=True):
                if session is None or owner != current:
                    current, session = owner, Session(make, rules, {k: v for k, v in zip(by, owner, strict=True) if k in params})
                out.append(session.step(name, row_of(*row)))
            kind = arrow_types(b.schema.field("ts").type)
            cells = list(zip(*out, strict=True)) or [()] * 7
            arrays = [*(pa.array(x, pa.float64()) for x in cells[:4]), *(pa.array([as_dicts(n, r) for r in x], pa.list_(kind[n])) for n, x in zip(_NAMES, cells[4:], strict=True))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), b.column("ts"), b.column("close"), *arrays], [*keys, "ts", "close", "cash", "value", "position", "price", *_NAMES])

    return ordered.mapInArrow(go, schema)


def orders(result: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Every change of an order's state: ``n`` counts them within a bar."""
    return result.select(*by, "ts", F.posexplode("orders").alias("n", "e")).select(*by, "ts", "n", "e.*")
