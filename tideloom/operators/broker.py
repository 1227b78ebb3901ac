"""Order execution, one state machine for each series.

Orders decided on a bar are worked from the next bar on, before that bar's own
decisions, so a signal on the last bar never fills. The machine is folded over
rows sorted by series and time with a state of a few numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Commission:
    """Stock-like by default: a share of size times price. With ``margin`` a
    contract: ``commission`` each, ``margin`` held each, gains times ``mult``."""

    commission: float = 0.0
    margin: float | None = None
    mult: float = 1.0
    fixed: bool = False
    minimum: float = 0.0
    leverage: float = 1.0

    @property
    def stock(self) -> bool:
        return self.margin is None

    #: Tiers of traded volume, maker and taker rate, in place of ``commission``.
    tiers: tuple[tuple[float, float, float], ...] = ()
    #: ``commission`` a share, whatever its price.
    per_share: bool = False
    #: Percent of the value that orders with a limit (makers) and the others (takers) pay, in place of ``commission``.
    rates: tuple[float, float] | None = None
    maximum: float | None = None

    @property
    def held(self) -> float:
        """Cash that a contract holds."""
        return self.margin / self.leverage

    def fee(self, size: float, price: float, traded: float = 0.0, maker: bool = False) -> float:
        if self.tiers:
            fee = crypto_fee(size * price, traded, maker, self.tiers)
        elif self.rates:
            fee = abs(size * price) * self.rates[0 if maker else 1] / 100
        elif self.fixed:
            fee = self.commission
        else:
            fee = abs(size) * self.commission * (price if self.stock and not self.per_share else 1.0)
        fee = max(fee, self.minimum)
        return (fee if self.maximum is None else min(fee, self.maximum)) if size else 0.0

    def cost(self, size: float, price: float) -> float:
        """Cash that opening takes."""
        return abs(size) * (price if self.stock else self.margin) / self.leverage

    def pnl(self, size: float, price: float, now: float) -> float:
        return size * (now - price) * self.mult


#: Volume tiers of crypto fees: traded volume, maker and taker rate.
CRYPTO_TIERS = ((0, 0.0010, 0.0010), (10_000, 0.0009, 0.0010), (50_000, 0.0008, 0.0010), (100_000, 0.0007, 0.0009), (500_000, 0.0006, 0.0008))


#: Published maker and taker percents of exchanges. Fixed values.
EXCHANGES = {"binance_spot": (0.1, 0.1), "binance_futures": (0.02, 0.04), "coinbase_pro": (0.5, 0.5), "kraken": (0.16, 0.26), "ftx": (0.02, 0.07)}


def exchange(name: str, **more: float) -> Commission:
    """What an exchange takes of spot and crypto orders."""
    return Commission(rates=EXCHANGES[name], **more)


def forex(commission: float, margin: float, leverage: float, mult: float = 1.0) -> Commission:
    """Contracts of which ``margin`` over ``leverage`` is held each."""
    return Commission(commission, margin, mult, leverage=leverage)


def crypto_fee(value: float, traded: float = 0.0, maker: bool = False, tiers=CRYPTO_TIERS) -> float:
    rate = [t for t in tiers if traded >= t[0]][-1][1 if maker else 2]
    return abs(value) * rate


# Fillers: how much of an order a bar can fill.


def fixed_size(remaining: float, volume: float, size: float | None = None) -> float:
    return min(remaining, volume, size) if size is not None else min(remaining, volume)


def bar_percent(remaining: float, volume: float, percent: float = 100.0) -> float:
    return min(remaining, math.floor(volume * percent / 100))


def bar_points(remaining: float, volume: float, high: float, low: float, price: float, tick: float = 0.01, percent: float = 100.0) -> float:
    """The bar's volume spread evenly over its price points."""
    points = max(1, round((high - low) / tick) + 1)
    return min(remaining, math.floor(math.floor(volume * percent / 100) / points)) if low <= price <= high else 0.0


# Sizers: how much to trade.


def stake(cash: float, price: float, position: float, size: float = 1.0, tranches: int = 1) -> float:
    return abs(int(size / tranches)) if tranches > 1 else size


def reverser(cash: float, price: float, position: float, size: float = 1.0) -> float:
    """Twice the size when anything is held."""
    return size * (2 if position else 1)


def reversing(cash: float, price: float, position: float, size: float = 1.0) -> float:
    """Twice a signed size where it goes against what is held, else the size."""
    return size * (2 if position * size < 0 else 1)


def to_target(cash: float, price: float, position: float, size: float = 1.0, tranches: int = 1) -> float:
    """Signed: from what is held to a tranche of the size, long or short; needs ``Rules(signed=True)``."""
    return math.copysign(max(1.0, math.floor(abs(size) / tranches)), size) - position


def percent(cash: float, price: float, position: float, share: float = 20.0, whole: bool = False) -> float:
    """A share of the cash when flat, else what is held."""
    out = cash * share / 100 / price if not position else abs(position)
    return float(math.floor(out)) if whole else out


def all_in(cash: float, price: float, position: float, whole: bool = True) -> float:
    return percent(cash, price, position, 100.0, whole)


@dataclass
class Position:
    size: float = 0.0
    price: float = 0.0

    def update(self, size: float, price: float) -> tuple[float, float]:
        """(opened, closed), both signed. Adding averages the price, reducing
        keeps it, reversing sets it."""
        old = self.size
        self.size = old + size
        if not old or old * size > 0:
            self.price = (old * self.price + size * price) / self.size
            return size, 0.0
        if abs(size) <= abs(old):
            if not self.size:
                self.price = 0.0
            return 0.0, size
        self.price = price
        return self.size, -old


@dataclass
class Order:
    id: int
    size: float
    kind: str = "Market"
    price: float | None = None
    limit: float | None = None
    created: float = 0.0
    triggered: bool = False
    left: float = field(init=False)

    def __post_init__(self):
        self.left = self.size


@dataclass(frozen=True)
class Rules:
    cash: float = 10_000.0
    commission: Commission = Commission()
    slip_percent: float = 0.0
    slip_fixed: float = 0.0
    #: long: buy only when flat, sell only what is held; both: as told.
    mode: str = "both"
    fill_percent: float | None = None
    #: (remaining, volume, high, low, price) to how much a bar can fill.
    filler: Callable[[float, float, float, float, float], float] | None = None
    #: (cash, price, position, signed size asked for) to how much to trade; the order keeps its side, unless what comes is ``signed``.
    sizer: Callable[[float, float, float, float], float] | None = None
    signed: bool = False
    #: A slipped price stays within the bar.
    slip_match: bool = True
    #: A stop with a limit executes at once at its limit, without a trigger.
    instant_stop_limit: bool = False


    def slipped(self, at: float, buy: bool, high: float, low: float) -> float:
        """The price after slippage: by percent if there is one, else by a fixed amount."""
        gap = at * self.slip_percent if self.slip_percent > 0 else self.slip_fixed
        if not gap:
            return at
        at = at + gap if buy else at - gap
        return max(low, min(high, at)) if self.slip_match else at


def matched(o: Order, high: float, low: float, open_: float, close: float, instant: bool = True) -> float | None:
    """Price at which a bar executes an order, or None. Limits and stops
    execute at their own price. A stop with a limit waits for its stop, unless
    ``instant``; on that bar it executes if the close is within the limit, and
    from then on it is a limit order."""
    buy = o.left > 0
    if o.kind == "Market":
        return open_
    if o.kind == "Close":
        return close
    if o.price is None:
        return None
    if o.kind == "Limit":
        return o.price if (low <= o.price if buy else high >= o.price) else None
    if o.kind in ("Stop", "StopTrail"):
        return o.price if (high >= o.price if buy else low <= o.price) else None
    limit = o.limit if o.limit is not None else o.price  # StopLimit, StopTrailLimit
    if instant:
        return limit
    if not o.triggered:
        if high < o.price if buy else low > o.price:
            return None
        o.triggered = True
        return limit if (close <= limit if buy else close >= limit) else None
    return limit if (low <= limit if buy else high >= limit) else None


@dataclass
class Book:
    """Cash that one or several accounts draw on, and what has been traded."""

    cash: float
    traded: float = 0.0


class Account:
    """Position, pending orders and the open trade of one series, and the book
    its cash is in."""

    def __init__(self, rules: Rules, book: Book | None = None):
        self.r, self.book, self.position = rules, book or Book(rules.cash), Position()
        self.pending: list[Order] = []
        self.orders = 0
        self.mark = 0.0
        self.trade: dict | None = None
        self.bar = 0

    @property
    def cash(self) -> float:
        return self.book.cash

    def value(self, close: float) -> float:
        return self.book.cash + self.worth(close)

    def worth(self, close: float) -> float:
        c, p = self.r.commission, self.position
        return p.size * close if c.stock else abs(p.size) * c.held

    def _execute(self, ts, o: Order, size: float, price: float, fills: list, trades: list) -> None:
        c, p = self.r.commission, self.position
        was = p.price
        opened, closed = p.update(size, price)
        fee = c.fee(size, price, self.book.traded, o.kind in ("Limit", "StopLimit"))
        self.book.traded += abs(size * price)
        pnl = c.pnl(-closed, was, price) if closed else 0.0
        if c.stock:
            self.book.cash -= size * price
        else:
            self.book.cash -= (abs(opened) - abs(closed)) * c.held
            self.book.cash += c.pnl(-closed, self.mark, price) if closed else 0.0
            if opened and not closed and p.size != opened:
                self.book.cash += c.pnl(p.size - opened, self.mark, price)
            self.mark = price
        self.book.cash -= fee
        fills.append((o.id, size, price, fee, pnl))
        closing = abs(closed) / (abs(opened) + abs(closed)) if closed else 0.0
        if closed and self.trade:
            self.trade["pnl"] += pnl
            self.trade["fee"] += fee * closing
            if abs(closed) >= self.trade["held"] - 1e-12:
                t = self.trade
                trades.append((t["opened"], ts, t["size"], t["price"], price, t["pnl"], t["pnl"] - t["fee"], self.bar - t["bar"]))
                self.trade = None
            else:
                self.trade["held"] -= abs(closed)
        if opened:
            if self.trade is None:
                self.trade = {"opened": ts, "size": opened, "price": price, "pnl": 0.0, "fee": 0.0, "bar": self.bar, "held": 0.0}
            self.trade["fee"] += fee * (1 - closing)
            self.trade["held"] += abs(opened)

    def next(self, ts, o, h, lo, c, volume, order, kind, price, limit) -> tuple:
        fills: list[tuple] = []
        trades: list[tuple] = []
        rejected = 0
        self.bar += 1
        still: list[Order] = []
        for x in self.pending:
            at = matched(x, h, lo, o, c, self.r.instant_stop_limit)
            if at is None:
                still.append(x)
                continue
            at = self.r.slipped(at, x.left > 0, h, lo)
            size = x.left
            if self.r.fill_percent is not None:
                size = math.copysign(bar_percent(abs(x.left), volume or 0.0, self.r.fill_percent), x.left)
            if self.r.filler is not None:
                size = math.copysign(max(0.0, self.r.filler(abs(size), volume or 0.0, h, lo, at)), x.left)
            if size:
                self._execute(ts, x, size, at, fills, trades)
                x.left -= size
            if x.left:
                still.append(x)
        self.pending = still
        if not self.r.commission.stock and self.position.size:
            self.book.cash += self.r.commission.pnl(self.position.size, self.mark, c)
            self.mark = c
        if kind == "Cancel":
            self.pending, order = [], 0.0
        if order:
            held = self.position.size
            go = order
            if self.r.sizer is not None:
                go = self.r.sizer(self.book.cash, c, held, order)
                go = go if self.r.signed else math.copysign(abs(go), order)
            if self.r.mode == "long":
                busy = held + sum(x.left for x in self.pending)
                go = go if order > 0 and busy == 0 else (-held if order < 0 and held > 0 and busy == held else 0.0)
            if go:
                cost = self.r.commission.cost(go, c) + self.r.commission.fee(go, c, self.book.traded)
                if go * held >= 0 and cost > self.book.cash:
                    rejected = 1
                else:
                    self.orders += 1
                    self.pending.append(Order(self.orders, go, kind or "Market", price, limit, c))
        return self.book.cash, self.value(c), self.position.size, self.position.price, rejected, fills, trades


FILL = "struct<order:int,size:double,price:double,fee:double,pnl:double>"
TRADE = "struct<opened:timestamp,closed:timestamp,size:double,entry:double,exit:double,pnl:double,pnlcomm:double,bars:int>"


def run(bars: DataFrame, rules: Rules = Rules(), by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars with an ``order`` column (signed size, null or 0 for none; optional
    order_type, order_price and order_limit; type Cancel withdraws what is
    pending) to one row a bar: cash, value, position, price, rejected, fills and
    trades. Each series has cash of its own."""
    return _run(bars, rules, by, by, ())


def run_portfolio(bars: DataFrame, rules: Rules = Rules(), by: tuple[str, ...] = (), feed: str = "symbol") -> DataFrame:
    """``run`` with one cash account over all feeds of a portfolio: ``by`` tells
    portfolios apart (none: all is one). Rows are worked in order of time, then
    feed; cash and value are the portfolio's after the row, a feed without a bar
    at that time counting at its last close. ``gross`` is the worth of all
    positions, long or short, over the value. Portfolios run side by side; one
    portfolio is sequential."""
    one = bars if by else bars.withColumn("_portfolio", F.lit(0))
    out = _run(one, rules, by or ("_portfolio",), (*(by or ("_portfolio",)), feed), (feed,))
    return out if by else out.drop("_portfolio")


def _run(bars: DataFrame, rules: Rules, by: tuple[str, ...], keys: tuple[str, ...], feed: tuple[str, ...]) -> DataFrame:
    extra = {"order_type": "string", "order_price": "double", "order_limit": "double"}
    df = bars
    for c, kind in extra.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    cols = ["ts", "open", "high", "low", "close", "volume", "order", *extra]
    df = df.select(*keys, *[F.col(c) if c in ("ts", "order_type") else F.col(c).cast("double").alias(c) for c in cols]).where("open is not null and high is not null and low is not null and close is not null")
    kinds = dict(df.dtypes)
    more = ["gross"] if feed else []
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", ts timestamp, close double, cash double, value double, position double, price double, rejected int, fills array<{FILL}>, trades array<{TRADE}>" + "".join(f", {c} double" for c in more)
    ordered = df.repartition(*[F.col(k) for k in by]).sortWithinPartitions(*by, "ts", *feed)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, book, accounts, worth, total, gross = None, None, {}, {}, 0.0, 0.0
        for b in batches:
            owners = list(zip(*(b.column(k).to_pylist() for k in by), strict=True))
            feeds = b.column(feed[0]).to_pylist() if feed else [None] * len(owners)
            rows = zip(*(b.column(c).to_pylist() for c in cols), strict=True)
            out = []
            for owner, name, row in zip(owners, feeds, rows, strict=True):
                if book is None or owner != current:
                    current, book, accounts, worth, total, gross = owner, Book(rules.cash), {}, {}, 0.0, 0.0
                account = accounts.get(name) or accounts.setdefault(name, Account(rules, book))
                cash, value, *rest = account.next(*row)
                if feed:
                    before, now = worth.get(name, 0.0), account.worth(row[4])
                    worth[name] = now
                    total, gross = total + now - before, gross + abs(now) - abs(before)
                    value = cash + total
                    rest.append(gross / value if value else None)
                out.append((cash, value, *rest))
            cash, value, position, price, rejected, fills, trades, *gross_ = zip(*out, strict=True) if out else ((),) * (7 + len(more))
            f = pa.struct([("order", pa.int32()), *[(c, pa.float64()) for c in ("size", "price", "fee", "pnl")]])
            ts = b.schema.field("ts").type
            t = pa.struct([("opened", ts), ("closed", ts), *[(c, pa.float64()) for c in ("size", "entry", "exit", "pnl", "pnlcomm")], ("bars", pa.int32())])
            as_dicts = lambda kind, rows: [[dict(zip([x.name for x in kind], r, strict=True)) for r in rr] for rr in rows]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keys), b.column("ts"), b.column("close"), *(pa.array(x, pa.float64()) for x in (cash, value, position, price)), pa.array(rejected, pa.int32()), pa.array(as_dicts(f, fills), pa.list_(f)), pa.array(as_dicts(t, trades), pa.list_(t)), *(pa.array(x, pa.float64()) for x in gross_)],
                [*keys, "ts", "close", "cash", "value", "position", "price", "rejected", "fills", "trades", *more],
            )

    return ordered.mapInArrow(go, schema)


def fills(result: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return result.select(*by, "ts", F.explode("fills").alias("f")).select(*by, "ts", "f.*")


def trades(result: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return result.select(*by, F.explode("trades").alias("t")).select(*by, "t.*")


def equity(result: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return result.select(*by, "ts", "close", "cash", "value", "position", "price")
