"""What a pair of lines, or a line and the price, says of a trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frame import Bars, col

#: Distances of the two lines from which a trend is one grade stronger. Fixed values.
GRADES = (0.05, 0.10, 0.20, 0.35)


def readings(b: Bars, up: str, down: str, lookback: int = 3, n: int = 20, sideways: float = 0.05, most: float = 0.6, out: str = "trend") -> Bars:
    """_strength, the lines' distance; _direction, its sign; _grade, 0 to 4; _momentum, how the signed
    distance has changed since ``lookback`` rows; _regime of the last ``n`` rows:
    up, down or ranging if more than ``most`` of them are so, else volatile."""
    d = F.col(up) - F.col(down)
    b = b.put(_d=d).put(_up=F.when(F.col("_d").isNotNull(), (F.col("_d") > sideways).cast("double")), _down=F.when(F.col("_d").isNotNull(), (F.col("_d") < -sideways).cast("double")))
    d = F.col("_d")
    share = lambda c: b.sum(c, n) / n
    flat = 1 - share("_up") - share("_down")
    regime = F.when(share("_up") > most, "up").when(share("_down") > most, "down").when(flat > most, "ranging").when(flat.isNotNull(), "volatile")
    grade: Column = sum(((F.abs(d) >= g).cast("double") for g in GRADES[1:]), (F.abs(d) >= GRADES[0]).cast("double"))
    return b.put(**{f"{out}_strength": F.abs(d), f"{out}_direction": F.signum(d), f"{out}_grade": grade, f"{out}_momentum": d - b.lag("_d", lookback), f"{out}_regime": regime}).drop("_d", "_up", "_down")


def _crossings(b: Bars, up: str, down: str) -> Bars:
    """_cross: 1 or -1 where the first line comes to be above or below the second."""
    d = F.col(up) - F.col(down)
    b = b.put(_d=d)
    before = b.lag("_d")
    return b.put(_cross=F.when((F.col("_d") > 0) & (before <= 0), 1.0).when((F.col("_d") < 0) & (before >= 0), -1.0))


def validated(b: Bars, up: str, down: str, price: str = "close", hold: int = 5) -> DataFrame:
    """For each series its crossings, each held for ``hold`` rows in its direction: signals, how many were
    right, their share, and the average, greatest and least gain. Crossings with fewer rows to come don't count."""
    b = _crossings(b, up, down)
    b = b.put(_gain=F.col("_cross") * (b.lag(price, -hold) - F.col(price)) / F.col(price))
    g = b.df.where("_gain is not null").groupBy(*b.by)
    return g.agg(F.count("*").alias("signals"), F.sum((F.col("_gain") > 0).cast("bigint")).alias("correct"), F.avg((F.col("_gain") > 0).cast("double")).alias("accuracy"), F.avg("_gain").alias("average"), F.max("_gain").alias("best"), F.min("_gain").alias("worst"))


def line_stats(b: Bars, up: str, down: str, n: int = 100) -> DataFrame:
    """Over the last ``n`` rows of each series that have both lines: their averages and
    extremes, and how often the first came to be above the second, or no longer was."""
    good = Bars(b.df.where(F.col(up).isNotNull() & F.col(down).isNotNull()), b.by, b.order)
    back = W.partitionBy(*b.by).orderBy(*[F.col(c).desc() for c in b.order])
    good = good.put(_back=F.row_number().over(back), _above=F.col(up) > F.col(down))
    good = good.put(_was=good.lag("_above"))
    recent = good.df.where(F.col("_back") <= n).withColumn("_was", F.when(F.col("_back") < n, F.col("_was")))
    flips = lambda now: F.sum(F.when((F.col("_above") == now) & (F.col("_was") != F.col("_above")), 1).otherwise(0)).alias("rises" if now else "falls")
    cells = [f(c).alias(f"{k}_{name}") for k, c in (("up", up), ("down", down)) for name, f in (("average", F.avg), ("most", F.max), ("least", F.min))]
    return recent.groupBy(*b.by).agg(*cells, flips(True), flips(False))


def divergences(b: Bars, line: str | Column, price: str = "close", lookback: int = 20, out: str = "divergence") -> Bars:
    """1 where the line is above all ``lookback`` rows on both sides while the price is
    below all of them, -1 the other way round, else 0; null near the ends of a series, as it looks ahead."""
    b = b.put(_line=col(line))
    w = b.w

    def beyond(x: str, above: bool) -> Column:
        f = F.max if above else F.min
        sides = [f(x).over(w.rowsBetween(-lookback, -1)), f(x).over(w.rowsBetween(1, lookback))]
        return (F.col(x) > sides[0]) & (F.col(x) > sides[1]) if above else (F.col(x) < sides[0]) & (F.col(x) < sides[1])

    whole = F.count("_line").over(w.rowsBetween(-lookback, lookback)) == 2 * lookback + 1
    value = F.when(beyond("_line", True) & beyond(price, False), 1.0).when(beyond("_line", False) & beyond(price, True), -1.0).otherwise(0.0)
    return b.put(**{out: F.when(whole, value)}).drop("_line")
