"""A table of bars that grow while their ticks still come.

A stream in update mode gives a bar each time it has changed. Each micro-batch is
one folder of the table, named by its number and overwritten if the batch is run
again, so a batch that was written but not committed before a crash counts once.
Of a bar's versions the one of the latest batch is its present state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, until timestamp, last timestamp, batch bigint"
BARS = ("open", "high", "low", "close", "volume")


def growing(ticks: DataFrame, width: str, late: str, tie: str | None = None, symbol: str = "symbol", ts: str = "ts", price: str = "price") -> DataFrame:
    """Bars of a stream of ticks, with the end of each and the time of its last tick."""
    at = F.struct(ts, tie) if tie else F.col(ts)
    t = ticks.where(F.col(price).isNotNull()).withColumn(price, F.col(price).cast("double")).withWatermark(ts, late)
    g = t.groupBy(F.col(symbol).cast("string").alias("symbol"), F.window(ts, width).alias("_w"))
    out = g.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume"), F.max(ts).alias("last"))
    return out.select("symbol", F.col("_w.start").alias("ts"), *BARS, F.col("_w.end").alias("until"), "last")


def replay(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts keeping ``growing`` bars in the table at ``path`` with what has arrived by
    now; run again with the same checkpoint it goes on with what came since."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return bars.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start()


def table(spark: SparkSession, path: str, late: str) -> DataFrame:
    """The bars as they are now. ``complete`` says that the bar's end is ``late`` behind
    the latest tick, after which the stream takes no more of its ticks."""
    rows = spark.read.schema(SCHEMA).option("basePath", path).parquet(path)
    now = rows.groupBy("symbol", "ts").agg(F.max_by(F.struct(*BARS, "until", "last"), "batch").alias("b"), F.count("*").alias("versions")).select("symbol", "ts", "b.*", "versions")
    seen = rows.agg(F.max("last").alias("_seen"))
    return now.join(F.broadcast(seen)).select("symbol", "ts", *BARS, "versions", (F.col("until") <= F.col("_seen") - F.expr(f"INTERVAL {late}")).alias("complete"))
