"""Connected components of a graph held in a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written


def _digest(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(links: DataFrame, a: Column, b: Column) -> DataFrame:
    """(node, component) for every node that has a link, the component being
    the smallest node reachable.

    Alternates two steps until nothing changes: every node's larger neighbours,
    then its smaller ones, are tied to the least node it knows. Both are joins
    with one aggregated minimum per node, so a node with very many links is
    spread by the skew join. Each round is written to the shared folder; the
    number of rounds grows with the logarithm of the longest chain.
    Nulls and self-links are ignored; repeated links count once.
    """
    a, b = a.alias("a"), b.alias("b")
    edges = links.select(a, b).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges)
    before = _digest(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.distinct())
        after = _digest(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
