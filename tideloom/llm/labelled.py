"""Labelled rows for the two classifiers, kept apart from the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label tables of at most this many rows, an id and a number each, are broadcast;
#: larger ones are shuffled.
BROADCAST_ROWS = 250_000
HELD_OUT = 2


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id is in fold 0 but has no label."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)), F.lit(0)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y, fold) of labelled documents outside the held-out fold. A
    document with several labels counts as 1 if any is; null labels don't count."""
    told = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null and y in (0, 1)")
    told = told.where(fold(F.col("_id")) != HELD_OUT).groupBy("_id").agg(F.max("y").alias("y"))
    if labels.count() <= BROADCAST_ROWS:
        told = F.broadcast(told)
    mine = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(fold(F.col("_id")) != HELD_OUT)
    return mine.join(told, "_id").select(F.col("_id").alias("id"), "text", "y", fold(F.col("_id")).alias("fold"))
