"""Shards by extendible hashing.

The directory is indexed by the leading bits of a 60-bit hash of id and text.
A bucket over its byte limit splits on one more bit, and only it; the leaves
are the shards. Counting is one aggregation over fine hash cells, from which
all shorter prefixes add up, so no bucket's rows are gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import numbered, written

BITS = 60
#: Cells of the directory, of about 40 bytes each, that are broadcast at most.
BROADCAST_CELLS = 200_000


def _hash(id_col: str, text: Column) -> Column:
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\x1f"), F.md5(text)))
    return F.conv(F.substring(key, 1, BITS // 4), 16, 10).cast("bigint")


def _directory(rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """(cell, depth, prefix, node_bytes, most) for ``rows`` (h, bytes), and the
    number of leading bits that are the cell."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = min(BITS, max(0, (total // limit).bit_length()) + 4)
    while True:
        cells = rows.groupBy(F.shiftright("h", BITS - bits).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("bytes").alias("most")
        )
        cells = written(cells)
        if bits == BITS or cells.where(f"bytes > {limit} and lo < hi").isEmpty():
            break
        bits = min(BITS, bits + 8)

    # Every prefix of every cell, and the shortest one whose bucket fits.
    path = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    nodes = path.groupBy("depth", "prefix").agg(F.sum("bytes").alias("node_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("most").alias("most"))
    fit = nodes.where(F.col("node_bytes").between(0, limit) | (F.col("lo") == F.col("hi")))
    leaf = path.select("cell", "depth", "prefix").join(fit, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "node_bytes", "most")).alias("leaf"))
    return written(leaf.select("cell", "leaf.*")), bits


def _placed(rows: DataFrame, directory: DataFrame, bits: int, h: str) -> DataFrame:
    """``rows`` with their leaf; the directory is sent out while it is small."""
    leaf = directory.select(*[F.col(c).alias(f"_shard_{c}") for c in directory.columns])
    if directory.count() <= BROADCAST_CELLS:
        leaf = F.broadcast(leaf)
    return rows.join(leaf, F.shiftright(h, BITS - bits) == F.col("_shard_cell")).drop("_shard_cell")


def _paged(rows: DataFrame, limit: int, h: str) -> DataFrame:
    """``rows``, written ones of buckets that no bit splits, with ``_shard_page``,
    numbered by the parts they were written in."""
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("_shard_most"), F.lit(1))))
    page = F.floor(F.col("_shard_n") / per_page).cast("bigint")
    return numbered(rows, [h], ["_shard_part"], "_shard_n").withColumn("_shard_page", page).drop("_shard_n")


def shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, bytes, depth, prefix, page, shard_bytes) per row of ``docs``.

    ``prefix`` is the value of the ``depth`` leading bits. The bytes are those
    of the text in UTF-8 (null: 0); a null id hashes as the empty string. No
    shard is over ``limit`` bytes, unless one row alone is: it then has a shard
    to itself. Rows equal in id and text can't be told apart by hashing, so
    a bucket of nothing else goes on into numbered pages. An empty input gives
    no rows. Only the two named columns are read.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("bytes"), F.md5(text).alias("digest"), _hash(id_col, text).alias("h"))
    rows = written(rows.withColumn("_shard_part", F.spark_partition_id()))
    placed = _placed(rows, *_directory(rows, limit), "h")
    whole = placed.where(F.col("_shard_node_bytes") <= limit).withColumn("_shard_page", F.lit(0).cast("bigint")).withColumn("shard_bytes", F.col("_shard_node_bytes"))
    paged = _paged(placed.where(F.col("_shard_node_bytes") > limit), limit, "h")
    paged = paged.withColumn("shard_bytes", F.sum("bytes").over(W.partitionBy("h", "_shard_page")))
    out = whole.unionByName(paged)
    return out.select("id", "digest", "bytes", F.col("_shard_depth").alias("depth"), F.col("_shard_prefix").alias("prefix"), F.col("_shard_page").alias("page"), "shard_bytes")


def with_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with shard_depth, shard_prefix and shard_page, as ``shards`` has
    them; columns of these names that ``docs`` has already are replaced. Rows
    are placed where they are, without a shuffle of texts while the directory
    is small."""
    if limit < 1:
        raise ValueError("limit must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = docs.drop("shard_depth", "shard_prefix", "shard_page")
    directory, bits = _directory(written(kept.select(_hash(id_col, text).alias("h"), F.octet_length(text).cast("bigint").alias("bytes"))), limit)
    placed = _placed(kept.withColumn("_shard_h", _hash(id_col, text)), directory, bits, "_shard_h")
    one = placed.where(F.col("_shard_node_bytes") <= limit).withColumn("_shard_page", F.lit(0).cast("bigint"))
    if not directory.where(F.col("node_bytes") > limit).isEmpty():
        many = written(placed.where(F.col("_shard_node_bytes") > limit).withColumn("_shard_part", F.spark_partition_id()))
        one = one.unionByName(_paged(many, limit, "_shard_h").drop("_shard_part"))
    return one.select(*[F.col(f"`{c}`") for c in kept.columns], F.col("_shard_depth").alias("shard_depth"), F.col("_shard_prefix").alias("shard_prefix"), F.col("_shard_page").alias("shard_page"))
