"""Near-duplicate documents by one-permutation MinHash.

A document's set is its distinct ``k``-word shingles. One permutation of the
hash space is cut into bins, the least hash of each bin is the signature, and
an empty bin borrows from the first filled bin of its own fixed random order
(optimal densification). Bands of the signature are buckets. In each bucket
every set is compared with one centre only, so candidate edges stay linear in
the bucket; links are confirmed on full sets.

A star can miss a link between two sets that are both unlike their centre.
Buckets whose members are still in several components after the stars are
therefore searched through in blocks of bounded size, which give at most one
link per member: no list of all pairs is made anywhere, and no link that a
shared bucket shows is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import _mix, shingle_sets, small_batches, written

BANDS, ROWS = 32, 4
#: Sets of one bucket that are compared in one step, and their shingles; larger
#: buckets are split.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Texts to fetch whose keys are broadcast at most; more are shuffled.
BROADCAST_KEYS = 500_000


def _orders(bins: int) -> np.ndarray:
    rng = np.random.default_rng(20240229)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


_ORDERS = _orders(BANDS * ROWS)
_BOUNDS = np.array([i * (1 << 64) // (BANDS * ROWS) for i in range(BANDS * ROWS)], dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature of a sorted, non-empty hash set."""
    first = np.searchsorted(shingles, _BOUNDS)
    filled = first < np.append(first[1:], len(shingles))
    sig = shingles[np.minimum(first, len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _ORDERS[empty]
        sig[empty] = sig[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return sig


def _bands(sigs: np.ndarray) -> np.ndarray:
    """Bucket keys, one row of BANDS per signature."""
    cut = sigs.reshape(len(sigs), BANDS, ROWS)
    key = np.zeros(cut.shape[:2], dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9FB21C651E98DF25) + cut[:, :, r])
    return key.view(np.int64)


def _set_id(s: np.ndarray) -> bytes:
    """128-bit digest of a set: equal for equal sets only, but for chance."""
    one, two = _mix(s ^ np.uint64(0x2545F4914F6CDD1D)), _mix(s * np.uint64(0xD1342543DE82EF95))
    return np.array([one.sum(), two.sum() + np.uint64(len(s))], dtype=np.uint64).tobytes()


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            some = [s for s in sets if len(s)]
            keys = iter(_bands(np.stack([signature(s) for s in some]))) if some else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("text_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_set_id(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["id", "text_key", "n_shingles", "set_id", "bands"],
            )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in shingle_sets(batch.column("text").to_pylist(), k) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_set_id(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["set_id", "shingles"],
            )

    return run


def spanning_links(sets: list[np.ndarray], part: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different parts that join all parts which any link
    joins, one fewer than the sets at most. Compared are pairs whose ``side``
    differs, or all when there is one side."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    fresh = np.append(True, flat[1:] != flat[:-1])
    token = np.cumsum(fresh) - 1
    common = np.bincount(token)[token] > 1
    row, token = row[common], token[common]
    shared = np.zeros((n, n), dtype=np.float32)
    at, width = 0, 4096
    while at < len(token):
        to = np.searchsorted(token, token[at] + width)
        grid = np.zeros((n, width), dtype=np.float32)
        grid[row[at:to], token[at:to] - token[at]] = 1
        shared += grid @ grid.T
        at = to
    both = shared.astype(np.int64)
    ok = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    ok &= np.arange(n)[:, None] < np.arange(n)[None, :]
    if len(np.unique(side)) > 1:
        ok &= side[:, None] != side[None, :]
    ok &= part[:, None] != part[None, :]
    top = {p: p for p in np.unique(part).tolist()}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for i, j in np.argwhere(ok).tolist():
        p, q = find(int(part[i])), find(int(part[j]))
        if p != q:
            top[p] = q
            out.append((i, j))
    return out


def _search(percent: int):
    """Rows (block, side, set_id, part, shingles) sorted by block to links."""

    def one(block: list[tuple]) -> list[tuple[bytes, bytes]]:
        _, part = np.unique(np.array([r[1] for r in block], dtype=object), return_inverse=True)
        if part.max() == 0:
            return []
        got = spanning_links([r[3] for r in block], part, np.array([r[2] for r in block]), percent)
        return [(block[i][0], block[j][0]) for i, j in got]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        at = None
        found: list[tuple[bytes, bytes]] = []
        for batch in batches:
            sets = batch.column("shingles")
            flat, cut = sets.values.to_numpy(), sets.offsets.to_numpy()
            rest = zip(*(batch.column(c).to_pylist() for c in ("block", "set_id", "part", "side")), strict=True)
            for i, (key, set_id, part, side) in enumerate(rest):
                if key != at:
                    found += one(block) if block else []
                    block, at = [], key
                block.append((set_id, part, side, flat[cut[i] : cut[i + 1]].copy()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], ["a", "b"])
                found = []
        if block and (found := one(block)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, set_id, component_id, kept).

    Sets link when 100 * intersection >= percent * union. ``component_id`` is
    the least id over all documents reachable; ``kept`` is true where it is the
    row's own id. A null or empty text, or one without words, has the empty set
    and is alone with its own id. Rows with a null id take part; the null is
    never a component id unless all ids of a component are null, where kept is
    null. Repeated rows each get a row. Other columns of ``docs`` aren't read.

    Recall: two sets with Jaccard similarity 0.8 share none of the 32 bands of
    4 rows with a chance of about 5e-8.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    kind = dict(texts.dtypes)["id"]
    rows = written(texts.mapInArrow(_sketches(shingle), f"id {kind}, text_key bigint, n_shingles bigint, set_id binary, bands array<bigint>"))

    # One representative of each distinct set; copies go no further.
    distinct = rows.where("set_id is not null").groupBy("set_id").agg(
        F.min("id").alias("least_id"), F.min(F.struct("id", "text_key")).alias("one"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    distinct = written(distinct)
    spread = distinct.select("set_id", "n", F.explode("bands").alias("bucket"))
    # Buckets that more than one set falls in, each with its centre.
    centres = spread.groupBy("bucket").agg(F.min("set_id").alias("centre"), F.count("*").alias("members"), F.sum("n").alias("total"), F.sum(F.xxhash64("set_id").bitwiseXOR(F.lit(77)) % F.lit(1 << 40)).alias("print")).where("members > 1")
    # The same group meets in many bands: once is enough.
    centres = centres.groupBy("centre", "members", "total", "print").agg(F.min("bucket").alias("bucket"))
    members = written(spread.join(centres, "bucket").select("bucket", "members", "total", "set_id", "n", "centre"))
    stars = members.where("set_id != centre").select("set_id", "centre").distinct()

    # One row of each set is read again: by text and id, so that copies of a text
    # don't gather anywhere.
    wanted = written(members.select("set_id").distinct().join(distinct.select("set_id", "one"), "set_id").select(F.col("one.id").alias("k_id"), F.col("one.text_key").alias("k_text")))
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    picked = texts.join(wanted, (F.col("text_key") == F.col("k_text")) & F.col("id").eqNullSafe(F.col("k_id")), "left_semi").dropDuplicates(["text_key", "id"])
    sets = written(picked.select("text").mapInArrow(_full_sets(shingle), "set_id binary, shingles array<bigint>"))

    sized = stars.join(sets.select("set_id", "shingles"), "set_id")
    sized = sized.join(sets.select(F.col("set_id").alias("centre"), F.col("shingles").alias("others")), "centre")
    both = sized.select("set_id", "centre", F.size("shingles").alias("x"), F.size("others").alias("y"), F.size(F.array_intersect("shingles", "others")).alias("both"))
    agrees = F.col("both") * 100 >= (F.col("x") + F.col("y") - F.col("both")) * percent
    links = written(both.where(agrees).select(F.col("set_id").alias("a"), F.col("centre").alias("b")))
    parts = components(links, F.col("a"), F.col("b"))

    # Buckets that stars left in several parts.
    known = members.join(parts.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "bucket", "members", "total", "set_id", F.coalesce("component", "set_id").alias("part")
    )
    open_ = known.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").select("bucket")
    todo = known.join(open_, "bucket").where("members > 2")  # of two, the star saw the only pair
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    todo = todo.withColumn("own", F.pmod(F.hash("set_id"), blocks)).withColumn("blocks", blocks)
    dealt = todo.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("block"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "set_id", "part",
    )
    dealt = dealt.join(sets, "set_id").repartition("block").sortWithinPartitions("block")
    more = dealt.select("block", "side", "set_id", "part", "shingles").mapInArrow(_search(percent), "a binary, b binary")
    parts = components(links.unionByName(more), F.col("a"), F.col("b"))

    # The least id of each component, then back to the rows by set.
    class_ids = distinct.select("set_id", "least_id").join(parts.withColumnRenamed("node", "set_id"), "set_id", "left")
    class_ids = class_ids.select("set_id", "least_id", F.coalesce("component", "set_id").alias("component"))
    least = class_ids.groupBy("component").agg(F.min("least_id").alias("component_id"))
    class_ids = class_ids.join(least, "component").select("set_id", "component_id")
    out = rows.select("id", "n_shingles", "set_id").join(class_ids, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "n_shingles", "set_id", component.alias("component_id"), (F.col("id") == component).alias("kept"))
