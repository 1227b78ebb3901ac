"""What several of the training-data operators share: cutting lineage, word sets.

Words are maximal runs of characters other than space and the control
characters tab to carriage return, after lower-casing A-Z only.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session may do without: it gets a temporary folder, which is
    recorded in the session so that later calls use the same one.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tideloom-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends
    there, and a lost executor costs a re-read rather than a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written or collected inside leaves no shuffle files, which else stay on the
    executors' disks until the driver forgets them. A frame that is made inside
    and run twice would shuffle twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def numbered(rows: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """``rows`` with their number from 0 within ``by``, in ``order``, which must
    tell many parts of a large group apart and be the same whenever it is read.
    Rows are numbered within their part, and a part begins where those before
    it end, so that no task has all rows of a group."""
    keys = [*by, *order]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n_part"))
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"_n_{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n_part").over(before), F.lit(0)).alias("_n_start"))
    mine = W.partitionBy(*keys).orderBy(F.lit(0))
    same = [F.col(k).eqNullSafe(F.col(f"_n_{i}")) for i, k in enumerate(keys)]
    joined = rows.withColumn("_n_row", F.row_number().over(mine) - 1).join(starts, same)
    return joined.withColumn(out, F.col("_n_row") + F.col("_n_start")).drop("_n_row", "_n_start", *[f"_n_{i}" for i in range(len(keys))])


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place of a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE = _BYTE[_FOLD]  # A-Z hash as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E6C63D0876A9A35 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = np.ones(size, dtype=np.uint64)
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            out[done : 2 * done] = out[:done] * step
            done *= 2
        _POWERS[base] = got = out
    return got[:n]


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of ``data``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * powers(_BASE, len(raw)), out=sums[1:])
    word = (sums[end] - sums[start]) * powers(_BASE_INV, len(raw))[start]
    return _mix(word + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def word_hashes(texts: list[str | None], piece: int = 1 << 20) -> list[np.ndarray]:
    """64-bit hash of every word of each text, in order.

    Texts are packed into buffers of about ``piece`` bytes; a longer one is
    cut at white space, so scratch memory doesn't follow its length unless
    it is a single enormous word.
    """
    out: list[np.ndarray] = []
    pack: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal pack, size
        if pack:
            words, start = _hashed(b"\n".join(pack))
            ends = np.cumsum([len(p) + 1 for p in pack])
            out.extend(np.split(words, np.searchsorted(start, ends[:-1])))
            pack, size = [], 0

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > piece:
            flush()
            parts, at = [], 0
            while at < len(data):
                to = min(at + piece, len(data))
                while to < len(data) and data[to] not in b" \t\n\x0b\x0c\r":
                    to += 1
                parts.append(_hashed(data[at:to])[0])
                at = to
            out.append(np.concatenate(parts))
            continue
        pack.append(data)
        size += len(data)
        if size >= piece:
            flush()
    flush()
    return out


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; fewer than
    k words count as one shingle, none as the empty set."""
    out = []
    step = np.uint64(0xA0761D6478BD642F)
    for words in word_hashes(texts):
        n = min(k, len(words))
        if not n:
            out.append(words)
            continue
        h = words[: len(words) - n + 1].copy()
        for j in range(1, n):
            h *= step
            h += words[j : len(words) - n + 1 + j]
        h += np.uint64(n)
        out.append(np.unique(_mix(h)))
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel to Python in Arrow batches of at most ``rows`` rows,
    so that a run of very long ones doesn't fill a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
