"""Repeated passages, by a run-length Burrows-Wheeler index.

A string of ``length`` bytes that starts at two places of the corpus marks all
its bytes, at both. The work is dealt out so that equal strings meet: every
window of ``length`` bytes belongs to its minimizer, the leftmost k-gram of
least hash in it, and consecutive windows of one minimizer make a segment.
Minimizers that occur once can't lie in a repeated window and go no further;
equal segments of one minimizer are repeated as a whole. The remaining segments
of a minimizer differ and may share some windows. For these an index is built
per block of bounded size: suffixes are sorted, the Burrows-Wheeler transform is
kept as runs, with the suffix and the common prefix at both ends of each run,
and from those samples the length of every position's longest match elsewhere
is streamed in text order, since inside a run a match only loses a character a
step. A minimizer with too many segments for one block has several; what is
unmatched within a block is then compared across blocks by fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import _mix, powers, small_batches, written

#: Bytes of a minimizer's k-gram; bytes scanned at a time; bytes of a block. Small
#: blocks share an index, which a quarter of that fills.
GRAM, PIECE, INDEX_BYTES = 40, 1 << 19, 2_000_000
#: Keys of texts to fetch that are broadcast at most; more are shuffled.
BROADCAST_KEYS = 1_000_000
_RAW = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_BASE = 0xD6E8FEB86659FD93 | 1
_INV = pow(_BASE, -1, 1 << 64)


def _sums(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_RAW[raw] * powers(_BASE, len(raw)), out=out[1:])
    return out


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row, in linear time."""
    n = len(x) - w + 1
    pad = -len(x) % w
    grid = np.append(x, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def segments(raw: np.ndarray, doc: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segments of the documents laid end to end in ``raw``: (minimizer hash,
    segment hash, first byte, bytes). ``doc`` numbers the document of each byte
    and ``ends`` has their ends; windows that cross one don't count."""
    none = np.zeros(0, dtype=np.uint64)
    if len(raw) < length:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    gram = min(GRAM, length)
    w = length - gram + 1
    sums, inv = _sums(raw), powers(_INV, len(raw))
    grams = _mix((sums[gram:] - sums[:-gram]) * inv[: len(raw) - gram + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    low = _window_min((grams & ~np.uint64((1 << 20) - 1)) | place, w)  # leftmost of equals
    at = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
    start = np.arange(len(at))
    ok = ends[doc[start]] - start >= length
    start, at = start[ok], at[ok]
    if not len(start):
        return none, none, none.astype(np.int64), none.astype(np.int64)
    cut = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)))
    first, last = start[cut], start[np.append(cut[1:], len(start)) - 1]
    size = last - first + length
    whole = (sums[first + size] - sums[first]) * inv[first]
    shape = size.astype(np.uint64) * np.uint64(4099) + (at[cut] - first).astype(np.uint64)
    return grams[at[cut]], _mix(whole + _mix(shape)), first, size


def matches(segs: list[bytes], length: int) -> list[np.ndarray]:
    """For each string the starts of its windows of ``length`` bytes that start
    anywhere else in the strings too, from a run-length BWT of them all."""
    sizes = np.array([len(s) + 1 for s in segs])
    if sizes.max(initial=0) <= length:
        return [np.zeros(0, dtype=np.int64) for _ in segs]
    ends = np.cumsum(sizes) - 1  # places of the separators
    n = int(sizes.sum())
    text = np.zeros(n, dtype=np.int64)
    inside = np.ones(n, dtype=bool)
    inside[ends] = False
    text[inside] = np.frombuffer(b"".join(segs), dtype=np.uint8).astype(np.int64) + 1
    left = np.repeat(ends, sizes) - np.arange(n)  # bytes up to the separator
    # Suffix order by prefix doubling; a suffix ends at its separator, and
    # separators differ, by place.
    levels = []
    span = 7
    key = np.zeros(n, dtype=np.int64)
    for j in range(span):
        c = np.zeros(n, dtype=np.int64)
        c[: n - j] = text[j:]
        key = key * 257 + np.where(left >= j, c, 0)
    order = np.argsort(key)
    sorted_key = key[order]
    fresh = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
    # A rank is the place in the order where its group of equals begins; only
    # places in groups of several are sorted again.
    sizes_of = np.diff(np.append(fresh, n))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(fresh, sizes_of)
    todo = order[np.repeat(sizes_of > 1, sizes_of)]
    while True:
        levels.append((span, rank.astype(np.int32)))
        todo = todo[left[todo] >= span]  # the rest end within: equal for good
        if not len(todo):
            break
        key = rank[todo] * (n + 1) + np.where(todo + span < n, rank[np.minimum(todo + span, n - 1)] + 1, 0)
        by = np.argsort(key)
        todo, key = todo[by], key[by]
        group = key // (n + 1)
        new = np.append(True, key[1:] != key[:-1])
        whole = np.append(True, group[1:] != group[:-1])
        at = np.arange(len(todo))
        # Those that ended within come first in their group.
        members = np.diff(np.append(np.flatnonzero(whole), len(todo)))
        total = np.bincount(rank, minlength=n)[group[whole]]
        start = np.repeat(group[whole] + total - members - at[whole], members)
        first = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[todo] = start + first
        runs = np.diff(np.append(np.flatnonzero(new), len(todo)))
        todo = todo[np.repeat(runs > 1, runs)]
        span *= 2
    order = np.argsort(rank * n + np.arange(n))  # equal to the separator: by place
    # The transform in runs, and at each border the common prefix of the two
    # suffixes that meet there: the samples at the end and start of runs.
    bwt = text[order - 1]
    bwt[bwt == 0] = -1 - np.arange((bwt == 0).sum())  # separators all differ
    starts = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
    a, b = order[starts[1:] - 1], order[starts[1:]]
    common = np.zeros(len(a), dtype=np.int64)
    for size, r in reversed(levels):
        for _ in range(2 if size == levels[-1][0] else 1):
            x, y = a + common, b + common
            same = (x < n) & (y < n)
            same[same] = r[x[same]] == r[y[same]]
            common[same] += size
    for _ in range(7):
        x, y = a + common, b + common
        same = (x < n) & (y < n)
        same[same] = (text[x[same]] == text[y[same]]) & (text[x[same]] > 0)
        common[same] += 1
    common = np.minimum(common, np.minimum(left[a], left[b]))

    def streamed(samples: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Match length at every place from those at run borders."""
        base = np.full(n, -1, dtype=np.int64)
        base[samples] = samples + lengths
        seen = np.maximum.accumulate(np.where(base >= 0, np.arange(n), -1))
        return np.where(seen >= 0, base[np.maximum(seen, 0)] - np.arange(n), 0)

    before = streamed(np.append(order[0], b), np.append(0, common))
    after = streamed(np.append(a, order[-1]), np.append(common, 0))
    hit = np.flatnonzero(np.minimum(np.maximum(before, after), left) >= length)
    origin = ends - sizes + 1
    return [h - o for h, o in zip(np.split(hit, np.searchsorted(hit, ends[:-1])), origin, strict=True)]


def _spread(starts: np.ndarray, length: int) -> list[int]:
    """Window starts to disjoint ranges, as from, to, from, to ..."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    lo, hi = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + length
    return np.stack([lo, hi], axis=1).ravel().tolist()


def _scan(length: int):
    """(text key, minimizer, segment, start, size) of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: list[int], parts: list[bytes], offsets: list[int]) -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
            sizes = np.array([len(p) for p in parts])
            ends = np.cumsum(sizes)
            doc = np.repeat(np.arange(len(parts)), sizes)
            low, whole, first, size = segments(raw, doc, ends, length)
            owner = doc[first] if len(first) else first
            start = first - (ends - sizes)[owner] + np.array(offsets)[owner] if len(first) else first
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, dtype=np.int64)[owner] if len(first) else [], pa.int64()), pa.array(low.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(start, pa.int32()), pa.array(size, pa.int32())],
                ["key", "low", "segment", "start", "size"],
            )

        keys, parts, offsets, held = [], [], [], 0
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for at in range(0, max(1, len(data) - length + 1), PIECE):
                    part = data[at : at + PIECE + length - 1]
                    if held + len(part) > 2 * PIECE - length and parts:
                        yield out(keys, parts, offsets)
                        keys, parts, offsets, held = [], [], [], 0
                    keys.append(key)
                    parts.append(part)
                    offsets.append(at)
                    held += len(part)
        if parts:
            yield out(keys, parts, offsets)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted segments of each text."""
    for b in batches:
        lows, segs, alone, datas = [], [], [], []
        for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                lows.append(w["low"])
                segs.append(w["segment"])
                alone.append(w["alone"])
                datas.append(data[w["start"] : w["start"] + w["size"]])
        yield pa.RecordBatch.from_arrays([pa.array(lows, pa.int64()), pa.array(segs, pa.int64()), pa.array(alone, pa.bool_()), pa.array(datas, pa.binary())], ["low", "segment", "alone", "data"])


def _indexed(length: int):
    """Rows sorted by block to (low, segment, ranges) of matches within it, and
    for minimizers with several blocks fingerprints of windows: unmatched ones
    with their place, and one of each kind that is matched."""
    schema = ["low", "segment", "ranges", "window", "at"]

    def one(rows: list[tuple]) -> pa.RecordBatch:
        found = matches([r[3] for r in rows], length)
        out: list[tuple] = []
        told: set[tuple[int, int]] = set()
        for (low, segment, alone, data, split), starts in zip(rows, found, strict=True):
            if alone and len(starts):
                out.append((low, segment, _spread(starts, length), None, None))
            if split:
                raw = np.frombuffer(data, dtype=np.uint8)
                sums = _sums(raw)
                n = len(data) - length + 1
                prints = _mix((sums[length:] - sums[:-length]) * powers(_INV, len(raw))[:n]).view(np.int64).tolist()
                matched = set(starts.tolist())
                for i, p in enumerate(prints):
                    if i not in matched:
                        out.append((low, segment if alone else None, None, p, i))
                    elif (low, p) not in told:
                        told.add((low, p))
                        out.append((low, None, None, p, None))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("low", "segment", "alone", "data", "split", "block")), strict=True):
                if r[5] != last and held >= INDEX_BYTES // 4:  # whole blocks only
                    yield one(rows)
                    rows, held = [], 0
                last = r[5]
                rows.append(r[:5])
                held += len(r[3])
        if rows:
            yield one(rows)

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, ranges in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            kept, at, gone, spans, digest = [], 0, 0, [], hashlib.sha256()
            for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                kept.append(data[at:lo])
                at, gone = hi, gone + hi - lo
            kept.append(data[at:])
            for k in kept:
                digest.update(k)
            out.append((gone, len(spans), digest.hexdigest(), [x for s in spans for x in s]))
        gone, n, sha, spans = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), b.column("n_bytes"), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.int64()))],
            ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def repeated_passages(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) per row of ``docs``.

    ``spans`` has the removed ranges as from, to, from, to ... in bytes of the
    UTF-8 text, to exclusive, without touching ones. A null text is empty, and
    texts under ``length`` bytes lose nothing. Repeated rows count as places of
    their own, so a text that occurs twice goes entirely. Null ids are kept.
    Texts are told apart by a 64-bit hash and their length; other columns
    aren't read.
    """
    if not 8 <= length <= 1 << 19:
        raise ValueError("length must be from 8 bytes to half a megabyte")
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("n_bytes", F.octet_length("text").cast("bigint")).withColumn("key", F.xxhash64("text", "n_bytes"))
    rows = written(base.select("id", "key", "n_bytes", F.sha2("text", 256).alias("whole")))
    texts = rows.groupBy("key", "n_bytes").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    long_ = base.where(F.col("n_bytes") >= length)

    occurrences = written(long_.select("key", "text").mapInArrow(_scan(length), "key bigint, low bigint, segment bigint, start int, size int"))
    # Written, so that the join reads plain tables and a hot minimizer's side is split.
    often = written(occurrences.groupBy("low").agg(F.count("*").alias("n")).where("n > 1").select("low"))
    near = written(occurrences.join(often, "low"))
    kinds = near.groupBy("low", "segment").agg(F.count("*").alias("n"), F.min(F.struct("key", "start", "size")).alias("place"))
    kinds = written(kinds.select("low", "segment", (F.col("n") == 1).alias("alone"), "place.*"))

    # Segments that occur twice: repeated as a whole.
    twice = near.join(kinds.where("not alone").select("low", "segment"), ["low", "segment"])
    marks = twice.select("key", F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi")).distinct()

    # Segments that occur once beside others of their minimizer: to the index.
    mixed = kinds.groupBy("low").agg(F.count("*").alias("n"), F.max(F.col("alone").cast("int")).alias("some"), F.sum("size").alias("bytes")).where("n > 1 and some = 1")
    mixed = written(mixed)
    wanted = written(kinds.join(mixed.select("low", "bytes"), "low"))
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("low", "segment", "alone", "start", "size")).alias("wanted"))

    def with_text(keys: DataFrame) -> DataFrame:
        """One row a text; copies of it aren't read along."""
        keys = written(keys)
        some = keys.join(texts.select("key", "n_bytes", "first"), "key")
        if keys.count() <= BROADCAST_KEYS:
            some = F.broadcast(some.select("key", "n_bytes", "first"))
        pick = some.select(F.col("key").alias("k"), F.col("n_bytes").alias("b"), "first")
        hit = base.join(pick, (F.col("key") == F.col("k")) & (F.col("n_bytes") == F.col("b")) & F.col("id").eqNullSafe(F.col("first")))
        return hit.select("key", "n_bytes", "text").join(keys, "key").dropDuplicates(["key", "n_bytes"])

    cut = with_text(lists).select("text", "wanted").mapInArrow(_cut, "low bigint, segment bigint, alone boolean, data binary")
    blocks = F.ceil(F.col("bytes") / INDEX_BYTES)
    sized = mixed.select("low", blocks.alias("blocks"))
    dealt = cut.join(sized, "low").withColumn("block", F.xxhash64("low", F.pmod(F.col("segment"), F.col("blocks")))).withColumn("split", F.col("blocks") > 1)
    dealt = dealt.select("low", "segment", "alone", "data", "split", "block").repartition("block").sortWithinPartitions("block")
    found = written(dealt.mapInArrow(_indexed(length), "low bigint, segment bigint, ranges array<int>, window bigint, at int"))
    inner = found.where("ranges is not null").select("low", "segment", F.explode(F.transform(F.sequence(F.lit(0), F.size("ranges") - 1, F.lit(2)), lambda i: F.struct(F.get("ranges", i).alias("lo"), F.get("ranges", i + 1).alias("hi")))).alias("r")).select("low", "segment", "r.lo", "r.hi")
    prints = found.where("window is not null")
    across = prints.groupBy("low", "window").agg(F.count("*").alias("n")).where("n > 1").select("low", "window")
    outer = prints.where("segment is not null").join(across, ["low", "window"]).select("low", "segment", F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))
    singles = wanted.where("alone").select("low", "segment", "key", "start")
    spots = inner.unionByName(outer).join(singles, ["low", "segment"]).select("key", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))

    # A text that occurs twice needs no marks of its own.
    copied = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("key", "n_bytes", "copies")
    lists = marks.unionByName(spots).join(copied.select("key"), "key", "left_anti").groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    some = with_text(lists).select("key", "n_bytes", "text", "ranges").mapInArrow(_removed, "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>")
    # What becomes of a text, in one small table: a single join, which is split where a text has very many copies.
    nothing = F.sha2(F.lit(""), 256)
    gone = copied.select("key", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), nothing.alias("kept_sha256"), F.array(F.lit(0).cast("bigint"), F.col("n_bytes")).alias("spans"))
    out = rows.join(written(some.unionByName(gone)), ["key", "n_bytes"], "left")
    return out.select(
        "id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"), F.coalesce("spans", F.expr("cast(array() as array<bigint>)")).alias("spans"),
    )
