"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of characters: five-grams, counted for the class over
whole texts, so that they cross from word to word. Below them are two-grams,
counted by the number of five-grams that end in them whatever the class, which
both classes share; an expression that a class has hardly seen therefore costs
both alike. A five-gram that neither class has seen differs by the weights of
its history only, as what lies below is the same and cancels out.

What is compared is the length-normalised difference of the two log-likelihoods
over a passage of ``WINDOW`` characters. A text is as toxic as its most toxic
passage, every one of the whole text being looked at; a logistic curve of that
one number, a slope and an intercept, makes it a probability. The curve is
fitted on a bounded sample of labelled rows, which are scored by counts that
leave them out; the final counts cover all labelled rows.

Grams are kept exactly, as two numbers of two and three characters. Counts stay
in Spark tables and grow with the corpus. Values go out to the workers while
there are at most ``SENT_GRAMS`` of them, of 20 bytes each; beyond that
documents are cut into chunks, the distinct grams of a chunk are joined to the
values, and come back to it, which gives the same scores.
"""

from __future__ import annotations

import re
import secrets
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import training_rows
from .shared import small_batches, written

TOKEN = re.compile(r"[^\W_]+")
ORDER, WINDOW = 5, 16
DISCOUNT, UNIFORM = 0.75, 1 / 200
#: Labelled rows the curve is fitted on, at most about; a third of them if fewer.
CALIBRATION_ROWS = 6_000
#: Grams whose values are sent out at most; more are joined to chunks.
SENT_GRAMS = 4_000_000
#: Characters looked at in one step; of a chunk; counted before grams are summed.
PIECE, CHUNK_CHARS, COUNT_CHARS = 1 << 18, 4_000_000, 2_000_000
#: Distinct grams a task holds before it hands its counts on.
HELD_GRAMS = 1_500_000
_BEFORE = "\x02" * (ORDER - 1)
_TWO = (1 << 42) - 1


def normal(text: str) -> str:
    """Words in lower case with a space around each; empty without words."""
    words = TOKEN.findall(text.lower())
    return f" {' '.join(words)} " if words else ""


def _pieces(texts: list[str], overlap: int) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of about PIECE characters: numbers of texts, and pieces of them,
    each led by the ORDER - 1 characters before it. A longer text comes in
    several pieces, which share ``overlap`` characters."""
    owners: list[int] = []
    parts: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        padded = _BEFORE + text
        for at in range(0, len(text), PIECE):
            if at and len(text) - at <= overlap:
                break
            part = padded[at : at + PIECE + overlap + ORDER - 1]
            if held and held + len(part) > PIECE:
                yield owners, parts
                owners, parts, held = [], [], 0
            owners.append(i)
            parts.append(part)
            held += len(part)
    if parts:
        yield owners, parts


def _codes(parts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def _grams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first two, last three characters) of the gram that ends at each place
    from the fifth on, 21 bits a character."""
    return c[:-4] << 21 | c[1:-3], c[2:-2] << 42 | c[3:-1] << 21 | c[4:]


class _Counter:
    """Distinct grams of one class of rows and how often they occur. Characters
    have numbers in base 6208, of which five fit in 63 bits."""

    BASE = 6208

    def __init__(self) -> None:
        self._number = np.zeros(0x110000, dtype=np.int64)
        self._chars = np.zeros(1, dtype=np.int64)
        self.keys, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, parts: list[str]) -> Iterator[pa.RecordBatch]:
        """Count the grams of ``parts``; yields what was held before if their
        characters don't fit in beside it."""
        codes = _codes(parts)
        new = np.unique(codes[self._number[codes] == 0])
        if len(self._chars) + len(new) > self.BASE:
            yield from self.out()
            self._number[:] = 0
            self._chars = np.zeros(1, dtype=np.int64)
            new = np.unique(codes)
            if len(new) >= self.BASE:  # halves have fewer; one gram has five at most
                if len(parts) > 1:
                    halves = parts[: len(parts) // 2], parts[len(parts) // 2 :]
                else:
                    mid = len(parts[0]) // 2
                    halves = [parts[0][: mid + ORDER - 1]], [parts[0][mid:]]
                for half in halves:
                    yield from self.add(half)
                return
        self._number[new] = np.arange(len(self._chars), len(self._chars) + len(new))
        self._chars = np.append(self._chars, new)
        n = self._number[codes]
        key = n[: -ORDER + 1].copy()
        for k in range(1, ORDER):
            key *= self.BASE
            key += n[k : len(n) - ORDER + 1 + k]
        whole = np.ones(len(key), dtype=bool)
        for end in np.cumsum([len(p) for p in parts])[:-1]:
            whole[end - ORDER + 1 : end] = False
        keys, counts = np.unique(key[whole], return_counts=True)
        both = np.append(self.keys, keys)
        order = np.argsort(both, kind="stable")
        both = both[order]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, dtype=np.int64)
        self.counts = np.add.reduceat(np.append(self.counts, counts)[order], first) if len(both) else counts
        self.keys = both[first]
        if len(self.keys) > HELD_GRAMS:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if len(self.keys):
            digits, rest = [], self.keys
            for _ in range(ORDER):
                digits.append(self._chars[rest % self.BASE])
                rest = rest // self.BASE
            e, d, c, b, a = digits
            yield pa.RecordBatch.from_arrays([pa.array(a << 21 | b), pa.array(c << 42 | d << 21 | e), pa.array(self.counts)], ["hi", "lo", "n"])
            self.keys, self.counts = self.keys[:0], self.counts[:0]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, y) to (hi, lo, y, n)."""
    counters: dict[int, _Counter] = {}
    waiting: dict[int, list[str]] = defaultdict(list)
    held: dict[int, int] = defaultdict(int)

    def told(y: int, got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(np.full(len(b), y, dtype=np.int32)), b.columns[2]], ["hi", "lo", "y", "n"])

    def counted(y: int) -> Iterator[pa.RecordBatch]:
        counter = counters.setdefault(y, _Counter())
        parts, waiting[y], held[y] = waiting[y], [], 0
        if parts:
            yield from told(y, counter.add(parts))

    for b in batches:
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
            for _, parts in _pieces([normal(text)], 0):
                waiting[y] += parts
                held[y] += sum(map(len, parts))
                if held[y] >= COUNT_CHARS:
                    yield from counted(y)
    for y in list(waiting):
        yield from counted(y)
    for y, counter in counters.items():
        yield from told(y, counter.out())


class Lookup:
    """Values by exact gram, in an open table at most half full."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, value: np.ndarray):
        self.bits = max(4, (2 * len(hi)).bit_length())
        size = 1 << self.bits
        self.hi, self.lo = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
        self.value = np.zeros(size)
        todo, at = np.arange(len(hi)), self._slot(hi, lo)
        while len(todo):
            free = self.hi[at] == -1
            mine = np.full(size, -1, dtype=np.int32)
            mine[at[free]] = todo[free]
            won = np.zeros(len(todo), dtype=bool)
            won[free] = mine[at[free]] == todo[free]
            put, to = todo[won], at[won]
            self.hi[to], self.lo[to], self.value[to] = hi[put], lo[put], value[put]
            todo, at = todo[~won], (at[~won] + 1) & (size - 1)

    def _slot(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        x = hi.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= lo.view(np.uint64)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x >>= np.uint64(64 - self.bits)
        return x.view(np.int64)

    def find(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, whether it is there) of each gram; 0 where it isn't."""
        at = self._slot(hi, lo)
        there = self.hi[at]
        hit = (there == hi) & (self.lo[at] == lo)
        value = np.where(hit, self.value[at], 0.0)
        todo = np.flatnonzero(~hit & (there != -1))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.hi) - 1)
            there = self.hi[at]
            got = (there == hi[todo]) & (self.lo[at] == lo[todo])
            value[todo[got]] = self.value[at[got]]
            hit[todo[got]] = True
            on = ~got & (there != -1)
            todo, at = todo[on], at[on]
        return value, hit


@dataclass
class Values:
    """Columns of a model's two tables as they are sent out."""

    grams: tuple[np.ndarray, np.ndarray, np.ndarray]
    histories: tuple[np.ndarray, np.ndarray, np.ndarray]

    def lookups(self) -> tuple[Lookup, Lookup]:
        if not hasattr(self, "_made"):  # once for each worker
            self._made = Lookup(*self.grams), Lookup(*self.histories)
        return self._made

    def __getstate__(self) -> dict:
        return {"grams": self.grams, "histories": self.histories}

    def at(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        grams, histories = self.lookups()
        value, hit = grams.find(hi, lo)
        rest = np.flatnonzero(~hit)
        value[rest] = histories.find(hi[rest], lo[rest] >> 21)[0]
        return value


def passages(texts: list[str], value) -> list[float | None]:
    """For each normal text the greatest sum of ``value(hi, lo)`` over WINDOW
    characters in a row, by WINDOW; over all of it if shorter; null if empty."""
    best: list[float | None] = [None] * len(texts)
    for owners, parts in _pieces(texts, WINDOW - 1):
        v = value(*_grams(_codes(parts)))
        start = 0
        for i, part in zip(owners, parts, strict=True):
            mine = v[start : start + len(part) - ORDER + 1]
            start += len(part)
            sums = np.cumsum(mine)
            if len(sums) > WINDOW:
                top = max(sums[WINDOW - 1], (sums[WINDOW:] - sums[:-WINDOW]).max())
            else:
                top = sums[-1]
            if best[i] is None or top / WINDOW > best[i]:
                best[i] = float(top / WINDOW)
    return best


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to chunks: ids, normal texts and their distinct grams."""
    ids: list[pa.Array] = []
    texts: list[str] = []
    held = 0

    def out() -> pa.RecordBatch:
        seen = [np.zeros((0, 2), dtype=np.int64)]
        for _, parts in _pieces(texts, 0):
            seen.append(np.unique(np.stack(_grams(_codes(parts)), axis=1), axis=0))
        keys = np.unique(np.concatenate(seen), axis=0)
        lists = [pa.concat_arrays(ids), pa.array(texts, pa.string()), pa.array(keys[:, 0]), pa.array(keys[:, 1])]
        name = pa.array([secrets.randbits(63)], pa.int64())  # random, as chunks are written before anything reads them
        return pa.RecordBatch.from_arrays([name, *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]], ["chunk", "ids", "texts", "hi", "lo"])

    for b in batches:
        begin = 0
        for i, text in enumerate(b.column("text").to_pylist()):
            texts.append(normal(text))
            held += len(texts[-1])
            if held >= CHUNK_CHARS or len(texts) >= 50_000:
                ids.append(b.column("id").slice(begin, i + 1 - begin))
                begin = i + 1
                yield out()
                ids, texts, held = [], [], 0
        if begin < len(b):
            ids.append(b.column("id").slice(begin))
    if texts:
        yield out()


def _chunk_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the values of their grams to (id, difference)."""
    for b in (batch.slice(i, 1) for batch in batches for i in range(len(batch))):
        hi, lo, value, ids, texts = (b.column(c).flatten() for c in ("hi", "lo", "values", "ids", "texts"))
        if len(value) != len(hi):
            raise ValueError("grams without a value")
        table = Lookup(hi.to_numpy(), lo.to_numpy(), value.to_numpy())
        found = passages(texts.to_pylist(), lambda x, y, table=table: table.find(x, y)[0])
        yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.float64())], ["id", "difference"])


@dataclass(frozen=True)
class ToxicityModel:
    """``values`` (hi, lo, value) of seen grams, ``back`` (hi, lo, value) by
    history for the others; ``sent`` are both where they are few enough."""

    values: DataFrame | None
    back: DataFrame | None
    sent: object
    slope: float
    intercept: float
    prior: float

    def differences(self, rows: DataFrame) -> DataFrame:
        """(id, difference) of ``rows`` (id, text): the length-normalised
        log-likelihood ratio of the most toxic passage, null without words."""
        kind = dict(rows.dtypes)["id"]
        schema, sent = f"id {kind}, difference double", self.sent
        if sent is not None:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    found = passages([normal(t) for t in b.column("text").to_pylist()], sent.value.at)
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.float64())], ["id", "difference"])

            return rows.select("id", "text").mapInArrow(run, schema)
        chunks = written(rows.select("id", "text").mapInArrow(_chunks, f"chunk bigint, ids array<{kind}>, texts array<string>, hi array<bigint>, lo array<bigint>"))
        each = chunks.select("chunk", F.posexplode(F.arrays_zip("hi", "lo")).alias("at", "g")).select("chunk", "at", "g.hi", "g.lo")
        known = each.join(self.values, ["hi", "lo"], "left").select("chunk", "at", "hi", (F.shiftright("lo", 21)).alias("lo"), F.col("value").alias("seen"))
        told = known.join(self.back, ["hi", "lo"], "left").select("chunk", F.struct("at", F.coalesce("seen", "value", F.lit(0.0)).alias("value")).alias("v"))
        told = told.groupBy("chunk").agg(F.expr("transform(array_sort(collect_list(v)), x -> x.value)").alias("values"))
        empty = F.expr("cast(array() as array<double>)")
        return chunks.join(told, "chunk", "left").withColumn("values", F.coalesce("values", empty)).mapInArrow(_chunk_scores, schema)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, score) per row. Texts without words, empty and null ones too,
        hold nothing toxic and score 0."""
        small_batches(docs.sparkSession)
        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        if self.values is None:
            return rows.select("id", F.lit(float(self.prior)).alias("score"))
        z = F.col("difference") * float(self.slope) + float(self.intercept)
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(35.0)), F.lit(-35.0))))
        return self.differences(rows).select("id", F.when(F.col("difference").isNull(), 0.0).otherwise(p).alias("score"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[float, float]:
    """Slope and intercept by Newton's method, the slope held back a little."""
    x = np.stack([x, np.ones(len(x))], axis=1)
    w, hold = np.zeros(2), np.array([ridge, 1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(hess, x.T @ (p - y) + hold * w)
        w -= step * min(1.0, 20 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _model(grams: DataFrame, sent_grams: int) -> ToxicityModel:
    """From five-gram counts (hi, lo, a, b), a toxic and b ordinary."""
    grams = grams.where("a + b > 0")
    two = grams.groupBy((F.col("lo").bitwiseAND(F.lit(_TWO))).alias("two")).agg(F.count("*").alias("c"))
    two = written(two.withColumn("one", F.shiftright("two", 21)))
    ones = two.groupBy("one").agg(F.sum("c").alias("n"), F.count("*").alias("t"))
    below = (F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) + DISCOUNT * UNIFORM * F.col("t")) / F.col("n")
    below = two.join(ones, "one").select("two", below.alias("below"))

    history = (F.col("hi"), F.shiftright("lo", 21).alias("before"))
    sums = [F.sum(x).alias(f"n{x}") for x in "ab"] + [F.sum((F.col(x) > 0).cast("bigint")).alias(f"t{x}") for x in "ab"]
    histories = written(grams.groupBy(*history).agg(*sums))
    mine = grams.withColumn("before", history[1]).withColumn("two", F.col("lo").bitwiseAND(F.lit(_TWO)))
    mine = mine.join(histories, ["hi", "before"]).join(below, "two")
    p, rest = {}, {}
    for x in "ab":
        kept = F.greatest(F.col(x) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"t{x}") * F.col("below")
        p[x] = F.log(F.when(F.col(f"n{x}") > 0, kept / F.col(f"n{x}")).otherwise(F.col("below")))
        rest[x] = F.log(F.when(F.col(f"n{x}") > 0, DISCOUNT * F.col(f"t{x}") / F.col(f"n{x}")).otherwise(1.0))
    values = written(mine.select("hi", "lo", (p["a"] - p["b"]).alias("value")))
    back = written(histories.select("hi", F.col("before").alias("lo"), (rest["a"] - rest["b"]).alias("value")))
    sent = None
    if values.count() <= sent_grams:  # histories are fewer still
        cols = [tuple(t.column(c).to_numpy() for c in ("hi", "lo", "value")) for t in (values.toArrow(), back.toArrow())]
        sent = grams.sparkSession.sparkContext.broadcast(Values(*cols))
    return ToxicityModel(values, back, sent, 1.0, 0.0, 0.0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sent_grams: int = SENT_GRAMS) -> ToxicityModel:
    """Count and calibrate. Without labelled rows of both classes, or if toxic
    ones don't stand out, every score is the share of toxic rows (0 of none)."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, label, id_col, text_col)
    n, toxic = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or not 0 < toxic < n:
        return ToxicityModel(None, None, None, 0.0, 0.0, float(toxic or 0) / max(n, 1))
    share = min(1 / 3, CALIBRATION_ROWS / n)
    picked = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    found = rows.select("text", (F.col("y") + F.when(picked, 2).otherwise(0)).cast("int").alias("y")).mapInArrow(_gram_counts, "hi bigint, lo bigint, y int, n bigint")
    of = lambda *ys: F.sum(F.when(F.col("y").isin(*ys), F.col("n")).otherwise(0))
    grams = written(found.groupBy("hi", "lo").agg(of(1).alias("tox"), of(0).alias("plain"), of(1, 3).alias("all_tox"), of(0, 2).alias("all_plain")))

    first = _model(grams.select("hi", "lo", F.col("tox").alias("a"), F.col("plain").alias("b")), sent_grams)
    told = first.differences(rows.where(picked).select(F.col("y").alias("id"), "text")).where("difference is not null").toArrow()
    y, x = told.column("id").to_numpy(), told.column("difference").to_numpy()
    slope, intercept = logistic(x, y) if len(y) and 0 < y.sum() < len(y) else (0.0, 0.0)
    if slope <= 0:
        return ToxicityModel(None, None, None, 0.0, 0.0, toxic / n)
    last = _model(grams.select("hi", "lo", F.col("all_tox").alias("a"), F.col("all_plain").alias("b")), sent_grams)
    return ToxicityModel(last.values, last.back, last.sent, slope, intercept, toxic / n)
