"""Document quality by supervised subword embeddings.

A token's vector is the mean of learned hashed vectors: of the token, of its
character three- to five-grams and of the pair it makes with the token before.
A document is the mean of its tokens' vectors and a softmax over the classes
reads it. The model is trained by stochastic gradient descent in numpy on a
bounded sample of labelled documents; scoring runs over whole texts in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import training_rows
from .shared import _mix, powers, small_batches

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
BUCKETS, WIDTH = 1 << 17, 8
#: Labelled documents the model is fitted on, at most, and passes over them.
FIT_ROWS, EPOCHS = 6000, 4
#: Characters that are hashed at a time; a longer token is taken in pieces.
PIECE = 1 << 18
#: Longer tokens aren't kept from one text to the next.
CACHED_CHARS = 200
_BASE = 0xC2B2AE3D27D4EB4F


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _groups(tokens: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of tokens of at most PIECE characters, or one longer token, and
    where each run begins."""
    lo = held = 0
    for i, t in enumerate(tokens):
        if held and held + len(t) + 2 > PIECE:
            yield lo, tokens[lo:i]
            lo, held = i, 0
        held += len(t) + 2
    if tokens:
        yield lo, tokens[lo:]


def gram_groups(tokens: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, token number) as of ``token_grams``, in parts of bounded size."""
    for lo, some in _groups(tokens):
        if len(some) > 1 or len(some[0]) + 2 <= PIECE:
            bucket, owner = token_grams(some)
            yield bucket, owner + lo
        else:
            for bucket in _long_grams(some[0]):
                yield bucket, np.full(len(bucket), lo)


def _long_grams(token: str) -> Iterator[np.ndarray]:
    """Buckets of one token of any length; pieces overlap by four characters."""
    text, whole = f"<{token}>", np.zeros(1, dtype=np.uint64)
    w = powers(_BASE, 8)
    for lo in range(0, len(text), PIECE):
        codes = _codes(text[lo : lo + PIECE + 4]) + np.uint64(1)
        for n in (3, 4, 5):
            size = min(PIECE, len(codes) - n + 1)
            if size > 0:
                h = np.zeros(size, dtype=np.uint64)
                for k in range(n):
                    h += codes[k : k + size] * w[k]
                yield (_mix(h + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64)
        mine = codes[:PIECE]
        place = np.arange(lo, lo + len(mine)).astype(np.uint64)
        whole += _mix(mine * np.uint64(31) + place * np.uint64(_BASE)).sum()
    yield (_mix(whole + np.uint64(len(token))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def token_grams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, token number) of the whole token and each character gram."""
    flat = "".join(f"<{t}>" for t in tokens)
    codes = _codes(flat) + np.uint64(1)
    lengths = np.array([len(t) + 2 for t in tokens])
    owner = np.repeat(np.arange(len(tokens)), lengths)
    w = powers(_BASE, 8)
    buckets, owners = [], []
    for n in (3, 4, 5):
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, dtype=np.uint64)
        for k in range(n):
            h += codes[k : len(codes) - n + 1 + k] * w[k]
        same = owner[: len(h)] == owner[n - 1 :]
        buckets.append(_mix(h[same] + np.uint64(n)))
        owners.append(owner[: len(h)][same])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(codes)) - starts[owner]
    whole = np.add.reduceat(_mix(codes * np.uint64(31) + place.astype(np.uint64) * np.uint64(_BASE)), starts)
    whole += np.array([len(t) for t in tokens], dtype=np.uint64)
    buckets.append(_mix(whole))
    owners.append(np.arange(len(tokens)))
    return (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(owners)


def pair_bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bucket of two tokens in a row, from their numbers in hash space. A token
    after itself has one bucket whatever it is, so repetition is learned once."""
    pair = (_mix(a * np.uint64(0x9E3779B97F4A7C15) + b) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return np.where(a == b, 0, pair)


def _token_hash(tokens: list[str]) -> np.ndarray:
    out = np.zeros(len(tokens), dtype=np.uint64)
    for lo, some in _groups(tokens):
        if len(some) == 1:
            for at in range(0, len(some[0]), PIECE):
                codes = _codes(some[0][at : at + PIECE]) + np.uint64(7)
                place = np.arange(at, at + len(codes)).astype(np.uint64)
                out[lo : lo + 1] += _mix(codes + place * np.uint64(0xD1342543DE82EF95)).sum()
            continue
        codes = _codes("".join(some)) + np.uint64(7)
        lengths = np.array([len(t) for t in some])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        out[lo : lo + len(some)] = np.add.reduceat(_mix(codes + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), starts)
    return out


@dataclass(frozen=True)
class QualityModel:
    """Per hash bucket the log-odds its vector adds; vectors and softmax are
    linear, so their product is all that scoring needs."""

    odds: np.ndarray | None
    bias: float
    prior: float

    def _logit(self, text: str, cache: dict[str, tuple[float, int, int]]) -> float:
        tokens = TOKEN.findall(text)
        if not tokens:
            return self.bias
        new = [t for t in dict.fromkeys(tokens) if t not in cache]
        if new:
            sums, counts = np.zeros(len(new)), np.zeros(len(new), dtype=np.int64)
            for bucket, owner in gram_groups(new):
                first = int(owner.min())
                part = np.bincount(owner - first, weights=self.odds[bucket])
                sums[first : first + len(part)] += part
                counts[first : first + len(part)] += np.bincount(owner - first)
            cache.update(zip(new, zip(sums.tolist(), counts.tolist(), _token_hash(new).tolist(), strict=True), strict=True))
        got = [cache[t] for t in tokens]
        for t in new:
            if len(t) > CACHED_CHARS:
                del cache[t]
        sums = np.array([g[0] for g in got])
        counts = np.array([g[1] for g in got])
        names = np.array([g[2] for g in got], dtype=np.uint64)
        paired = np.zeros(len(tokens))
        paired[1:] = self.odds[pair_bucket(names[:-1], names[1:])]
        counts[1:] += 1
        return float(((sums + paired) / counts).mean()) + self.bias

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, score) per row; a text without tokens, empty and null ones too,
        has the score of the bias alone."""
        small_batches(docs.sparkSession)
        model = docs.sparkSession.sparkContext.broadcast(self)  # of fixed size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, cache = model.value, {}
            for b in batches:
                p = []
                for text in b.column("text").to_pylist():
                    if len(cache) > 200_000:
                        cache.clear()
                    p.append(1 / (1 + np.exp(-np.clip(m._logit(text, cache), -35, 35))) if m.odds is not None else m.prior)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(p, pa.float64())], ["id", "score"])

        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double")


def _document(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights, which sum to one."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    kinds = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    number = np.array([kinds[t] for t in tokens])
    names = _token_hash(list(kinds))[number]
    size = np.zeros(len(kinds), dtype=np.int64)
    for _, owner in gram_groups(list(kinds)):
        size += np.bincount(owner, minlength=len(kinds))
    # A token counts its pair too, but for the first, which has none.
    each = np.full(len(tokens), 1.0)
    each[1:] = 1 / (size[number[1:]] + 1)
    each[0] = 1 / size[number[0]]
    per_kind = np.bincount(number, weights=each, minlength=len(kinds))
    sums = np.zeros(BUCKETS)
    sums += np.bincount(pair_bucket(names[:-1], names[1:]), weights=each[1:], minlength=BUCKETS)
    for bucket, owner in gram_groups(list(kinds)):
        sums += np.bincount(bucket, weights=per_kind[owner], minlength=BUCKETS)
    kept = np.flatnonzero(sums)
    return kept, sums[kept] / len(tokens)


def train(texts: list[str], y: np.ndarray, rate: float = 12.0, seed: int = 7) -> QualityModel:
    """SGD on cross-entropy, the rate falling to zero over the passes."""
    rng = np.random.default_rng(seed)
    docs = [_document(t) for t in texts]
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    out = np.zeros((WIDTH, 2))
    prior = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    bias = np.array([0.0, np.log(prior / (1 - prior))])
    total, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            at, w = docs[i]
            lr = rate * (1 - done / total)
            done += 1
            hidden = w @ vectors[at]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= min(lr, 1.0) * 0.5 * np.outer(hidden, p)
            bias -= 0.01 * min(lr, 1.0) * p
            vectors[at] -= lr * w[:, None] * back
    odds = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32)
    return QualityModel(odds, float(bias[1] - bias[0]), float(prior))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Train on about ``fit_rows`` labelled documents outside the held-out
    fold, chosen by hash of the id; fewer of the commoner class, if need be, so
    that the rarer one is a fifth of them (the bias is set right after).
    Without rows of both classes every score is the share of class 1."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, label, id_col, text_col)
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return QualityModel(None, 0.0, float(next(iter(counts), 0)))
    rare = min(counts, key=counts.get)
    take = {rare: min(1.0, max(fit_rows / total, fit_rows / 5 / counts[rare]))}
    take[1 - rare] = min(1.0, (fit_rows - take[rare] * counts[rare]) / counts[1 - rare])
    share = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = rows.where(share < F.when(F.col("y") == 1, take[1]).otherwise(take[0])).select("text", "y").toArrow()
    y = got.column("y").to_numpy().astype(int)
    if not len(y) or y.min() == y.max():
        return QualityModel(None, 0.0, counts[1] / total)
    model = train(got.column("text").to_pylist(), y)
    return QualityModel(model.odds, model.bias + float(np.log(take[0] / take[1])), counts[1] / total)
