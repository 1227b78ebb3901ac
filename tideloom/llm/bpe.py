"""Byte-pair encoding with a public vocabulary, and back.

Texts are cut where a rolling hash of their last 32 bytes says so, so equal
passages give equal chunks wherever they stand. A chunk that occurs more than
once in the corpus is encoded once, and its ids are joined to the texts that hold it; what
lies between such chunks is encoded in place. Where parts meet, the text around
the joint is encoded again, over a window that grows until both encodings begin
a word at the same place to the right of the joint. From there on they agree.

Why they agree: the tokenizer's splitter reads from left to right and knows
nothing of the words before. A word's tokens hang on the word alone. So two encodings that
begin a word at the same character are equal from there on, until the
end of the shorter one comes within sight, if nothing across the place could have merged: not special
tokens, whose longest is within the margin, nor characters that compose, so that
words which begin with such a character are no meeting places.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .shared import _mix, small_batches, written

#: Bytes of a chunk: one in MEAN may end one, between LEAST and MOST.
LEAST, MEAN, MOST = 256, 1024, 8192
#: Characters that a window has to the right of a joint at first, and those next to the
#: end of a part that aren't trusted: more than the longest special token or contraction.
WINDOW, MARGIN = 64, 16
#: Places noted at the beginning of a shared chunk where another encoding may meet it.
HEADS = 12
#: Bits of the map of shared chunks: 16 MB, whatever the corpus.
MAP_BITS = 27
#: Texts that take a copy of one shared chunk's ids from one row.
COPIES = 512
#: Bytes encoded in place at once, of a plain text without shared chunks, and bytes of ids in a batch.
SEGMENT, WHOLE, BATCH_BYTES = 1 << 16, 1 << 22, 8 << 20

_GEAR = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


# Chunks


def cuts(raw: bytes, step: int = 1 << 20) -> list[int]:
    """Ends of the chunks of a text, the last one its length. None is within a
    code point."""
    n, hits = len(raw), []
    data = np.frombuffer(raw, dtype=np.uint8)
    for at in range(0, n, step):
        lead = min(at, 31)
        h = _GEAR[data[at - lead : at + step]]
        for k in (1, 2, 4, 8, 16):
            h[k:] += h[:-k] << np.uint32(k)
        hit = np.flatnonzero(h[lead:] < np.uint32((1 << 32) // MEAN)) + at + 1
        hits.append(hit)
    hits = np.concatenate(hits).tolist() if hits else []
    out, last = [], 0

    def cut(to: int) -> None:
        nonlocal last
        while to < n and raw[to] & 0xC0 == 0x80:
            to += 1
        last = min(to, n)
        out.append(last)

    for hit in hits:
        while hit - last > MOST:
            cut(last + MOST)
        if hit - last >= LEAST:
            cut(hit)
    while n - last > MOST:
        cut(last + MOST)
    if last < n:
        out.append(n)
    return out


def digests(raw: bytes, ends: list[int]) -> list[bytes]:
    """A 128-bit digest of each chunk."""
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip([0, *ends], ends)]  # noqa: B905


# Parts and joints


class Part(NamedTuple):
    """Encoded characters: ids, and (character, number of ids before) of places
    where a word begins, ascending."""

    ids: np.ndarray
    places: np.ndarray


@cache
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, once a process, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def _composes(c: str) -> bool:
    """Whether a character may merge with those before it. Only scripts known to
    hold none that do are trusted."""
    o = ord(c)
    return not (o < 0x300 or 0x370 <= o < 0x483 or 0x4E00 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3)


#: What a plain text may not hold: anything but printable ASCII, white space and Latin letters
#: whose case and normal form are beyond doubt, and what may begin a special token.
_FOREIGN = re.compile(r"[^\t\n\r -~À-ÖØ-öø-įıĲ-ž]|<\|")
#: The words of a plain text in lower case, as the file's splitter finds them.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[!-/:-@\[-`{-~]+")
#: Words whose ids a process remembers at most.
WORDS = 400_000


class Words:
    """Ids of the words of plain texts, from the library once a word."""

    def __init__(self, t: Tokenizer):
        self.t, self.ids = t, {}
        #: Only a file with this splitter and normaliser has plain texts.
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {o: "".join(x for x, _ in letters.pre_tokenize_str(chr(o))) for o in range(0x180)}
        self.able = PLAIN_SPLIT in t.to_str() and '"pattern":{"Regex":"\\\\s+"},"content":" "' in t.to_str()

    def of(self, text: str) -> list[bytes] | None:
        """The packed ids of each word, or None where the text isn't plain."""
        if not self.able or _FOREIGN.search(text):
            return None
        return self._packed(_WORD.findall(text.lower()))

    def _packed(self, words: list[str]) -> list[bytes]:
        known = self.ids
        new = list(set(words).difference(known))
        if new:
            if len(known) + len(new) > WORDS:
                known.clear()
                new = list(set(words))
            model = self.t.model
            for word in new:
                known[word] = np.array([k.id for k in model.tokenize(word.translate(self.letters))], dtype="<u4").tobytes()
        return list(map(known.__getitem__, words))

    def part(self, text: str) -> Part | None:
        """Ids and places of a plain text. Those near its ends are enough: it is cut at
        two spaces, where no word and nothing that composes is."""
        if not self.able or _FOREIGN.search(text):
            return None
        low = text.lower()
        head = low.find(" ", min(len(low), HEAD_CHARS))
        head = len(low) if head < 0 else head
        tail = max(head, low.rfind(" ", head, max(head, len(low) - 2 * MARGIN)))
        found = list(_WORD.finditer(low, 0, head))
        first = self._packed([m[0] for m in found])
        middle, last = self._packed(_WORD.findall(low, head, tail)), self._packed(_WORD.findall(low, tail))
        at = [m.start() for m in found[1:]]
        before = np.cumsum([len(x) // 4 for x in first[:-1]]).tolist() if first else []
        whole = b"".join((*first, *middle, *last))
        if tail > head or head < len(low):
            end = _WORD.search(low, tail)
            if end and (not at or end.start() > at[-1]):
                at.append(end.start())
                before.append(len(whole) // 4 - sum(map(len, last)) // 4)
        return Part(np.frombuffer(whole, dtype="<u4"), np.array([at, before], dtype=np.int32).T.reshape(-1, 2))


PLAIN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+"
#: Characters at the beginning of a plain part in which all places are noted.
HEAD_CHARS = 160


@cache
def _words(t: Tokenizer) -> Words:
    return Words(t)


def encoded(t: Tokenizer, texts: list[str]) -> list[Part]:
    """Each text on its own."""
    words = _words(t)
    out: list[Part | None] = [words.part(x) for x in texts]
    others = [i for i, x in enumerate(out) if x is None]
    for i, part in zip(others, _by_library(t, [texts[i] for i in others]), strict=True):
        out[i] = part
    return out


def _by_library(t: Tokenizer, texts: list[str]) -> list[Part]:
    out = []
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.array(e.ids, dtype=np.uint32)
        if not len(ids):
            out.append(Part(ids, np.zeros((0, 2), dtype=np.int32)))
            continue
        # an added token has no word: a change to or from None begins one too
        word = np.array([-1 if w is None else w for w in e.word_ids], dtype=np.int64)
        span = np.array(e.offsets, dtype=np.int64)
        new = np.flatnonzero((word[1:] != word[:-1]) | (word[1:] < 0)) + 1
        new = new[span[new - 1, 1] <= span[new, 0]]
        at = span[new, 0]
        if not text.isascii():
            fine = np.fromiter((not _composes(text[i]) for i in at.tolist()), dtype=bool, count=len(at))
            new, at = new[fine], at[fine]
        out.append(Part(ids, np.stack([at, new], axis=1).astype(np.int32)))
    return out


def joined(text: str, ends: list[int], parts: list[Part], encode: Callable[[list[str]], list[Part]]) -> np.ndarray:
    """The ids of ``text`` from the ids of its parts, which end at the characters
    ``ends``; equal to encoding it at once."""
    out, i, n = [], 0, len(text)
    begin, token = 0, 0  # where part i begins, and its ids from which it holds
    since = 0  # the character of that id
    while i < len(parts):
        ids, places = parts[i]
        if i + 1 == len(parts):
            out.append(ids[token:])
            break
        trusted = places[(places[:, 0] <= ends[i] - begin - MARGIN) & (places[:, 1] > token)]
        if len(trusted):
            out.append(ids[token : trusted[-1, 1]])
            since = begin + int(trusted[-1, 0])
        size = WINDOW
        while True:
            stop = min(n, ends[i] + size)
            w = encode([text[since:stop]])[0]
            if stop == n:
                meet = None
            else:
                at = w.places[:, 0] + since
                may = w.places[(at >= ends[i]) & (at <= stop - MARGIN)]
                meet = _meeting(may, since, i, ends, parts)
                if meet is None:
                    size *= 2
                    continue
            break
        if meet is None:
            out.append(w.ids)
            break
        out.append(w.ids[: meet[0]])
        i, token, since = meet[1], meet[2], meet[3]
        begin = ends[i - 1]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def _meeting(may: np.ndarray, since: int, after: int, ends: list[int], parts: list[Part]) -> tuple[int, int, int, int] | None:
    """(ids of the window before it, part, ids of that before it, character) of
    the first place in both encodings."""
    i = after
    for at, before in may.tolist():
        at += since
        while ends[i] <= at:
            i += 1
        p = parts[i].places
        k = int(np.searchsorted(p[:, 0], at - ends[i - 1]))
        if k < len(p) and p[k, 0] == at - ends[i - 1]:
            return before, i, int(p[k, 1]), at
    return None


def encode_text(t: Tokenizer, raw: bytes, ends: list[int], known: dict[int, Part]) -> np.ndarray:
    """Ids of a text cut at ``ends``; ``known`` has the parts of some chunks by
    their number. The others are encoded here, neighbours together."""
    text = raw.decode()
    if not known:
        plain = _words(t).of(text) if len(raw) <= WHOLE else None
        if plain is not None:
            return np.frombuffer(b"".join(plain), dtype="<u4")
        if len(raw) <= SEGMENT:
            return np.array(t.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    stops, parts, todo, at = [], [], [], 0
    begin = 0
    for k, end in enumerate(ends):
        if k in known:
            at += len(raw[begin:end].decode())
            stops.append(at)
            parts.append(known[k])
            begin = end
        elif k + 1 == len(ends) or k + 1 in known or ends[k + 1] - begin > SEGMENT:
            piece = raw[begin:end].decode()
            at += len(piece)
            stops.append(at)
            todo.append((len(parts), piece))
            parts.append(None)
            begin = end
    for (k, _), part in zip(todo, encoded(t, [x for _, x in todo]), strict=True):
        parts[k] = part
    return joined(text, stops, parts, lambda x: encoded(t, x))


# Corpus


def _narrow(t: Tokenizer) -> str:
    """The type that holds every id of the vocabulary, for ids that are shuffled."""
    return "<u2" if t.get_vocab_size() <= 1 << 16 else "<u4"


def _pack(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def _id_batches(rows: Iterator[tuple[object, bytes]], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    names, values, size = [], [], 0
    for name, value in rows:
        names.append(name)
        values.append(value)
        size += len(value)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(values, pa.binary())], ["row", "ids"])
            names, values, size = [], [], 0
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(values, pa.binary())], ["row", "ids"])


def _map(shared: DataFrame, bits: int):
    """A bitmap of fixed size with a bit for each shared chunk, broadcast."""
    slot = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint").bitwiseAND(F.lit((1 << bits) - 1))
    rows = shared.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits"))
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    got = rows.toArrow()
    out[got["at"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return shared.sparkSession.sparkContext.broadcast(out)


def _held(bits: np.ndarray, digest: bytes) -> bool:
    slot = int.from_bytes(digest[:4], "big") & (32 * len(bits) - 1)
    return bool(int(bits[slot >> 5]) >> (slot & 31) & 1)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bits: int = MAP_BITS) -> DataFrame:
    """One row a row of ``docs``: id and ids, the token ids as little-endian
    unsigned 32-bit integers, equal to what the tokenizers library gives for the whole text
    with ``add_special_tokens=False``. ``path`` names the vocabulary file on driver and executors.

    A null or empty text gives no ids, an empty table no rows. Rows that repeat are
    encoded each; those with a null id too. Other columns are ignored.

    Chunks that occur once are never moved: a text without any shared chunk (by a bitmap of
    fixed size, which may name a few too many) is encoded where it is read. The others
    are written once, and rows of (chunk, ids) are joined to them. A chunk
    that very many texts share has a copy for each 512 of them."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").cast(pa.large_binary()):
                raw = text.as_py()
                out += digests(raw, cuts(raw))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["digest"])

    shared = rows.select("text").mapInArrow(chunked, "digest binary").groupBy("digest").count().where("count > 1")
    shared = written(shared)
    known = _map(shared, bits)

    def texts(batches: Iterator[pa.RecordBatch], alone: bool) -> Iterator[tuple[object, bytes, list[int]]]:
        for b in batches:
            for name, text in zip(b.column("id"), b.column("text").cast(pa.large_binary()), strict=True):
                raw = text.as_py()
                ends = cuts(raw)
                if any(_held(known.value, d) for d in digests(raw, ends)) != alone:
                    yield name.as_py(), raw, ends

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        first = next(batches, None)
        if first is None:
            return
        of = first.schema.field("id").type

        def all_() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for out in _id_batches(((name, _pack(encode_text(t, raw, ends, {}))) for name, raw, ends in texts(all_(), True)), of):
            yield out.rename_columns(["id", "ids"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine = [(name, raw) for name, raw, _ in texts(iter([b]), False)]
            names, raws = zip(*mine, strict=True) if mine else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, b.schema.field("id").type), pa.array(raws, pa.binary()).cast(pa.string())], ["id", "text"])

    alone = rows.mapInArrow(in_place, f"id {kind}, ids binary")
    held = written(rows.mapInArrow(others, f"id {kind}, text string").withColumn("row", F.expr("uuid()")), "zstd")

    def pieces(batches: Iterator[pa.RecordBatch], text: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen, row, number, digest, chunk = set(), [], [], [], []
            for name, x in zip(b.column("row"), b.column("text").cast(pa.large_binary()), strict=True):
                raw, name = x.as_py(), name.as_py()
                ends = cuts(raw)
                for k, (d, begin, end) in enumerate(zip(digests(raw, ends), [0, *ends], ends)):  # noqa: B905
                    if not _held(known.value, d):
                        continue
                    if text and d not in seen:
                        seen.add(d)
                        digest.append(d)
                        chunk.append(raw[begin:end])
                    elif not text:
                        row.append(name)
                        number.append(k)
                        digest.append(d)
            if text:
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(chunk, pa.binary()).cast(pa.string())], ["digest", "chunk"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.string()), pa.array(number, pa.int32()), pa.array(digest, pa.binary())], ["row", "number", "digest"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            parts = encoded(t, b.column("chunk").to_pylist())
            places = []
            for p, text in zip(parts, b.column("chunk").to_pylist(), strict=True):
                last = np.flatnonzero(p.places[:, 0] <= len(text) - MARGIN)[-1:]
                places.append(np.concatenate([p.places[:HEADS], p.places[last[last >= HEADS]]]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("copies"), pa.array([p.ids.astype(_narrow(t)).tobytes() for p in parts], pa.binary()), pa.array(places, pa.binary())], ["digest", "copies", "ids", "places"])

    chunks = held.select("row", "text").mapInArrow(lambda b: pieces(b, True), "digest binary, chunk string")
    distinct = chunks.groupBy("digest").agg(F.first("chunk").alias("chunk"))
    counted = shared.select("digest", F.ceil(F.col("count") / COPIES).cast("int").alias("copies"))
    codes = written(distinct.join(counted, "digest").mapInArrow(once, "digest binary, copies int, ids binary, places binary"))
    refs = held.select("row", "text").mapInArrow(lambda b: pieces(b, False), "row string, number int, digest binary")
    copies = codes.select("digest", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "ids", "places")
    refs = refs.join(codes.select("digest", "copies"), "digest").withColumn("copy", F.pmod(F.xxhash64("row", "number"), F.col("copies")).cast("int"))
    given = refs.select("row", "number", "digest", "copy").join(copies, ["digest", "copy"]).select("row", "number", "ids", "places")
    each = held.select("row", "id", "text")

    def put(texts: pa.Table, given: pa.Table) -> pa.Table:
        t = tokenizer(path)
        found: dict[int, Part] = {}
        for k, ids, places in zip(given["number"].to_pylist(), given["ids"], given["places"], strict=True):
            found[k] = Part(np.frombuffer(ids.as_py(), dtype=_narrow(t)).astype("<u4"), np.frombuffer(places.as_py(), dtype="<i4").reshape(-1, 2))
        raws = [x.as_py() for x in texts["text"].cast(pa.large_binary())]
        ids = [_pack(encode_text(t, raw, cuts(raw), found)) for raw in raws]
        return pa.table([texts["id"], pa.array(ids, pa.binary())], ["id", "ids"])

    return alone.unionByName(each.groupBy("row").cogroup(given.groupBy("row")).applyInArrow(put, f"id {kind}, ids binary"))


def decode(codes: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``codes`` with ``decoded``: what the library's ``decode(ids,
    skip_special_tokens=False)`` gives. Where the file names no decoder that is
    the tokens with a space between; else the library is asked."""
    schema = codes.schema
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        words = None
        if t.decoder is None:
            vocabulary = t.get_vocab(with_added_tokens=True)
            table = [""] * (max(vocabulary.values()) + 1)
            for token, i in vocabulary.items():
                table[i] = token + " "
            words = pa.array(table, pa.large_string())
        for b in batches:
            out, at, size = [], 0, 0
            for i, x in enumerate(b.column(ids_col)):
                ids = np.frombuffer(x.as_py() or b"", dtype="<u4")
                if words is None:
                    out.append(t.decode(ids.tolist(), skip_special_tokens=False))
                else:
                    took = words.take(pa.array(ids))
                    out.append(took.buffers()[2].slice(0, int(np.frombuffer(took.buffers()[1], dtype=np.int64)[len(ids)]) - 1).to_pybytes() if len(ids) else b"")
                size += len(out[-1])
                if size >= BATCH_BYTES or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, len(out)) for c in b.columns), pa.array(out, pa.binary() if words is not None else pa.string()).cast(pa.string())], [*b.schema.names, "decoded"])
                    at, out, size = i + 1, [], 0

    return codes.mapInArrow(go, ", ".join([*names, "decoded string"]))


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("bigint")
