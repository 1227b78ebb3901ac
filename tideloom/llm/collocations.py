"""Phrases whose words keep company, by counts over the whole corpus.

Texts become blocks of words in a language. Of each block a generalised suffix
automaton of bounded depth is made: its states are classes of word sequences
that end at the same places, a state's link leads to the longest suffix that
ends at more places. Here states are grouped by sorting, level by level: a
sequence that ends at a place is the state of its suffix and the word before. The
states of all blocks give their sequences with counts, which Spark adds up.

Counting goes by length. A sequence can be frequent only if its suffix and its prefix are, so
words that aren't frequent in all the corpus end a sequence, and later pairs
that aren't. What is frequent reaches the tasks as a bitmap of fixed size: two
phrases may share a bit, which lets some more be counted, but loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import shuffles_dropped, small_batches, written

#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: Phrases that are Python strings at once.
SLICE = 50_000
#: Bits of the map of frequent phrases: 16 MB, whatever the corpus.
MAP_BITS = 27
#: Parts in which a language's phrases are ranked before the last ranking.
RANK_PARTS = 64

_FOLD = bytearray(range(256))
for _c in range(65, 91):
    _FOLD[_c] += 32
_FOLD[9] = 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = 255  # a byte that UTF-8 never has ends a piece
_FOLD = bytes(_FOLD)


class Automaton:
    """States of the suffix automaton of a block's words up to a depth."""

    def __init__(self, text: bytes, lang: bytes = b""):
        """``text`` has its case folded and 0xFF between pieces."""
        words = pa.array(text.replace(b"\xff", b" \xff ").split(), pa.binary()).dictionary_encode()
        self.lang, self.words = lang, words.dictionary
        self.at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        mark = pc.index(self.words, pa.scalar(b"\xff", pa.binary())).as_py() if len(self.words) else -1
        self.state, self.end = [self.at], [np.zeros(0, dtype=np.int64)]
        self.valid, self.link = [self.at != mark], [np.zeros(0, dtype=np.int64)]
        self.count = [np.bincount(self.at, minlength=len(self.words))]
        if mark >= 0:
            self.count[0][mark] = 0

    def grow(self) -> None:
        """One level more: sequences one word longer, to the left."""
        k = len(self.state)
        before, valid = self.state[-1], self.valid[-1].copy()
        valid[1:] &= self.valid[-1][:-1]
        valid[:k] = False
        place = np.flatnonzero(valid)
        key = before[place] * np.int64(max(1, len(self.words))) + self.at[place - k]
        found, first, number, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        state = np.zeros(len(before), dtype=np.int64)
        state[place] = number
        self.state.append(state)
        self.valid.append(valid)
        self.count.append(count)
        self.end.append(place[first])
        self.link.append(found // max(1, len(self.words)))

    def phrases(self, level: int, which: np.ndarray | None = None) -> pa.Array:
        """The sequences of ``level`` + 1 words, space-joined."""
        if not level:
            return self.words if which is None else self.words.take(pa.array(which))
        end = self.end[level] if which is None else self.end[level][which]
        parts = [self.words.take(pa.array(self.at[end - back])) for back in range(level, -1, -1)]
        return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))

    def keep(self, level: int, bits: np.ndarray) -> None:
        """Sequences of a level that aren't in the map end nothing longer."""
        n = len(self.count[level])
        if not n:
            return
        head = self.lang + b"\0"
        within = np.zeros(n, dtype=bool)
        for at in range(0, n, SLICE):
            keys = self.phrases(level, np.arange(at, min(n, at + SLICE))).to_pylist()
            slot = np.fromiter((xxhash.xxh64_intdigest(head + x, 42) for x in keys), dtype=np.uint64, count=len(keys)) & np.uint64(8 * len(bits) - 1)
            within[at : at + SLICE] = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
        self.valid[level] = self.valid[level] & within[self.state[level]]

    def classes(self, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Sequences of ``low`` to ``high`` words by state: a sequence that ends
        wherever its link does is of the link's state and has its count."""
        count = [np.asarray(c) for c in self.count]
        for level in range(low - 1, min(high, len(self.state))):
            same = count[level] == count[level - 1][self.link[level]] if level > low - 1 and level else np.zeros(len(count[level]), dtype=bool)
            yield level, np.flatnonzero(~same & (count[level] > 0)), count[level][~same & (count[level] > 0)]
            if same.any():
                link = self.link[level][same]
                yield level, np.flatnonzero(same), count[level - 1][link]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[bytes, bytes]]:
    """(language, folded text) of about ``size`` bytes each; a longer text is
    cut between its pieces."""
    open_: dict[bytes, list[bytes]] = {}
    held = 0
    for b in batches:
        for lang, text in zip(b.column("lang").cast(pa.binary()), b.column("text").cast(pa.large_binary()), strict=True):
            lang, data = lang.as_py(), text.as_py().translate(_FOLD)
            at = 0
            while len(data) - at > size:
                to = data.find(b"\xff", at + size)
                if to < 0:
                    break
                yield lang, data[at:to]
                at = to
            open_.setdefault(lang, []).append(data[at:])
            held += len(data) - at
            if held >= size:
                for name, parts in open_.items():
                    yield name, b"\xff".join(parts)
                open_, held = {}, 0
    for name, parts in open_.items():
        yield name, b"\xff".join(parts)


def _counts(texts: DataFrame, low: int, high: int, known: dict[int, object], block: int) -> DataFrame:
    """(lang, words, phrase, f) of all sequences of ``low`` to ``high`` words whose
    shorter parts are in the maps ``known`` (by number of words)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _blocks(batches, block):
            a = Automaton(text, lang)
            for level in range(high):
                if level:
                    a.grow()
                if level + 1 in known:
                    a.keep(level, known[level + 1].value)
            for level, which, count in a.classes(low, high):
                phrase = a.phrases(level, which).cast(pa.string())
                n = len(which)
                yield pa.RecordBatch.from_arrays([pa.array([lang.decode()] * n, pa.string()), pa.array(np.full(n, level + 1, dtype=np.int32)), phrase, pa.array(count.astype(np.int64))], ["lang", "words", "phrase", "f"])

    found = texts.mapInArrow(go, "lang string, words int, phrase string, f bigint")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def _map(frequent: DataFrame, bits: int):
    """A bitmap of fixed size with a bit for each phrase, broadcast."""
    spark = frequent.sparkSession
    slot = F.xxhash64(F.concat_ws("\0", "lang", "phrase")).bitwiseAND(F.lit((1 << bits) - 1))
    rows = frequent.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits"))
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    got = rows.toArrow()
    out[got["at"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return spark.sparkContext.broadcast(out.view(np.uint8))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, longest: int = 4, covered: int = 80, top: int | None = 2000, block: int = BLOCK_BYTES, bits: int = MAP_BITS) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of each language: lang, rank,
    phrase, a (its occurrences), l and r (those of the two parts of its lowest-scoring
    cut), n (the language's words) and score.

    Words are parted by space and tab, phrases don't cross ``.,;:!?`` or line ends,
    A-Z are folded. Phrases are frequent from ``least`` occurrences on; one goes
    if a frequent phrase one or more words longer holds it and has ``covered``
    percent of its occurrences at least. ``top`` None returns all that are left.

    A null text has no words, a null language is ``und``. Texts without words, or
    an empty table, give no rows; rows that repeat count each time. Equal scores are ordered by
    occurrences, then by phrase in byte order. Other columns are ignored."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # A pass over the texts shuffles more than twice the input; its files go before the next pass.
    with shuffles_dropped(docs.sparkSession):
        words = written(_counts(texts, 1, 1, {}, block))
        often = written(words.where(F.col("f") >= least))
        known = {1: _map(often, bits)}
        for k in range(2, longest + 1):
            if k > 3:
                break
            # pairs first; when pairs are known, all longer phrases in one pass
            high = 2 if k == 2 else longest
            more = written(_counts(texts, k, high, known, block).where(F.col("f") >= least))
            often = often.unionByName(more)
            if k == 2:
                known = known | {2: _map(more, bits)}
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    candidates = often.where("words >= 2").withColumnRenamed("f", "a")

    # Every cut of a candidate, with the counts of its two parts.
    cut = candidates.select("lang", "phrase", "a", F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    left = often.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = often.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("(cast(2000000 as decimal(20,0)) * cast(a as decimal(18,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    both = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")

    # The suffix link of a phrase drops its first word; its prefix drops the last. Whatever holds
    # a phrase holds it through frequent phrases one word longer, which occur no less often.
    links = candidates.where("words > 2").select("lang", "a", F.explode(F.array(F.regexp_replace("phrase", "^[^ ]+ ", ""), F.regexp_replace("phrase", " [^ ]+$", ""))).alias("phrase"))
    holders = links.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    kept = scored.join(holders, ["lang", "phrase"], "left").where(F.col("_most").isNull() | (F.col("_most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered)).drop("_most")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:
        part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part")
        kept = kept.withColumn("_part", part).withColumn("_rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= top).drop("_part", "_rank")
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
