"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ by k = m // 10 edits. Split into k + 1
pieces, one piece at least must occur unchanged. An automaton finds all pieces
of all items in one pass over a text; a hit is followed up through a binary
tree over the pieces, in which a node of p pieces may have p - 1 edits: if the
whole is within its budget, so is every node on the way up from some unchanged
piece, hence nothing is lost by giving up at the first node that isn't. Nodes
are checked by Myers' bit-parallel distance.

Texts and items are compared in lower case with white space as single spaces.
An item of under ten characters has no edits to spare and is one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import small_batches

#: Characters of items that are sent out at a time; more items go in blocks. A
#: worker needs about 200 bytes a character for the pieces and their masks.
BLOCK_CHARS = 500_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int) -> int:
    return length // 10


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(pattern: str, masks: dict[str, int], window: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any substring of ``window`` and
    the first end at which it is reached (Myers 1999)."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    get = masks.get
    for j, c in enumerate(window, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, at = score, j
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best, at


def _within(pattern: str, masks: dict[str, int], window: str, most: int) -> bool:
    """Whether some substring of ``window`` is within ``most`` edits."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    if score <= most:
        return True
    get = masks.get
    left = len(window)
    for c in window:
        left -= 1
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score <= most:
                return True
        elif score - left > most:
            return False
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return False


def _anchored(pattern: str, masks: dict[str, int], window: str) -> Iterator[int]:
    """Edit distance of ``pattern`` to each head of ``window``, by the same bit
    vectors: a first row that grows by one a character keeps the start in its place."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    get = masks.get
    for c in window:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += 1 if ph & high else -1 if mh & high else 0
        ph = (ph << 1 | 1) & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        yield score


@dataclass
class _Node:
    start: int  # in the item
    end: int
    most: int
    parent: _Node | None
    pattern: str
    masks: dict[str, int]


class Matcher:
    """All items of one block, ready to be searched for in texts."""

    def __init__(self, items: list[tuple[int, str]], whole_words: bool = False):
        self.whole_words = whole_words
        self.items = [(i, t) for i, t in items if t]
        self.auto = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, _Node]]] = {}
        self.roots: list[_Node] = []
        for n, (_, text) in enumerate(self.items):
            k = budget(len(text))
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]

            def grow(lo: int, hi: int, parent: _Node | None, n=n, text=text, cuts=cuts) -> _Node:
                part = text[cuts[lo] : cuts[hi]]
                node = _Node(cuts[lo], cuts[hi], hi - lo - 1, parent, part, {} if hi - lo == 1 else _masks(part))
                if hi - lo == 1:
                    pieces.setdefault(part, []).append((n, node))
                else:
                    mid = (lo + hi) // 2
                    grow(lo, mid, node)
                    grow(mid, hi, node)
                return node

            self.roots.append(grow(0, k + 1, None))
        for part, owners in pieces.items():
            self.auto.add_word(part, (len(part), owners))
        if pieces:
            self.auto.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, distance, start, end) of the best match of each item in
        normal ``text``: least distance, then first."""
        if not self.items:
            return []
        ends: dict[int, list[tuple[int, int]]] = {}
        whole: dict[int, tuple[int, int, int]] = {}
        seen: set[tuple[int, int]] = set()
        for last, (size, owners) in self.auto.iter(text):
            at = last + 1 - size
            for n, leaf in owners:
                node = leaf.parent
                base = at - leaf.start  # where the item would begin
                ok = True
                while node is not None:
                    if node.parent is None and (n, base) in seen:
                        ok = False
                        break
                    lo = max(0, base + node.start - node.most)
                    if not _within(node.pattern, node.masks, text[lo : base + node.end + node.most], node.most):
                        ok = False
                        break
                    node = node.parent
                if not ok or (n, base) in seen:
                    continue
                seen.add((n, base))
                root = self.roots[n]
                if self.whole_words:
                    found = _whole_words(root, text, base)
                    if found:
                        whole[n] = min(whole.get(n, found), found)
                    continue
                lo = max(0, base - root.most)
                d, end = best_end(root.pattern, root.masks or _masks(root.pattern), text[lo : base + root.end + root.most])
                ends.setdefault(n, []).append((d, lo + end))
        out = [(n, d, start, end) for n, (d, start, end) in whole.items()]
        for n, found in ends.items():
            d, end = min(found)
            pattern = self.items[n][1]
            back, size = best_end(pattern[::-1], _masks(pattern[::-1]), text[max(0, end - len(pattern) - d) : end][::-1])
            out.append((n, back, end - size, end))
        return out


def _whole_words(root: _Node, text: str, base: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best match near ``base`` of an item that
    neither begins nor ends inside of a word; none if over the budget."""
    edge = lambda i: i in (0, len(text)) or not (text[i - 1].isalnum() and text[i].isalnum())
    masks = root.masks or _masks(root.pattern)
    best = None
    for start in range(max(0, base - root.most), min(len(text), base + root.most) + 1):
        if not edge(start):
            continue
        for end, d in enumerate(_anchored(root.pattern, masks, text[start : start + len(root.pattern) + root.most]), start + 1):
            if d <= root.most and edge(end) and (best is None or (d, start, end) < best):
                best = d, start, end
    return best


def _origins(text: str) -> list[int]:
    """For each character of ``normal(text)`` its place in ``text``."""
    out: list[int] = []
    gap = None
    for i, c in enumerate(text):
        low = c.lower()
        if c.isspace():
            gap = i if gap is None else gap
            continue
        if gap is not None and out:
            out.append(gap)
        gap = None
        out.extend([i] * len(low))
    return out


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", whole_words: bool = False) -> DataFrame:
    """(id, item, distance, start, end): a row for each item that a document
    contains within the item's budget, with the place of its best match in
    characters of the document, the end exclusive.

    Null and empty items match nothing, nor do null or empty texts. With ``whole_words``
    items, of whatever length, match only where they neither begin nor end inside of a word: for
    benchmarks of items so short that they stand inside of words by chance.
    Repeated rows of ``docs`` give rows each; an item id that occurs with
    several texts is searched for with each, and the best is told. A null id is
    kept. Items are collected in blocks of bounded size, each of which is
    searched for in one pass; their number is the caller's, not the corpus's.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    queries = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where(F.length("text") > 0).distinct()
    item_type = to_arrow_type(queries.schema["item"].dataType)
    kinds, item_kind = dict(rows.dtypes)["id"], dict(queries.dtypes)["item"]
    chars = queries.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    schema = f"id {kinds}, item {item_kind}, distance int, start bigint, end bigint"
    out = None
    for block in range(blocks):
        some = [(r["item"], normal(r["text"])) for r in queries.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()]
        sent = spark.sparkContext.broadcast(sorted(some, key=str))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, whole_words)
            for b in batches:
                at, told = [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    found = matcher.find(normal(text))
                    if found:
                        origin = _origins(text)
                        best: dict = {}
                        for n, d, s, e in found:
                            key = matcher.items[n][0]
                            best[key] = min(best.get(key, (d, s, e)), (d, s, e))
                        for key, (d, s, e) in best.items():
                            at.append(i)
                            told.append((key, d, origin[s], origin[e - 1] + 1))
                if told:
                    item, d, s, e = zip(*told, strict=True)
                    ids = b.column("id").take(pa.array(np.array(at)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(item, item_type), pa.array(d, pa.int32()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["id", "item", "distance", "start", "end"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out
