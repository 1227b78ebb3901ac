"""Fill-in-middle: a text is cut in three and put in another order.

A text is described by its runs of characters of one class, the number of bytes
that UTF-8 gives a code point: where a run begins in bytes, how many code points
come before it, and the class. A cut at a code point is found by a binary
search for its run and one multiplication, so that no text is expanded to
characters and slices are slices of bytes.

Cuts and forms hang on the document's id and the seed alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, those that stay plain, and of the others those with the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
#: Bytes of text in an Arrow batch that goes back to Spark, and in a step of reading runs.
BATCH_BYTES, STEP = 8 << 20, 1 << 20

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[:128], _CLASS[192:224], _CLASS[224:240], _CLASS[240:] = 1, 2, 3, 4


class Runs:
    """Maximal runs of code points of one class of a UTF-8 text."""

    def __init__(self, raw: bytes):
        data = np.frombuffer(raw, dtype=np.uint8)
        starts, widths, counts = [], [], []
        for at in range(0, len(data), STEP):
            kind = _CLASS[data[at : at + STEP]]
            lead = np.flatnonzero(kind)  # a step may begin within a code point
            if not len(lead):
                continue
            kind = kind[lead]
            first = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
            starts.append(lead[first] + at)
            widths.append(kind[first])
            counts.append(np.diff(first, append=len(kind)))
        if starts:
            start, width, count = (np.concatenate(x).astype(np.int64) for x in (starts, widths, counts))
            new = np.concatenate([[True], width[1:] != width[:-1]])
            at = np.flatnonzero(new)
            self.start, self.width, count = start[at], width[at], np.add.reduceat(count, at)
        else:
            self.start = self.width = count = np.zeros(0, dtype=np.int64)
        self.units = np.concatenate([[0], np.cumsum(count)])
        self.bytes = len(raw)

    def __len__(self) -> int:
        """Code points."""
        return int(self.units[-1])

    def offset(self, cut: int) -> int:
        """Bytes before the code point ``cut``."""
        if cut >= len(self):
            return self.bytes
        run = int(np.searchsorted(self.units, cut, side="right")) - 1
        return int(self.start[run] + (cut - self.units[run]) * self.width[run])


def cut_up(text: bytes, h1: int, h2: int, h3: int, h4: int, plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, those of the prefix, those of the middle, output)."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    runs = Runs(text)
    n = len(runs)
    if not n or h3 % 100 >= 100 - plain_percent or p in text or s in text or m in text:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = runs.offset(a), runs.offset(b)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < suffix_first_percent:
        return n, "spm", a, b - a, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, b - a, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """One row a row of ``docs``: id, n (code points), form (plain, psm or spm),
    prefix_chars, middle_chars (null where plain) and output, the new text.

    A null text counts as empty, an empty one is plain, as is one that holds a
    sentinel. Rows that repeat an id are cut at the same hashes; a null id hashes
    as an empty one. An empty table gives no rows. Other columns are ignored, so
    their names may clash with those of the result."""
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[number(i) for i in range(4)])
    kind = dict(rows.dtypes)["id"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, hashes = b.column("text").cast(pa.large_binary()), [b.column(f"h{i + 1}").to_pylist() for i in range(4)]
            at, size, out = 0, 0, []
            for i in range(b.num_rows):
                out.append(cut_up(texts[i].as_py(), *(h[i] for h in hashes), plain_percent, suffix_first_percent))
                size += len(out[-1][-1])
                if size >= BATCH_BYTES or i + 1 == b.num_rows:
                    n, form, prefix, middle, text = zip(*out, strict=True)
                    longs = lambda x: pa.array(x, pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("id").slice(at, len(out)), longs(n), pa.array(form), longs(prefix), longs(middle), pa.array(text, pa.binary()).cast(pa.string())], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    at, size, out = i + 1, 0, []

    return rows.mapInArrow(go, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form. A text that isn't plain
    holds no sentinel, and none can arise where a part meets one."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
