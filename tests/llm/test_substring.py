"""Repeated passages against a count of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from tideloom.llm import substring
from tideloom.llm.substring import matches, repeated_passages


def brute(rows, length):
    datas = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, datas, strict=True):
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(d)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df, length):
    return sorted(((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_passages(df, length).collect()), key=str)


def corpus(seed, length):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(r.randrange(5, 40)) for _ in range(6)]
    rows = [None, "", "x", "a" * (3 * length), "ab" * length, "a" * length]
    for _ in range(60):
        rows.append(prose(r.randrange(0, 60)) + r.choice(["", *shared]) + prose(r.randrange(0, 30)) + r.choice(["", *shared, "Er " * 80]))
    rows += [rows[10], rows[11], rows[11], prose(3000) + shared[0] + prose(50)]
    return [(i if i % 17 else None, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("length", "index", "piece"), [(40, 2_000_000, 1 << 19), (40, 600, 300), (60, 2000, 1 << 19)])
def test_removed_bytes(spark, monkeypatch, length, index, piece):
    monkeypatch.setattr(substring, "INDEX_BYTES", index)
    monkeypatch.setattr(substring, "PIECE", piece)
    rows = corpus(length + index, length)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, n_removed int")
    assert result(df, length) == brute(rows, length)


def test_index():
    r = random.Random(1)
    for _ in range(150):
        length, alphabet = r.choice([8, 9, 20]), r.choice([b"ab", b"abc", b"\x00\xff", b"abcdefgh"])
        segs = [bytes(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(r.randrange(1, 8))]
        segs.append(segs[0][3:] + segs[-1][:30])
        seen = Counter(s[i : i + length] for s in segs for i in range(len(s) - length + 1))
        assert [g.tolist() for g in matches(segs, length)] == [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in segs]


def test_empty(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
