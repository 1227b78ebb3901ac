"""Chunked encoding against the library on whole texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tideloom.llm import bpe
from tideloom.llm.queries import vocabulary

PATH = vocabulary()
LIBRARY = bpe.tokenizer(PATH)


def plain(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


ALPHABETS = (
    "abc de fgh  ",
    "ab'sllre'vetdm ",
    "é́ȩö x̸<",
    "İIıσΣς ß",
    "中文字漢 字",
    "각가 ",
    "0123456789.,",
    "\n\t\x85  \x1c a",
    "<|startoftext|>",
    "🙂👩‍👧 a!",
)


def texts(seed, n, length):
    r = random.Random(seed)
    for _ in range(n):
        out = []
        while sum(map(len, out)) < length:
            a = r.choice(ALPHABETS)
            out.append("".join(r.choice(a) for _ in range(r.randrange(1, 40))))
            if r.random() < 0.2:
                out.append(r.choice(("<|endoftext|>", "<|startoftext|>", "don't", "we'll've", " ")))
        yield "".join(out)


@pytest.mark.parametrize("seed", range(4))
def test_parts_cut_anywhere_join_to_the_whole(seed):
    r = random.Random(seed)
    for text in texts(seed, 120, 400):
        ends = sorted({*(r.randrange(1, len(text)) for _ in range(r.randrange(0, 12))), len(text)})
        parts = bpe.encoded(LIBRARY, [text[a:b] for a, b in zip([0, *ends], ends)])  # noqa: B905
        got = bpe.joined(text, ends, parts, lambda x: bpe.encoded(LIBRARY, x))
        assert got.tolist() == plain(text)


def test_a_long_word_and_a_special_token_over_a_joint():
    for text in ("x" * 5000, "ab" * 3000 + " end", "字" * 3000, "a <|startof" + "text|> b", "l" * 50 + "<|endoftext|>" * 40):
        for step in (7, 50, 999):
            ends = [*range(step, len(text), step), len(text)]
            parts = bpe.encoded(LIBRARY, [text[a:b] for a, b in zip([0, *ends], ends)])  # noqa: B905
            assert bpe.joined(text, ends, parts, lambda x: bpe.encoded(LIBRARY, x)).tolist() == plain(text)


def test_long_texts_go_in_segments(monkeypatch):
    monkeypatch.setattr(bpe, "WHOLE", 100)
    monkeypatch.setattr(bpe, "SEGMENT", 3000)
    r = random.Random(3)
    for text in ("don't stop, " * 3000, "".join(r.choice("abc d'sl 7é.") for _ in range(20_000)), *texts(8, 3, 12_000)):
        raw = text.encode()
        assert bpe.encode_text(LIBRARY, raw, bpe.cuts(raw), {}).tolist() == plain(text)


def test_cuts_follow_content_and_respect_code_points():
    r = random.Random(1)
    text = "".join(r.choice("abcdefghij éü漢 ") for _ in range(60_000))
    raw = text.encode()
    ends = bpe.cuts(raw)
    assert ends[-1] == len(raw) and ends == sorted(set(ends)) and max(np.diff([0, *ends])) <= bpe.MOST + 3
    assert all(raw[a:b].decode() for a, b in zip([0, *ends], ends))  # noqa: B905
    shifted = set(bpe.digests(b"head " + raw, bpe.cuts(b"head " + raw)))
    assert len(shifted & set(bpe.digests(raw, ends))) > 0.9 * len(ends)
    assert bpe.cuts(raw, step=1000) == ends
    assert bpe.cuts(b"") == [] and bpe.cuts(b"a" * 20_000)[0] == bpe.MOST


SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("ids", StringType()), StructField("row", StringType())])


def test_corpus_equals_the_library(spark):
    shared = next(texts(99, 1, 6000))
    rows = [(i, t, "x", "y") for i, t in enumerate(texts(5, 30, 3000))]
    rows += [(100 + i, f"{i} " * i + shared + "'s" * i, None, None) for i in range(30)]
    rows += [(200, None, None, None), (201, "", "a", None), (None, shared, None, "b"), (7, shared, None, None), (7, shared, None, None), (300, "word " * 40_000, None, None), (301, shared * 8, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    codes = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert codes.columns == ["id", "ids", "decoded"]
    got = sorted(((r.id is None, r.id or 0, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in codes.collect()))
    ids = [(r[0], plain(r[1] or "")) for r in rows]
    want = sorted((i is None, i or 0, tuple(x), LIBRARY.decode(x, skip_special_tokens=False)) for i, x in ids)
    assert got == want
    # a map so small that it names every chunk shared changes nothing
    again = bpe.encode(docs, PATH, bits=6)
    assert sorted(tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in again.collect()) == sorted(tuple(x) for _, x in ids)


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA), PATH), PATH).count() == 0


def test_query_equals_the_library(spark):
    import hashlib

    from tideloom.llm.queries import op12_bpe_round_trip

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op12_bpe_round_trip(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = plain(r.text)
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
