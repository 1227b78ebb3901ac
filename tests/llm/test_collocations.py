"""Collocations against dictionaries of all phrases."""

import os
import random
import re
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tideloom.llm.collocations import _FOLD, Automaton, collocations

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("rank", StringType()), StructField("phrase", StringType()), StructField("n", StringType())])


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    for piece in re.split("[.,;:!?\n-\r]", low):
        yield re.findall("[^ \t]+", piece)


def brute(rows, least, longest, covered, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, *w[i : i + k]] += 1
    found = {}
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    for (lang, *w), a in candidates.items():
        best = min((2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w)))
        held = any(q[0] == lang and len(q) > len(w) + 1 and any(list(q[i : i + len(w)]) == w for i in range(1, len(q) - len(w) + 1)) and 100 * b >= covered * a for q, b in candidates.items())
        if not held:
            score, k = best
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    out = []
    for lang, xs in found.items():
        for i, (s, a, p, left, right) in enumerate(sorted(xs)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["The", "cat", "é", "漢字", "new", "york", "city", "hall", "x\x00y", "İ", "a", "b-c"]
    phrases = ["new york city hall", "New York City", "the cat", "a a a a a", "漢字 é"]
    rows = []
    for i in range(n):
        out = []
        for _ in range(r.randrange(0, 60)):
            out.append(r.choice(phrases) if r.random() < 0.3 else r.choice(words))
            out.append(r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b", "\x85", " "]))
        rows.append((i, "".join(out), r.choice(["en", "de", None, "und", ""]), "1", "p", None))
    return rows + [(None, None, "en", None, None, None), (1, "", None, None, None, None), (2, "...", "fr", None, None, None), (3, "new york " * 5000, "en", None, None, None)] * 2


@pytest.mark.parametrize("block", [200, 4000, 8 << 20])
def test_equals_dictionaries(spark, block):
    rows = corpus(block)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for least, longest, top in ((5, 4, 2000), (3, 3, 7), (4, 2, 5)):
        got = sorted(tuple(x) for x in collocations(docs, least=least, longest=longest, top=top, block=block, bits=12).collect())
        assert got == brute(rows, least, longest, 80, top)
    if block == 200:
        assert sorted(tuple(x) for x in collocations(docs, least=5, top=None, block=block).collect()) == brute(rows, 5, 4, 80, None)


def shuffle_files(spark):
    at = Path(os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", "/tmp"))
    return {f for m in at.glob("**/blockmgr-*") for f in m.glob("*/shuffle_*.data")}


def test_passes_over_the_texts_leave_no_shuffle_files(spark):
    docs = spark.createDataFrame(corpus(1), SCHEMA).repartition(3)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    mode, before = spark.conf.get(key, None), shuffle_files(spark)
    out = collocations(docs, least=5, top=None, block=4000, bits=12)
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(key, None) == mode
    for _ in range(2):
        assert sorted(map(tuple, out.collect())) == brute(corpus(1), 5, 4, 80, None)


def test_states_share_their_links_counts():
    a = Automaton(b"x y z\xffx y z\xffq y".translate(_FOLD))
    for _ in range(3):
        a.grow()
    found = Counter()
    for level, which, count in a.classes(1, 4):
        found.update(dict(zip(a.phrases(level, which).to_pylist(), count.tolist(), strict=True)))
    assert found == {b"x": 2, b"y": 3, b"z": 2, b"q": 1, b"x y": 2, b"y z": 2, b"q y": 1, b"x y z": 2}


def test_empty_and_wordless(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, None, None, None, None, None), (2, " .", "en", None, None, None)], SCHEMA)).count() == 0
