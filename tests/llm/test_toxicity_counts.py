"""Scores against a Kneser-Ney model of plain dictionaries with exact counts, by
both ways of reaching the values."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tideloom.llm import toxicity
from tideloom.llm.labelled import HELD_OUT, fold
from tideloom.llm.toxicity import DISCOUNT, ORDER, TOKEN, UNIFORM, WINDOW, fit_toxicity


def spaced(text):
    words = TOKEN.findall((text or "").lower())
    return " " + " ".join(words) + " " if words else ""


def grams(text):
    s = "\x02" * (ORDER - 1) + spaced(text)
    return [s[i : i + ORDER] for i in range(len(s) - ORDER + 1)] if spaced(text) else []


def model(rows):
    """difference(gram) of counts over ``rows`` (text, y)."""
    counts = Counter(), Counter()
    for text, y in rows:
        counts[y].update(grams(text))
    two = Counter(g[-2:] for g in set(counts[0]) | set(counts[1]))
    n2, t2 = defaultdict(int), defaultdict(int)
    for g, c in two.items():
        n2[g[0]] += c
        t2[g[0]] += 1
    n, t = (defaultdict(int), defaultdict(int)), (defaultdict(int), defaultdict(int))
    for y in (0, 1):
        for g, c in counts[y].items():
            n[y][g[:-1]] += c
            t[y][g[:-1]] += 1

    def p(g, y):
        at = g[-2]
        below = (max(two[g[-2:]] - DISCOUNT, 0) + DISCOUNT * t2[at] * UNIFORM) / n2[at] if n2[at] else UNIFORM
        h = g[:-1]
        return (max(counts[y][g] - DISCOUNT, 0) + DISCOUNT * t[y][h] * below) / n[y][h] if n[y][h] else below

    return lambda g: math.log(p(g, 1)) - math.log(p(g, 0))


def passage(text, difference):
    v = [difference(g) for g in grams(text)]
    if not v:
        return None
    return max(sum(v[i : i + WINDOW]) for i in range(max(1, len(v) - WINDOW + 1))) / WINDOW


def tables(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def folds(spark, ids):
    return {x["id"]: x["f"] for x in spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", fold(F.col("id")).alias("f")).collect()}


@pytest.mark.parametrize("sent", [toxicity.SENT_GRAMS, 0])
def test_as_plain_dictionaries(spark, sent):
    r = random.Random(3)
    word = lambda: "".join(chr(0x4E00 + r.randrange(3000)) if i % 2 else r.choice("abcde") for i in range(r.randrange(2, 9)))
    bad = [word() for _ in range(12)]
    docs = [(i, " ".join([word() for _ in range(60)] + [r.choice(bad) for _ in range(5 if i % 4 == 0 else 0)])) for i in range(240)]
    docs += [(300, None), (301, "..."), (302, bad[0]), (303, "x"), (304, "Ab_cD " * 9)]
    labels = [(i, int(i % 4 == 0)) for i in range(200)]
    f, text, told = folds(spark, range(240)), dict(docs), dict(labels)
    d, lab = tables(spark, docs, labels)
    m = fit_toxicity(d, lab, sent_grams=sent)
    assert (m.sent is None) == (sent == 0)
    difference = model([(text[i], y) for i, y in labels if f[i] != HELD_OUT])
    got = {x["id"]: x["difference"] for x in m.differences(d.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))).collect()}
    scores = {x["id"]: x["score"] for x in m.score(d).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        want = passage(t, difference)
        if want is None:
            assert got[i] is None and scores[i] == 0.0
        else:
            assert abs(got[i] - want) < 1e-9
            assert abs(scores[i] - 1 / (1 + math.exp(-(m.slope * want + m.intercept)))) < 1e-9
    assert sum((scores[i] >= 0.5) == (y == 1) for i, y in told.items()) > 190


def test_pieces_change_nothing(spark, monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice("ab c") for _ in range(n)) for n in (1, 3, 15, 16, 17, 40, 64, 65, 79, 80, 81, 300)] + [""]
    value = lambda hi, lo: (((hi * 31 + lo) % 1009) / 100).astype(float)
    whole = toxicity.passages([spaced(t) for t in texts], value)
    monkeypatch.setattr(toxicity, "PIECE", 20)
    assert [None if x is None else round(x, 9) for x in toxicity.passages([spaced(t) for t in texts], value)] == [None if x is None else round(x, 9) for x in whole]
    counter, want = toxicity._Counter(), Counter()
    counter.BASE = 40
    strange = "".join(chr(0x3400 + r.randrange(500)) for _ in range(400))
    for t in [*texts, strange, strange]:
        want.update(grams(t))
    seen = Counter()
    for t in [*texts, strange, strange]:
        for _, parts in toxicity._pieces([spaced(t)], 0):
            for b in counter.add(parts):
                seen += read(b)
    for b in counter.out():
        seen += read(b)
    assert seen == want


def read(batch):
    out = Counter()
    for hi, lo, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        at = [hi >> 21, hi & 0x1FFFFF, lo >> 42, lo >> 21 & 0x1FFFFF, lo & 0x1FFFFF]
        out["".join(map(chr, at))] += n
    return out


def test_every_fold_but_the_held_out_one_is_learned_from(spark):
    r = random.Random(6)
    good = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    f = folds(spark, range(400))
    toxic = {i for i in f if i % 3 == 0}
    seen = [i for i in toxic if f[i] != HELD_OUT]
    kind = {i: f"zq{'jkvwx'[k % 5]}y" for k, i in enumerate(sorted(seen))}
    docs = [(i, " ".join(r.choice(good) for _ in range(20)) + (f" {kind.get(i, 'zqjy')}" * 4 if i in toxic else "")) for i in f]
    docs += [(9000 + k, " ".join(r.choice(good) for _ in range(20)) + f" zq{c}y" * 4) for k, c in enumerate("jkvwx")]
    d, told = tables(spark, docs, [(i, int(i in toxic)) for i in f])
    by = {x["id"]: x["score"] for x in fit_toxicity(d, told).score(d).collect()}
    assert all(by[9000 + k] > 0.9 for k in range(5))


def test_expressions_over_two_words_count(spark):
    r = random.Random(8)
    good = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    fill = lambda: " ".join(r.choice(good) for _ in range(12))
    # Both words are ordinary; only one after the other are they not.
    docs = [(i, f"{fill()} {'ox uz' if i % 3 == 0 else 'uz ' + fill() + ' ox'} {fill()}") for i in range(600)]
    d, told = tables(spark, docs, [(i, int(i % 3 == 0)) for i in range(600)])
    by = {x["id"]: x["score"] for x in fit_toxicity(d, told).score(d).collect()}
    assert sum((by[i] >= 0.5) == (i % 3 == 0) for i in by) > 590
