"""Grams of tokens of any length against plain loops."""

import random
from collections import Counter

import numpy as np

from tideloom.llm import quality
from tideloom.llm.quality import BUCKETS, _document, _token_hash, gram_groups, token_grams, train


def counted(tokens):
    out = Counter()
    for bucket, owner in gram_groups(tokens):
        out.update(zip(owner.tolist(), bucket.tolist(), strict=True))
    return out


def test_all_characters_count():
    r = random.Random(8)
    base = "".join(r.choice("abcdef") for _ in range(60))
    ends = ["x" * 40, "q" * 40]
    a, b = (counted([base + e]) for e in ends)
    assert a != b and sum(a.values()) == sum(100 + 2 - n + 1 for n in (3, 4, 5)) + 1
    texts = [base + "".join(r.choice("ghijk" if i % 2 else "lmnop") for _ in range(60)) for i in range(120)]
    m = train(texts, np.array([i % 2 for i in range(120)]))
    assert m._logit(base + "ghijk" * 12, {}) > m._logit(base + "lmnop" * 12, {}) + 1


def test_pieces_are_as_the_whole(monkeypatch):
    r = random.Random(2)
    tokens = ["".join(r.choice("abc\u4e2d\u00e9") for _ in range(n)) for n in (1, 2, 3, 5, 30, 31, 32, 33, 64, 65, 200, 4, 1)]
    want = Counter(zip(*(x.tolist() for x in token_grams(tokens)[::-1]), strict=True))
    names = _token_hash(tokens)
    whole = _document(" ".join(tokens))
    model = quality.QualityModel(np.random.default_rng(1).normal(size=BUCKETS), 0.0, 0.5)
    logit = model._logit(" ".join(tokens), {})
    monkeypatch.setattr(quality, "PIECE", 32)
    assert counted(tokens) == want and (_token_hash(tokens) == names).all()
    parts = _document(" ".join(tokens))
    assert (parts[0] == whole[0]).all() and np.allclose(parts[1], whole[1]) and abs(whole[1].sum() - 1) < 1e-9
    cache = {}
    assert abs(model._logit(" ".join(tokens), cache) - logit) < 1e-9 and all(len(t) <= quality.CACHED_CHARS for t in cache)
