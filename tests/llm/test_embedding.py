"""Links between vectors against all pairs."""

import math
import random

import pytest

from tideloom.llm import embedding
from tideloom.llm.embedding import near_vectors


def brute(rows, least):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        m = max(map(abs, v))
        n = math.sqrt(sum((x / m) ** 2 for x in v))
        return [x / m / n for x in v]

    us = [unit(v) if lab is not None else None for _, v, lab in rows]
    links = [[] for _ in rows]
    for i, a in enumerate(us):
        for j in range(i):
            b = us[j]
            if a and b and len(a) == len(b) and rows[i][2] == rows[j][2] and sum(x * y for x, y in zip(a, b, strict=True)) >= least:
                links[i].append(j)
                links[j].append(i)
    comp = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(links):
            m = min([comp[i], *(comp[j] for j in js)])
            if m != comp[i]:
                comp[i], changed = m, True
    return sorted((r[0], len(js), c, r[0] == c) for r, js, c in zip(rows, links, comp, strict=True))


@pytest.mark.parametrize(("block", "slice_", "cell"), [(1024, 8192, 512), (8, 16, 10)])
def test_all_links(spark, monkeypatch, block, slice_, cell):
    monkeypatch.setattr(embedding, "BLOCK", block)
    monkeypatch.setattr(embedding, "SLICE", slice_)
    monkeypatch.setattr(embedding, "CELL", cell)
    r = random.Random(block)
    vec = lambda: [r.gauss(0, 1) for _ in range(8)]
    rows, base = [], [vec() for _ in range(12)]
    for i in range(260):
        b = r.choice(base)
        v = [x + r.gauss(0, r.choice([0.01, 0.2, 0.4])) for x in b] if r.random() < 0.8 else vec()
        rows.append((i, v, r.choice([0, 0, 0, 1, None])))
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 8, 0), (303, [1.0, None] + [0.0] * 6, 0), (304, [float("nan")] * 8, 0), (305, [float("inf")] * 8, 0), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0), (308, [1e300] * 8, 0), (309, [1e-300] * 8, 0), (310, rows[0][1], rows[0][2]), (311, [x * 3 for x in rows[0][1]], rows[0][2])]
    df = spark.createDataFrame([(*x, 5) for x in rows], "vec_id bigint, embedding array<double>, label int, n_links int")
    got = sorted((x["id"], x["n_links"], x["component_id"], x["kept"]) for x in near_vectors(df, 0.93).collect())
    assert got == brute(rows, 0.93)


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(4, [1.0, 0.0], 1)] * 3 + [(None, [1.0, 0.01], 1)], "vec_id bigint, embedding array<float>, label int")
    got = sorted(((x["id"], x["n_links"], x["component_id"]) for x in near_vectors(df).collect()), key=str)
    assert got == sorted([(4, 3, 4)] * 3 + [(None, 3, 4)], key=str)
    assert near_vectors(df.limit(0)).count() == 0
