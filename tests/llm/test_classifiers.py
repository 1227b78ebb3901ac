"""Held-out accuracy and odd rows of the two classifiers."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tideloom.llm.labelled import HELD_OUT, fold
from tideloom.llm.quality import fit_quality
from tideloom.llm.toxicity import fit_toxicity

DATA = "/root/testdata/sf0.1"
FITS = {"toxic": fit_toxicity, "quality": fit_quality}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize(("label", "least", "want"), [("toxic", 0.3, 0.94), ("quality", 0.7, 0.97)])
def test_held_out_accuracy(spark, label, least, want):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    scores = FITS[label](docs, labels).score(docs)
    held = scores.where(fold(F.col("id")) == HELD_OUT).join(labels, F.col("id") == F.col("doc_id"))
    right = held.agg(F.avg(((F.col("score") >= least).cast("int") == F.col(label)).cast("double"))).first()[0]
    assert right >= want


@pytest.mark.parametrize("label", FITS)
def test_odd_rows(spark, label):
    r = random.Random(1)
    good, bad = [f"word{i}" for i in range(50)], ["vile", "awful", "rotten"]
    rows = [(i, " ".join(r.choice(good) for _ in range(40)) + (" " + " ".join(r.choice(bad) for _ in range(6)) if i % 4 == 0 else ""), "x") for i in range(400)]
    rows += [(None, "a b", "x"), (900, None, "x"), (901, "", "x"), (902, "é" * 50_000, "x"), (903, "w " * 50_000, "x"), (1, rows[1][1], "x")]
    labels = [(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None), (3, 0), (3, 0), (10_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    told = spark.createDataFrame(labels, f"doc_id bigint, {label} int")
    got = [(x["id"], x["score"]) for x in FITS[label](docs, told).score(docs).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    assert sum((by[i] >= 0.5) == (i % 4 == 0) for i in range(400)) > 360
    nothing = FITS[label](docs, told.limit(0)).score(docs).collect()
    assert {x["score"] for x in nothing} == {0.0}
    assert FITS[label](docs.limit(0), told).score(docs.limit(0)).count() == 0


def test_quality_as_means_of_vectors():
    import numpy as np

    from tideloom.llm import quality

    r = random.Random(7)
    words = ["".join(r.choice("abcdé日") for _ in range(r.randrange(1, 12))) for _ in range(60)]
    texts = [" ".join(r.choice(words[:30] if i % 2 else words[20:]) for _ in range(r.randrange(1, 40))) for i in range(80)]
    model = quality.train(texts, np.array([i % 2 for i in range(80)]))
    cache = {}
    for text in [*texts, "", "  ", "new " * 3, "x" * 500]:
        tokens = quality.TOKEN.findall(text)
        names = quality._token_hash(tokens)
        means = []
        for i, t in enumerate(tokens):
            buckets = quality.token_grams([t])[0].tolist()
            if i:
                buckets.append(int(quality.pair_bucket(names[i - 1 : i], names[i : i + 1])[0]))
            means.append(np.mean([float(model.odds[b]) for b in buckets]))
        want = (np.mean(means) if means else 0.0) + model.bias
        assert abs(model._logit(text, cache) - want) < 1e-6


@pytest.mark.parametrize("label", FITS)
def test_columns_that_clash(spark, label):
    names = "y int, fold int, id string, score double, difference double, o bigint, hi bigint"
    rows = [(i, "good words here" if i % 2 else "vile words here", *[None] * 7) for i in range(60)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, {names}")
    told = spark.createDataFrame([(i, (i + 1) % 2, *[None] * 3) for i in range(60)], f"doc_id bigint, {label} int, text string, y int, fold int")
    got = FITS[label](docs, told).score(docs).collect()
    assert len(got) == 60 and got[0].asDict().keys() == {"id", "score"}
