"""The stages in order, each judged on what it was given."""

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(500)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        text = prose(r.randrange(30, 120))
        if i % 6 == 0:
            text += " " + " ".join(r.choice(["vile", "awful"]) for _ in range(8))
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    items = [(j, prose(30)) for j in range(3)]
    docs.append((500, docs[1][1], "en", "s0", 1))
    docs.append((501, docs[1][1] + " w1", "en", "s0", 1))
    docs.append((502, prose(20) + " " + items[0][1].upper() + " " + prose(20), "en", "s1", 1))
    docs.append((503, None, None, None, None))
    at = str(tmp_path)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    frame = spark.read.parquet(f"{at}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame_out = stage(spark, frame, at)
        frame_out.write.parquet(f"{at}/stage{k}")
        frame = spark.read.parquet(f"{at}/stage{k}")
        if k < 4:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append([x["doc_id"] for x in frame.collect()])
    toxic = {i for i in range(240) if i % 6 == 0}
    assert not toxic & set(kept[0]) and len(kept[0]) == 244 - len(toxic)
    assert set(kept[0]) - set(kept[1]) == {500, 501} and len(kept[1]) == len(set(kept[1]))
    assert set(kept[1]) - set(kept[2]) == {502}
    assert max(kept[3].count(i) for i in set(kept[3])) <= 2 and len(kept[3]) == len(kept[4])
    assert {"shard_depth", "shard_prefix", "shard_page"} <= set(frame.columns)
    empty = spark.createDataFrame([], frame_schema())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, at).count() == 0


def test_rows_not_ids_are_rejected(spark, tmp_path):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    vile = " " + " ".join(["vile", "awful"] * 5)
    docs = [(i, prose(60) + (vile if i % 6 == 0 else "")) for i in range(240)]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(240)]
    item = prose(30)
    clean, other, twin, lone, both = (prose(70) for _ in range(5))
    toxic = [(None, prose(60) + vile), (700, prose(60) + vile)]
    leak = [(None, prose(20) + " " + item), (701, prose(20) + " " + item)]
    named = (600, both)
    good = [(None, clean), (None, other), (700, prose(60)), (701, prose(60)), (600, lone), named, (None, None), (None, None), (None, " "), (702, "")]
    # Copies: of null ids, of a null id and a named one, under one id, whole rows, and one by another row of its id.
    near = [(800, twin), (800, twin + " w1")]
    copies = [(None, clean)] * 30 + [(None, other + " w2")] * 2 + [(None, both), (None, both + " w3"), named, (702, ""), (601, both), (603, both + " w4"), (603, prose(5) + " only here")]
    at = str(tmp_path)
    rows = [(*d, "en", "s0", 1) for d in docs + toxic + leak + good + near + copies]
    spark.createDataFrame(rows, frame_schema()).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    frame = spark.read.parquet(f"{at}/documents.parquet")
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, frame, at).write.parquet(f"{at}/stage{k}")
        frame = spark.read.parquet(f"{at}/stage{k}")
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        steps.append([(x["doc_id"], x["text"]) for x in frame.collect()])
    plain = [d for d in docs if d[0] % 6]
    key = lambda d: (d[0] is None, d[0] or 0, d[1] is None, d[1] or "")
    assert sorted(steps[0], key=key) == sorted(plain + leak + good + near + copies, key=key)
    assert steps[1].count((None, clean)) == 1
    assert sum(d[0] is None and d[1] in (other, other + " w2") for d in steps[1]) == 1
    assert sum(d[0] == 800 for d in steps[1]) == 1
    left = [d for d in steps[2] if d[0] is None and (d[1] or "").strip() or (d[0] or 0) >= 600]
    assert sorted(left, key=key) == sorted([d for d in left if d[0] in (None, 800)] + [good[2], good[3], (600, lone), named, (702, ""), copies[-1]], key=key) and len(left) == 9
    assert sum(d[0] is None and not (d[1] or "").strip() for d in steps[2]) == 3


def frame_schema():
    return "doc_id bigint, text string, lang string, source string, n_chars bigint"
