"""Fill-in-middle against slicing by code points."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tideloom.llm.fim import STEP, Runs, fill_in_middle, restored

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("n", StringType()), StructField("form", StringType()), StructField("output", StringType())])


def brute(doc_id, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("seed", range(3))
def test_offsets_of_runs(seed):
    r = random.Random(seed)
    for _ in range(200):
        text = "".join(r.choice(("aé漢🙂", "abc", "éü", "漢字")[r.randrange(4)]) for _ in range(r.randrange(0, 60)))
        runs = Runs(text.encode())
        assert len(runs) == len(text)
        assert [runs.offset(i) for i in range(len(text) + 1)] == [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert len(Runs(("a" * 50 + "é" * 50).encode()).start) == 2


def test_runs_over_steps():
    text = "a" + "é漢" * 10 + "漢" * STEP + "b" * 5
    runs = Runs(text.encode())
    assert len(runs) == len(text) and len(runs.start) == 1 + 20 + 1 - 0
    assert all(runs.offset(i) == len(text[:i].encode()) for i in (0, 1, 2, 21, 22, STEP // 2, STEP, STEP + 1, len(text) - 3, len(text)))


def test_equals_slicing(spark):
    r = random.Random(8)
    rows = [(i, "".join(r.choice("aé漢🙂 <PSM>\n") for _ in range(r.randrange(0, 80))), "n", "f", None) for i in range(400)]
    rows += [(500, None, None, None, "x"), (501, "", None, None, None), (None, "no id", None, None, None), (7, "again", None, None, None), (7, "again", None, None, None), (502, "a<P>b", None, None, None)]
    rows += [(600 + i, "é" * 3_000_000 + "x", None, None, None) for i in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = fill_in_middle(docs)
    assert out.columns == ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = out.withColumn("text", restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple((v is None, v if v is not None else 0) for v in x)
    assert sorted((tuple(x) for x in back), key=key) == sorted(((i, *brute(i, t), t or "") for i, t, *_ in rows), key=key)
    assert {x.form for x in back} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0
