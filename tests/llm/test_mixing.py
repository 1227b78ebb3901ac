"""Targets against a plain loop; rounding against its promises."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tideloom.llm.mixing import mix, repeated, targets


def fill(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s] + 1e-9}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_targets(spark):
    r = random.Random(1)
    for sizes in ({"a": 10}, {"a": 0, "b": 0}, {"b": 5, "a": 500, None: 40, "Z": 1, "é": 7, "": 3}, {f"s{i}": r.randrange(0, 1000) for i in range(40)}):
        got = {x["source"]: x["target"] for x in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
        want = fill(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def rows(n=3000):
    r = random.Random(2)
    out = [(i, " ".join(["w"] * min(4000, int(r.paretovariate(1.1) * 5))), f"s{r.choice([0, 0, 0, 1, 2, 3])}" if r.random() < 0.98 else None) for i in range(n)]
    return out + [(None, "x y z", "s1")] * 400 + [(5, "a b", "s1"), (9, None, "s1"), (10, "", "s2"), (11, " \n", None)]


def test_promises(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash"))
    got = mix(df).collect()
    assert sum(x["rows"] for x in got) == len(data)
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for x in got:
        assert 0 <= x["copies"] <= 2 * x["rows"]
        taken[x["source"]] += x["copies"] * x["size"]
        target[x["source"]] = x["target"]
        largest[x["source"]] = max(largest[x["source"]], x["size"])
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6
    again = mix(df.repartition(7)).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_fractions_are_kept_in_expectation(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "a") for i in range(60)] + [(1000 + i, "w " * 20, "b") for i in range(60)], "doc_id bigint, text string, source string")
    count = defaultdict(int)
    for seed in range(12):
        for x in mix(df, seed=seed).collect():
            if x["source"] == "b":
                count[x["id"]] += x["copies"]
    mean = sum(count.values()) / len(count)
    assert all(abs(v - mean) < 8 for v in count.values())


def test_repeated_rows_come_out(spark):
    df = spark.createDataFrame(rows(300), "doc_id bigint, text string, source string").withColumn("extra", F.lit(1))
    mixed = mix(df)
    out = repeated(df, mixed)
    assert out.columns == df.columns
    assert out.count() == mixed.where("copies > 0").agg(F.sum("copies")).first()[0]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mix(df).count() == 0 and repeated(df, mix(df)).count() == 0


def test_very_long_text(spark):
    from pyspark.sql import functions as F

    rows = [(1, "w " * 300_000, "a"), (2, "x y", "a"), (3, "z " * 1000, "b"), (4, None, None)]
    out = mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert {r["id"]: r["size"] for r in out.collect()} == {1: 300_000, 2: 2, 3: 1000, 4: 0}
    assert out.where(F.col("copies") > 2 * F.col("rows")).count() == 0
