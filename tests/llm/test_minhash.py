"""Near duplicates against all pairs compared one by one."""

import random
import re

from tideloom.llm.minhash import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    comp = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return sorted((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, comp))


def corpus():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([5, 12, 60, 300]))]
        for _ in range(r.choice([1, 2, 9, 30])):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 18)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append(" ".join(w) if r.random() < 0.8 else "\n".join(w).upper())
    rows += [None, "", " \t\n", "one", "One", "one two", "x" * 50_000, "Été Été", "été été", " ".join(r.choice(vocab) for _ in range(30_000))]
    return list(enumerate(rows))


def test_all_links_are_found(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, component_id string")
    for k, percent in ((4, 80), (5, 80)):
        got = sorted((x["id"], x["n_shingles"], x["component_id"], x["kept"]) for x in near_duplicates(df, shingle=k, percent=percent).collect())
        assert got == brute(rows, k, percent)


def test_hot_bucket_is_searched_in_blocks(spark, monkeypatch):
    from tideloom.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 8)
    r = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((x["id"], x["n_shingles"], x["component_id"], x["kept"]) for x in near_duplicates(df, shingle=4).collect())
    assert got == brute(rows, 4, 80)


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "q r s t u"), (7, "q r s t u"), (9, "q r s t u"), (None, None)], "doc_id bigint, text string")
    got = sorted(((x["id"], x["component_id"], x["kept"]) for x in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, None)] * 3 + [(7, 7, True)] * 2 + [(9, 7, False)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0
