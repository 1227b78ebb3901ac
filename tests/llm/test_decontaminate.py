"""Edit matches against dynamic programming."""

import random

from tideloom.llm.decontaminate import _anchored, _masks, best_end, budget, leaks, normal


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(last[j - 1] + (p != c), last[j] + 1, row[-1] + 1))
    return min(row)


def edited(r, text, n):
    out = list(text)
    for _ in range(n):
        at = r.randrange(len(out))
        out[at : at + 1] = r.choice([[], [r.choice("abcxyz ")], [out[at], r.choice("abcxyz")]])
    return "".join(out)


def test_myers():
    r = random.Random(2)
    for _ in range(300):
        p = "".join(r.choice("ab c") for _ in range(r.randrange(1, 90)))
        t = "".join(r.choice("ab c") for _ in range(r.randrange(0, 120)))
        assert best_end(p, _masks(p), t)[0] == distance(p, t)


def test_every_match_within_budget(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 8)))
    items = [(i, " ".join(word() for _ in range(r.randrange(8, 40)))) for i in range(12)]
    docs = []
    for i in range(150):
        body = [" ".join(word() for _ in range(r.randrange(0, 60))) for _ in range(2)]
        t = r.choice(items)[1]
        k = budget(len(normal(t)))
        leak = edited(r, t, r.choice([0, 0, 1, k // 2, k, k + 3, 3 * k])) if r.random() < 0.7 else ""
        docs.append((i, body[0] + r.choice(["\n", " ", ""]) + (leak.upper() if r.random() < 0.3 else leak) + "  \t" + body[1]))
    docs += [(900, None), (901, ""), (902, "é" * 20_000), (None, items[0][1])]
    got = {(x["id"], x["item"]): x["distance"] for x in leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*items, (50, None), (51, ""), (52, " \t")], "item_id bigint, text string")).collect()}
    want = {}
    for i, t in docs:
        for n, item in items:
            d = distance(normal(item), normal(t))
            if d <= budget(len(normal(item))):
                want[i, n] = d
    assert got == want and len(want) > 60


def test_places_are_in_the_original(spark):
    item = "The quick brown fox jumps over the lazy dog near the river bank"
    doc = "Été  \n" + item.upper().replace(" ", "\n  ") + " end"
    (row,) = leaks(spark.createDataFrame([(1, doc, "x")], "doc_id int, text string, item string"), spark.createDataFrame([(3, item)], "item_id int, text string")).collect()
    assert row["distance"] == 0 and normal(doc[row["start"] : row["end"]]) == normal(item)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks(docs, items).count() == 0


def test_short_items(spark):
    docs = [(1, "so the answer here is 42 ok and more"), (2, "So the Answer  here is 421"), (3, "an art of a party"), (4, "art"), (5, "the answre here is 42"), (6, "(art)")]
    items = [(1, "the answer here is 42"), (2, "the answer here is 42 ok"), (3, "art"), (4, "x"), (5, None), (6, " ")]
    got = {(x["id"], x["item"]): (x["distance"], x["start"], x["end"]) for x in leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), whole_words=True).collect()}
    assert got.pop((2, 1))[0] == 1  # one digit more, and the word ends there
    assert got == {(1, 1): (0, 3, 24), (1, 2): (0, 3, 27), (3, 3): (0, 3, 6), (4, 3): (0, 0, 3), (5, 1): (2, 0, 21), (6, 3): (0, 1, 4)}


def test_short_items_against_all_substrings(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abc1") for _ in range(r.randrange(1, 5)))
    items = [(i, " ".join(word() for _ in range(r.randrange(1, 6)))[:23].strip()) for i in range(30)]
    docs = [(i, " ".join(word() for _ in range(r.randrange(0, 25)))) for i in range(60)]
    want = {}
    for i, t in docs:
        t = normal(t)
        edge = lambda k, t=t: k in (0, len(t)) or not (t[k - 1].isalnum() and t[k].isalnum())
        for n, item in items:
            for a in range(len(t)):
                for b in range(a + 1, min(len(t), a + len(item) + 3) + 1) if edge(a) else ():
                    if edge(b) and abs(b - a - len(item)) <= budget(len(item)):
                        d = whole_distance(item, t[a:b])
                        if d <= budget(len(item)):
                            want[i, n] = min(want.get((i, n), d), d)
    got = {(x["id"], x["item"]): x["distance"] for x in leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), whole_words=True).collect()}
    assert got == want and len(want) > 40


def whole_distance(a, b):
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        last, row = row, [i]
        for j, c in enumerate(b, 1):
            row.append(min(last[j - 1] + (p != c), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_anchored_distance():
    r = random.Random(4)
    for _ in range(200):
        p = "".join(r.choice("ab c") for _ in range(r.randrange(1, 70)))
        t = "".join(r.choice("ab c") for _ in range(r.randrange(0, 60)))
        assert list(_anchored(p, _masks(p), t)) == [whole_distance(p, t[:i]) for i in range(1, len(t) + 1)]


def test_items_of_23_and_24_characters_behave_alike(spark):
    items = [(n, "abcdefghij klmnopqrstuvwxyz"[:n]) for n in (9, 23, 24, 27)]
    docs = [(1, "zz" + items[3][1] + "zz"), (2, "zz " + items[3][1] + ", zz"), (3, "x abcdefghij klmnopqrstuv y")]
    run = lambda **how: {(x["id"], x["item"]) for x in leaks(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), **how).collect()}
    assert run() == {(d, n) for d in (1, 2) for n in (9, 23, 24, 27)} | {(3, 9), (3, 23), (3, 24)}
    assert {n for d, n in run(whole_words=True) if d == 1} == set() and {(2, 27), (3, 23), (3, 24)} <= run(whole_words=True)


def test_a_text_full_of_piece_hits(spark):
    item = "abc abd abe abf abg abh abi abj abk abl"
    docs = [(1, "abc abd " * 20_000), (2, "abc abd " * 3000 + item)]
    got = {(x["id"], x["distance"]) for x in leaks(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(1, item)], "item_id int, text string")).collect()}
    assert got == {(2, 0)}
