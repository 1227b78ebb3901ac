"""Base spans against Python's own matcher; contexts on a planted example."""

import random
import re

from tideloom.llm.pii import personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark):
    r = random.Random(1)
    texts = [None, "", "a@b.c_d@e.f", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "999.1.1.1 0001.2.3.255 1.2.3.256", "é😀 x@y.zé +1 (017) 555-7713.", "4111 1111 1111 1111", "41111111111111111 4111-1111--11111111", "5" * 40_000, "a" * 60_000 + "@b", "+1 " + "(" * 5000 + "9", "1 2" * 20_000, "a.b@c..d a@b-.c. @@ x@y"]
    alphabet = "0123456789" * 3 + " .-+()@ab_\n" * 2 + "é😀"
    texts += ["".join(r.choice(alphabet) for _ in range(r.randrange(400))) for _ in range(300)]
    for _ in range(60):
        n = "".join(r.choice("0123456789") for _ in range(r.randrange(12, 19)))
        n += next(c for c in "0123456789" if luhn(n + c))
        texts.append(f"x {n[:4]}-{n[4:]} y{n}z {n}9")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for row in personal_data(df).collect():
        assert [(m["kind"], m["start"], m["end"]) for m in row["base"]] == brute(texts[row["id"]]), texts[row["id"]]


def test_contexts_find_new_identifiers(spark):
    texts = [f"please call my phone +1 (555) 000-{i:04d} today" for i in range(12)]
    texts += ["please call my phone 5550001234 today", "order number 998877665 shipped", "again 5550001234 here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {row["id"]: [m["text"] for m in row["found"]] for row in personal_data(df).collect()}
    assert got[12] == got[14] == ["5550001234"] and got[13] == []


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, base string, found int")
    assert personal_data(df).count() == 0


def test_adjacent_identifiers_have_the_words_of_the_text_as_context(spark):
    # The second of two addresses is introduced by the first, not by a bare space.
    df = spark.createDataFrame([(1, "reach one@b.cc two@d.ee, now")], "doc_id int, text string")
    first, second = personal_data(df).collect()[0]["base"]
    assert (first["before"], first["after"], second["before"], second["after"]) == ("reach ", " ", "reach one@b.cc ", ",")


def test_hidden_identifiers_are_recovered(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeiounstr") for _ in range(r.randrange(2, 9)))
    prose = lambda: " ".join(word() for _ in range(r.randrange(5, 40)))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    texts, hidden, plain = [], {}, []
    for i in range(400):
        cue = ("password=", 'token = "', "api_key: ", "call my phone ")[i % 4]
        known = f"+1 (555) 01{i % 10}-{digits(4)}" if i % 4 == 3 else hexa((18, 40, 32, 0)[i % 4])
        if i % 3 == 0:  # of a shape that is no seed
            known = digits(9) if i % 4 == 3 else f"zx{digits(4)}-{digits(3)}q"
            hidden[i] = known
        texts.append(f"{prose()} {cue}{known}{'"' if i % 4 == 1 else ''} {prose()}")
    for i in range(400, 600):
        plain.append(i)
        texts.append(f"{prose()} order {digits(8)} {prose()} {word()}{digits(5)}x {prose()}")
    got = {row["id"]: [m["text"] for m in row["found"]] for row in personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert sum(got[i] == [t] for i, t in hidden.items()) >= 0.9 * len(hidden)
    assert all(not got[i] for i in plain)


def test_shape_alone_makes_no_find(spark):
    r = random.Random(5)
    hexa = lambda: "".join(r.choice("0123456789abcdef") for _ in range(20))
    texts = [f"w{'xyz'[i % 3] * (i + 1)} {hexa()} end" for i in range(12)]
    got = personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert not any(r["found"] for r in got)


def test_very_long_text(spark):
    text = "word " * 200_000 + "a@b.cc " * 2_000 + "password=" + "0af9" * 6
    row = personal_data(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()[0]
    assert len(row["base"]) == 2_000 and row["base"][-1]["end"] == len(text) - 34
