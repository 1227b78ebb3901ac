"""Shards against splitting by hand."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tideloom.llm.sharding import shards, with_shards


def brute(rows, limit):
    keyed = []
    for i, t in rows:
        t = t or ""
        h = hashlib.md5(("" if i is None else str(i)).encode() + b"\x1f" + hashlib.md5(t.encode()).hexdigest().encode()).hexdigest()
        keyed.append((int(h[:15], 16), i, len(t.encode())))
    out = []

    def split(part, depth, prefix):
        total = sum(b for _, _, b in part)
        if total <= limit or len({h for h, _, _ in part}) == 1:
            out.extend((i, b, depth, prefix, total) for _, i, b in part)
            return
        for bit in (0, 1):
            half = [p for p in part if (p[0] >> (59 - depth)) & 1 == bit]
            if half:
                split(half, depth + 1, prefix * 2 + bit)

    split(keyed, 0, 0)
    return out


@pytest.mark.parametrize("limit", [1, 50, 2000, 10**9])
def test_directory(spark, limit):
    r = random.Random(limit)
    rows = [(i, "é" * r.randrange(0, 60)) for i in range(400)] + [(None, "n"), (None, None), (3, "z" * 5000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, depth int")
    got = [(x["id"], x["bytes"], x["depth"], x["prefix"], x["page"]) for x in shards(df, limit).collect()]
    assert Counter(g[:4] for g in got) == Counter(w[:4] for w in brute(rows, limit))
    held = defaultdict(list)
    for _, b, d, p, page in got:
        held[d, p, page].append(b)
    assert all(sum(v) <= limit or len([b for b in v if b]) == 1 for v in held.values())


def test_equal_rows_go_to_pages(spark):
    df = spark.createDataFrame([(7, "x" * 100)] * 50 + [(8, "y")], "doc_id bigint, text string")
    got = shards(df, 1000).collect()
    pages = Counter(x["page"] for x in got if x["id"] == 7)
    assert len(got) == 51 and len(pages) == 5 and max(pages.values()) == 10
    out = with_shards(df, 1000)
    assert out.columns == ["doc_id", "text", "shard_depth", "shard_prefix", "shard_page"]
    assert max(Counter(x["shard_page"] for x in out.where("doc_id = 7").collect()).values()) == 10 and out.count() == 51


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert shards(df, 10).count() == 0 and with_shards(df, 10).count() == 0


def test_many_equal_rows_over_many_parts(spark):
    df = spark.createDataFrame([(7, "x" * 10, i) for i in range(3000)] + [(i, "y" * (i % 40), i) for i in range(500)], "doc_id bigint, text string, n int").repartition(13)
    for rows in (shards(df, 1000).where("id = 7 and bytes = 10").collect(), with_shards(df, 1000).where("doc_id = 7 and n >= 0 and length(text) = 10").collect()):
        pages = Counter(x["page"] if "page" in x else x["shard_page"] for x in rows)
        assert sorted(pages.values()) in ([100] * 30, [1] + [100] * 30)


def test_columns_that_clash_and_very_long_texts(spark):
    rows = [(1, "a", 5, 6, 7, "h"), (1, "a" * 400_000, 5, 6, 7, "h"), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard_depth int, shard_prefix bigint, shard_page bigint, h string")
    out = with_shards(df, 1000)
    assert out.columns == ["doc_id", "text", "h", "shard_depth", "shard_prefix", "shard_page"]
    assert sorted((x["doc_id"], len(x["text"] or "")) for x in out.collect()) == [(1, 1), (1, 400_000), (2, 0)]
    assert Counter((x["shard_depth"], x["shard_prefix"], x["shard_page"]) for x in out.collect()) == Counter((x["depth"], x["prefix"], x["page"]) for x in shards(df, 1000).collect())
    again = with_shards(out, 1000)
    assert again.columns == out.columns and sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
