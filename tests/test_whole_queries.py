"""Queries without SQL that read and return everything."""

import os

import pyarrow.parquet as pq
import pytest

from tideloom.plans import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_sweep_returns_every_combination(spark):
    rows = core.queries()["exec_sweep"](spark, DATA).collect()
    n = core.days(spark, DATA).select("symbol").distinct().count()
    assert len({(x["symbol"], x["period"]) for x in rows}) == len(rows) == 4 * n
    assert [x["total_return"] for x in rows] == sorted((x["total_return"] for x in rows), reverse=True)


def test_round_trips_of_all_line_items(spark):
    lots = {}
    for x in pq.read_table(f"{DATA}/lineitem.parquet").to_pylist():
        key = x["l_linestatus"], x["l_returnflag"] == "R"
        lots.setdefault(key, {}).setdefault(x["l_shipdate"], 0)
        lots[key][x["l_shipdate"]] += x["l_quantity"]
    want = {}
    for symbol in {s for s, _ in lots}:
        sides = [sorted(lots.get((symbol, sells), {}).items()) for sells in (False, True)]
        (i, j), left, total, trips = (0, 0), [q[0][1] if q else 0 for q in sides], 0, 0
        while i < len(sides[0]) and j < len(sides[1]):
            n = min(left)
            total, trips = total + n, trips + 1
            left = [x - n for x in left]
            if not left[0]:
                i += 1
                left[0] = sides[0][i][1] if i < len(sides[0]) else 0
            if not left[1]:
                j += 1
                left[1] = sides[1][j][1] if j < len(sides[1]) else 0
        if trips:
            want[symbol] = (float(total), trips)
    got = {x["symbol"]: (float(x["quantity"]), x["trips"]) for x in core.queries()["an_round_trips_whole"](spark, DATA).collect()}
    assert got == want and want
