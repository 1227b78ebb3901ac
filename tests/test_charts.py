"""Binary chart files in parts."""

import datetime as dt

import numpy as np
import pytest

from tideloom.sources import charts, readers

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, openinterest double"


def bars(spark, n=500, minutes=False):
    step = dt.timedelta(minutes=7) if minutes else dt.timedelta(days=1)
    rows = [(s, dt.datetime(2023, 11, 20) + step * i, float(i), i + 0.5, i - 0.25, i + 0.125, float(i * 3), float(i % 7)) for s in ("a", "b.c") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("minutes", [False, True])
def test_round_trip_in_many_tasks(spark, tmp_path, minutes):
    path = str(tmp_path / "charts")
    want = bars(spark, minutes=minutes)
    charts.write_charts(want, path, minutes)
    got = charts.read_charts(spark, path, minutes, records=60)
    assert got.rdd.getNumPartitions() == 2 * -(-500 // 60)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    one = f"{path}/a{charts.SUFFIX[minutes]}"
    assert charts.read_charts(spark, one, minutes).count() == 500
    assert sorted(map(tuple, readers.chart_binary(spark, one, minutes).collect())) == sorted(map(tuple, want.where("symbol = 'a'").collect()))


def test_bounds(spark, tmp_path):
    path = str(tmp_path / "charts")
    want = bars(spark)
    charts.write_charts(want, path)
    lo, hi = dt.datetime(2024, 1, 5), dt.datetime(2024, 3, 1)
    got = charts.read_charts(spark, path, start=lo, end=hi, records=40)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(x) for x in want.collect() if lo <= x.ts <= hi)
    sizes = got.rdd.glom().map(len).collect()
    assert sum(n == 0 for n in sizes) > len(sizes) / 2


def test_broken_records_and_nothing(spark, tmp_path):
    path = tmp_path / "charts"
    path.mkdir()
    assert charts.read_charts(spark, str(path)).count() == 0
    rows = np.zeros(2, dtype=np.dtype(readers.CHART_DAY))
    rows["day"] = [2024 * 500 + 2 * 32 + 29, 2023 * 500 + 2 * 32 + 29]
    (path / "x.fd").write_bytes(rows.tobytes() + b"cut")
    assert [x.ts for x in charts.read_charts(spark, str(path)).collect()] == [dt.datetime(2024, 2, 29), None]
    with pytest.raises(Exception, match="FileNotFoundError|nowhere"):
        charts.read_charts(spark, str(path / "nowhere")).count()
    null = spark.createDataFrame([(None, None, 1.0, None, None, None, None, None), ("n", dt.datetime(2024, 1, 1), None, 1.0, 1.0, 1.0, 1.0, 1.0)], SCHEMA)
    charts.write_charts(null, str(tmp_path / "null"))
    assert [(x.symbol, x.open) for x in charts.read_charts(spark, str(tmp_path / "null")).collect()] == [("n", 0.0)]
