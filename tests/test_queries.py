"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tideloom.plans import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = ("lineitem", "events", "orders")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def cells(df):
    df = df[sorted(df.columns)].astype(object)
    out = []
    for row in df.where(df.notna(), None).itertuples(index=False):
        out.append(tuple("" if v is None else f"{v + 0.0:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v) for v in row))
    return sorted(df.columns), sorted(out)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = core.queries()[name](spark, DATA).toPandas()
    want = duck.execute(core.oracle_sql()[name]).df()
    assert cells(got) == cells(want)


def test_the_rest_runs(spark):
    for name in sorted(set(core.queries()) - set(core.oracle_sql())):
        assert core.queries()[name](spark, DATA).collect(), name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
