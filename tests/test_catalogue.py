"""Every query of the core against its SQL, on the smallest tables."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")

from loomledger.plans import catalogue  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, str(DATA))
    rows = [tuple(norm(x) for x in r) for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = con.execute(sql)
    cols = [c[0] for c in result.description]
    assert sorted(cols) == sorted(df.columns)
    want = [tuple(norm(r[cols.index(c)]) for c in df.columns) for r in result.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
