"""Every registered query of the library proper against its SQL, on the smallest tables."""

import glob
import os

import pytest

from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toArrow()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
        return
    r = duck.execute(sql)
    names = [c[0] for c in r.description]
    want = r.fetchall()
    assert sorted(names) == sorted(got.column_names)
    rows = sorted(tuple(map(plain, x)) for x in zip(*[got.column(c).to_pylist() for c in names]))
    assert rows == sorted(tuple(map(plain, x)) for x in want)
