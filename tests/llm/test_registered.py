"""The registered text queries, on the smallest tables, against their SQL."""

import os
import re

import pytest

import __spark_entry__ as E

DATA = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = [m[1] for q in E.queries() if (m := re.match(r"op(\d+)_", q))]
    assert sorted(map(int, names)) == list(range(1, 11)) and "pipeline" in E.queries()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
@pytest.mark.parametrize("name", ["op1_minhash_near_dedup", "op4_exact_dedup", "op7_license_scan"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    r = con.execute(E.oracle_sql()[name])
    names, want = [c[0] for c in r.description], r.fetchall()
    got = E.queries()[name](spark, DATA)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want, key=str)
