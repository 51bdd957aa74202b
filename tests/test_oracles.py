import glob
import os

import duckdb
import pytest

from sealwright.queries import queries
from sealwright.sql import oracle_sql

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_same_rows(spark, duck, name):
    got = queries()[name](spark, D)
    names = sorted(got.columns)
    rows = duck.execute(oracle_sql()[name])
    cols = [d[0] for d in rows.description]
    assert sorted(cols) == names
    want = sorted((tuple(r[cols.index(n)] for n in names) for r in rows.fetchall()), key=repr)
    have = sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr)
    assert len(have) == len(want) and have == want
