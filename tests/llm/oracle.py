"""Runs a query's SQL twin in DuckDB over the same tables."""

import glob
import os

import duckdb


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    out = con.execute(sql)
    return sorted(d[0] for d in out.description), out.fetchdf()


def same(df, sql, sf_dir):
    names, want = oracle(sql, sf_dir)
    assert sorted(df.columns) == names
    norm = lambda rows: sorted((tuple(None if v != v or v is None else v for v in r) for r in rows), key=repr)
    got = norm([tuple(r[n] for n in names) for r in df.collect()])
    cols = [want[n].astype(object).where(want[n].notna(), None).tolist() for n in names]
    fixed = [[int(v) if isinstance(v, float) and v == int(v) and k in ("bigint", "int") else v for v in c] for c, k in zip(cols, [dict(df.dtypes)[n] for n in names])]
    assert got == norm(zip(*fixed))
