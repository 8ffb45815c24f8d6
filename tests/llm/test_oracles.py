"""Queries that SQL can express against their SQL in DuckDB."""

import glob
import os

import duckdb
import pytest
from memloom.llm import registry

SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(r[c] for c in columns) for r in got.collect())
    assert rows == sorted(want.fetchall())
