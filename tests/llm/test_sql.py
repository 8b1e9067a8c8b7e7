"""Queries against their SQL in DuckDB, on the tables that the driver compares."""

import glob
import math
import os

import duckdb
import pytest

from terrain_spark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    a = sorted(([r[c] for c in cols] for r in got.collect()), key=repr)
    b = sorted(([r[i] for i in at] for r in want.fetchall()), key=repr)
    if name != "op8_lm_score":
        assert a == b
        return
    key = cols.index("doc_id")
    for x, y in zip(sorted(a, key=lambda r: r[key]), sorted(b, key=lambda r: r[key]), strict=True):
        assert all(math.isclose(u, v, abs_tol=1.5e-6) if isinstance(u, float) else u == v for u, v in zip(x, y))
