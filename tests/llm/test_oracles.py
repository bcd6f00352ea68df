"""Registered queries against their DuckDB equivalents."""

import glob
import os

import duckdb
import pytest

from quarry.llm import queries

D = "/root/testdata/"


@pytest.mark.parametrize(("name", "sf"), [*[(n, "sf0.01") for n in sorted(queries.oracle_sql())], ("op8_quality_rules", "sf0.1")])  # cutoffs are certified at 0.1 only
def test_query_equals_sql(spark, name, sf):
    con = duckdb.connect()
    for p in glob.glob(f"{D}{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df, want = queries.queries()[name](spark, D + sf), con.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    pick = lambda rows, names: sorted(tuple(r[names.index(c)] for c in order) for r in rows)
    assert pick(df.collect(), df.columns) == pick(want.fetchall(), want.columns)
