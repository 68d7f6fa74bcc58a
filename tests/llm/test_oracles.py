"""Registered queries of the training-data operators against their SQL."""

import math

import duckdb
import pytest

from dyadic.llm import oracles, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = queries.queries()[name](spark, DATA)
    expected = con.sql(oracles.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    order = [expected.columns.index(c) for c in columns]
    theirs = sorted((tuple(r[k] for k in order) for r in expected.fetchall()), key=repr)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert len(ours) == len(theirs)
    same = lambda a, b: math.isclose(a, b, rel_tol=1e-9) if isinstance(a, float) else a == b
    assert all(same(a, b) for x, y in zip(ours, theirs) for a, b in zip(x, y))


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]
