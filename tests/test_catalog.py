"""Every registered query against its SQL in DuckDB."""

import datetime
import decimal
import os

import duckdb
import pytest

from dyadic.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    os.environ["TZ"] = "UTC"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(rows, columns):
    def value(v):
        if isinstance(v, float):
            return repr(v + 0.0)
        if isinstance(v, decimal.Decimal):
            return repr(float(v))
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None).isoformat()
        return repr(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(value(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    expected = db.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(expected.fetchall(), expected.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
