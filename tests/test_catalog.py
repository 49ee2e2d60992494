"""Every query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidelog.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    shown = lambda x: "~" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)
    return sorted(tuple(map(shown, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, db, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), db.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.queries()) <= set(entry.queries())
