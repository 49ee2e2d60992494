"""The corpus operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from tests.llm.cases import values
from tidelog.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_query(spark, name, scale):
    folder = f"/root/testdata/sf{scale}"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = db.execute(queries.oracle_sql()[name]).fetchdf()
    got = queries.queries()[name](spark, folder)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert values(got, *columns) == sorted(tuple(r) for r in want[columns].itertuples(index=False))
