"""The queries of this subpackage that SQL can express, against it."""

import duckdb
import pytest

from tests.test_queries import SF, TABLES, rows
from tidepool.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, found = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    cols, names = sorted(df.columns), [d[0] for d in found.description]
    assert sorted(names) == cols
    got = rows(tuple(r[c] for c in cols) for r in df.collect())
    assert got and got == rows(tuple(r[names.index(c)] for c in cols) for r in found.fetchall())
