"""Every registered query of the library against its DuckDB SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from tidepool.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.date):
        return str(v)
    return v


def rows(values):
    return sorted((tuple(map(plain, r)) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(tuple(r[c] for c in cols) for r in df.collect())
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == rows(tuple(r[names.index(c)] for c in cols) for r in found.fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["bm25_topk", "rrf_fusion", "keyword_only_ask", "alias_links", "resolve_names"])
def test_scoring_plans_have_no_loops_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Pandas" not in plan
    if name in ("alias_links", "resolve_names"):
        assert "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["import_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(text)]" in plan and "n_chars" not in plan
