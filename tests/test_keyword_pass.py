"""Keyword scores of all questions are summed where a page's row is: only pages and what can reach a last place are shuffled."""

import re

from tidepool.operators import retrieval as R
from tidepool.plans.catalog import QUERIES


def test_pairs_stay_in_their_task(spark):
    pages = spark.createDataFrame([(f"p{i}", " ".join(f"w{j}" for j in range(i % 9))) for i in range(50)], "page_slug string, text string")
    t = R.term_table(pages, spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(8)], "query_id long, query string"))
    assert dict(t.pages.dtypes)["held"] == "array<int>" and dict(t.terms.dtypes)["term"] == "int"
    values = R._keyword_values(t.pages.selectExpr("*", "1.0d as weight"), t.terms)
    dealt = [x for x in re.findall(r"(?<!Broadcast)Exchange (\w+\([^)]*\))", values._jdf.queryExecution().executedPlan().toString())]
    assert [x for x in dealt if "(page_slug" not in x] == [] and len(dealt) == 1
    assert values.count() == sum(1 for i in range(50) for q in range(8) if q < i % 9)


def test_texts_of_other_types_are_not_shuffled(spark, monkeypatch):
    """What typed_ask deals by page: the texts of one type in seven."""
    dealt = []
    monkeypatch.setattr(R, "_dealt", lambda df, deal=R._dealt: (dealt.append(df), deal(df))[1])
    assert QUERIES["typed_ask"](spark, "/root/testdata/sf0.001").count() > 0
    plan = dealt[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and dealt[0].count() * 6 < spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_no_functions_over_the_terms_of_each_pair(spark):
    """Questions and pages meet in joins by number, not by comparing two arrays of words for each pair."""
    assert "lambda" not in QUERIES["rrf_fusion"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
