"""Sections of odd documents: the same rows as SQL."""

import duckdb
import pytest

from tidepool.plans.catalog import ORACLES, QUERIES

LONG = "x" * 8100
ODD = [
    "", " ", "\n \n", "short", "# ", LONG, "# a\n" + LONG + "\n# b", "lead\n# a\n" + LONG, " \n# a\n" + LONG, LONG + "\n#\nb\n#\tc\n#d", "#\ta\n" + LONG + "\n# b", "# \n# \n" + LONG,
    "a # b\u0085# c\r# d\x0b# e\n" + LONG, "a\r\n# b\r\n" + LONG, "1\n2\n3\n4\nfive\n" + LONG + "\n7\n8\n9\n\n11\n12\n13\n14\n#\n", "中\n# " + "\U0001f600" * 8100, "\n" + " " * 8100, "##  a\n# b\n" + LONG,
]


@pytest.mark.parametrize("twice", [False, True])
def test_odd_documents(spark, tmp_path, twice):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "short"), (3, ODD[6])] * twice + [(99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.sections, r.chars) for r in QUERIES["heading_sections"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = {tuple(map(int, r)) for r in con.execute(ORACLES["heading_sections"]).fetchall()}
    assert got == found and len(got) == len(ODD) + twice
