from pyspark.sql import functions as F

from tidepool.llm.language_id import identify, train

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs.where(~held))
    got = identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held & F.col("lang").isNotNull()).collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    assert sum(r.accepted for r in got) / len(got) > 0.98
    assert 0 < model.reject_below <= 0.5
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 %% 7", "x"), (None, "the thing and the other of it", "x"), (4, "the " * 30_000, "x"), (4, "the", "x")], "doc_id long, text string, lang_pred string")
    rows = {(r.doc_id, r.text and r.text[:3]): r for r in identify(odd, model).collect()}
    for k in ((1, None), (2, ""), (3, "12 ")):
        assert (rows[k].lang_pred, rows[k].score, rows[k].accepted) == ("und", 0.0, False)
    assert rows[(None, "the")].lang_pred == "en" and len(rows) == 5
    assert identify(odd.limit(0), model).collect() == []
