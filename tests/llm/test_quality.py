from pyspark.sql import functions as F

from tidepool.llm.quality import STATISTICS, document_statistics, score, train

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    stats = document_statistics(docs)
    model = train(stats, labels.where(~held))
    got = score(stats, model).join(labels, "doc_id").where(held).collect()
    right = sum(r.predicted == r.label for r in got) / len(got)
    assert len(got) > 500 and right > 0.95, right
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, "a word"), (5, "long " * 50_000), (5, "long")], "doc_id long, text string").withColumn("score", F.lit("x"))
    rows = score(document_statistics(odd), model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert document_statistics(odd.limit(0)).collect() == []
    assert len(document_statistics(odd).first().stats) == len(STATISTICS)
