"""Rows without an id, or with one id and different texts, go or stay by their own text."""

import corpus_pipeline
from tidepool.llm.decontamination import decontaminate
from tidepool.llm.jaccard_join import jaccard_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(tag, n=60):
    return " ".join(f"{tag}{i}" for i in range(n))


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_copies(spark):
    copy = lambda tag: text(tag) + " more"
    rows = [(3, text("a")), (None, copy("a")), (7, text("b")), (None, copy("b")), (None, text("c")), (9, text("d")), (9, text("e")), (12, copy("e")), (13, copy("d"))]
    docs = rows_of(spark, rows)
    want = [(3, text("a")), (7, text("b")), (None, text("c")), (9, text("d")), (9, text("e"))]
    assert kept(corpus_pipeline.one_of_near_copies(spark, docs, "")) == sorted(want, key=str)
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_components(docs).collect()), key=str)
    assert got == sorted([(3, 3), (None, 3), (7, 7), (None, 7), (None, None), (9, 9), (9, 9), (12, 9), (13, 9)], key=str)


def test_benchmark(spark, tmp_path):
    spark.createDataFrame([(1, text("q", 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, text("q", 20) + " x"), (None, text("a")), (4, text("q", 20) + " y"), (4, text("b"))]
    docs, want = rows_of(spark, rows), [(4, text("b")), (None, text("a"))]
    assert kept(corpus_pipeline.without_benchmark(spark, docs, str(tmp_path))) == want
    docs = docs.withColumns({c: docs.doc_id for c in ("_bad", "rid", "h1", "_rid", "overlapping")})
    assert kept(corpus_pipeline.without_benchmark(spark, docs, str(tmp_path))) == want
    assert kept(decontaminate(docs, spark.read.parquet(str(tmp_path / "benchmark.parquet")))) == want
