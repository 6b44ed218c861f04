"""Near copies between 80 and 90 % are copies for the pipeline."""

import corpus_pipeline
from tests.llm.test_jaccard_join import sets_of


def test_copies_at_eighty_percent_go(spark):
    rows = []
    for k, n in enumerate((50, 70, 90)):
        w = [f"t{k}w{i}" for i in range(n)]
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join([*w[: n // 2], "changed", *w[n // 2 + 1 :]]))]
        a, b = (sets_of(t, 5) for _, t in rows[-2:])
        assert 0.8 <= len(a & b) / len(a | b) < 0.9
    w = [f"far{i}" for i in range(40)]  # one word of forty: 31 of 41
    rows += [(90, " ".join(w)), (91, " ".join([*w[:20], "changed", *w[21:]]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, "").collect()} == {0, 10, 20, 90, 91}
