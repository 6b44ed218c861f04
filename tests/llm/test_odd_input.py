"""Every registered query of this subpackage, and the pipeline, on odd rows, on empty tables and beside columns of any name."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_collocations import brute as brute_phrases
from tests.llm.test_spelling import brute as brute_spelling
from tidepool.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997}" for i in range(20_000))
WORDS = "the quick brown fox jumps over the lazy dog and runs away from the old house on the hill near the river"
ROWS = [
    (None, None), (None, ""), (None, WORDS), (None, WORDS), (1, WORDS), (1, WORDS), (1, WORDS + " again"), (2, None), (3, ""), (4, " \n\t"), (5, "..."), (6, LONG), (7, LONG), (8, "x" * 50_000),
    (9, "\n".join([WORDS] * 3)), (10, "Müller straße 北京 \x00 \x1c end"), (11, "a"), (12, "token = \"" + "Ab1" * 9000 + "\""),
]
#: Names that the operators use inside.
CLASHES = ("rid", "th", "h1", "h2", "s1", "n", "k", "words", "item", "removed", "lines", "label", "score", "piece", "length", "offset", "cells", "cell", "class", "_bad", "_gone", "_text")


def folder(spark, path, empty):
    keep = F.lit(not empty)
    docs = spark.createDataFrame([(i, t, ["en", None, "de"][k % 3], "s", None) for k, (i, t) in enumerate(ROWS)], DOCS)
    docs = docs.withColumns({c: F.lit(7) for c in CLASHES})
    vectors = [(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [2.0, 4.0], 1), (6, [1.0, 2.0], None), (7, [float("nan"), 1.0], 1), (8, [-1.0, -2.0], 1), (9, [], 1), (10, [1.0], 1)]
    tables = {
        "documents": docs,
        "benchmark": spark.createDataFrame([(1, WORDS), (None, "a"), (2, None), (3, ""), (3, LONG[:3000])], "item_id long, text string").withColumns({c: F.lit(7) for c in ("seed", "q", "words", "ih")}),
        "labels": spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 1), (6, 0, None), (9, None, 0)], "doc_id long, quality int, toxic int"),
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(7) for c in ("rep", "dim", "h1", "copies", "sound")}),
    }
    for name, df in tables.items():
        df.where(keep).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("odd"), False)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("empty"), True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    if name.startswith(("op3", "op6")):
        assert len(rows) == len({tuple(r) for r in rows}) or name.startswith("op3")
        assert name.startswith("op3") or {(r.doc_id, r.item_id) for r in rows} >= {(1, 1), (None, 1), (9, 1), (6, 3), (7, 3), (11, None)}
    elif name.startswith("op7"):
        assert sorted((r.vec_id or 0, r.n_links) for r in rows) == sorted([(0, 0), (1, 2), (1, 2), (2, 0), (3, 0), (4, 0), (5, 2), (6, 0), (7, 0), (8, 0), (9, 0), (10, 0)])
    elif name.startswith("op9"):
        assert sorted({(r.doc_id or 0) for r in rows}) == sorted({i or 0 for i, _ in ROWS}) and sum(r.piece == 0 for r in rows) == len(ROWS)
    elif name.startswith("op12"):
        want = brute_spelling([(r.doc_id, r.text) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()], 199)
        assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == want and len(rows) == len(want)
    elif name.startswith("op13"):
        docs = [(r.lang, r.text) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
        assert sorted(tuple(r) for r in rows) == brute_phrases(docs)
    else:
        assert len(rows) == len(ROWS) and sorted((r.doc_id or 0) for r in rows) == sorted(i or 0 for i, _ in ROWS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_pipeline_stages(spark, odd, empty):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, odd)
        assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).collect() == []
        assert out.columns == list(corpus_pipeline.COLUMNS) or "sequence_id" in out.columns
        out.collect()
    assert corpus_pipeline.run(spark, empty).collect() == []
    pieces = corpus_pipeline.run(spark, odd).collect()
    kept = {r.doc_id for r in pieces}
    assert 8 in kept and not kept & {1, 3, 6, 7, 9}  # without text, or with a benchmark passage


def test_a_corpus_without_labels_stays(spark):
    docs = spark.createDataFrame([(1, WORDS, None, "s", 0), (2, "12 34", None, "s", 0), (3, None, None, "s", 0)], DOCS)
    assert [r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()] == [1]


def test_ties_of_scores_and_copies(spark):
    """Repeated rows have one score; a class of copies keeps the smallest id; equal texts under two ids are links of each other."""
    from tidepool.llm.jaccard_join import jaccard_components

    rows = [(i, WORDS) for i in (9, 4, 4, 7)]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(4, 4), (4, 4), (7, 4), (9, 4)]


def test_language_scores_are_those_of_a_plain_loop(spark):
    """The score of a text, worked out n-gram by n-gram from the trained table."""
    import numpy as np

    from tidepool.llm import language_id
    from tidepool.llm._words import batch_words
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs, sample=200, epochs=2)
    texts = [r.text for r in docs.where("text is not null").limit(12).collect()] + ["One word", "x"]
    got = {r.text: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), model).collect()}
    for text in texts:
        if not any(c.isalpha() for c in text):
            continue
        total, n = np.zeros(len(model.languages)), 0
        for word in text.split():
            w = next(batch_words(pa.array([word]), lower=True))
            _, found, _ = language_id.word_buckets(w)
            total += model.table[found].astype(np.float64).sum(0)
            n += len(found)
        z = (total / n + model.bias) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        assert got[text][0] == model.languages[int(p.argmax())] and abs(got[text][1] - p.max()) < 1e-6


def test_quality_scores_are_those_of_the_densities(spark):
    """The discriminant worked out from the labelled rows with numpy's own covariance, determinant and inverse."""
    import numpy as np

    from tidepool.llm import quality

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    stats = quality.document_statistics(spark.read.parquet(f"{sf}/documents.parquet"))
    got = {r.doc_id: r.score for r in quality.score(stats, quality.train(stats, labels)).collect()}
    rows = stats.join(labels, "doc_id").where("label is not null").collect()
    x, y = np.array([r.stats for r in rows]), np.array([r.label for r in rows])
    own = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * own[c] for c in (0, 1))
    spread = np.diag(np.maximum(np.diag(pooled), 1e-4))
    density = []
    for c in (0, 1):
        cov, d = 0.95 * (0.9 * own[c] + 0.1 * pooled) + 0.05 * spread, x - x[y == c].mean(0)
        density.append(np.log((y == c).mean()) - np.linalg.slogdet(cov)[1] / 2 - np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) / 2)
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -50, 50)))
    assert max(abs(got[r.doc_id] - w) for r, w in zip(rows, want, strict=True)) < 1e-6
