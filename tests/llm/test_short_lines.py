"""Exact repeats of short lines go in the registered query and the pipeline; blank lines stay."""

import hashlib

import corpus_pipeline
from tidepool.llm.queries import op1_line_dedup

LONG = "a line that is long enough to be joined by edits {}"


def test_short_repeats(spark, tmp_path):
    menu = "Home\nAbout us\n\n \n"
    rows = [(1, menu + LONG.format("one")), (2, menu + LONG.format("one, here") + "\nHome"), (3, "Home\n\n" + LONG.format("one") + "\nAbout us"), (4, "home\nx\nx"), (5, None), (6, "")]
    want = {1: rows[0][1], 2: "\n \n" + LONG.format("one, here"), 3: "", 4: "home\nx", 5: None, 6: ""}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in op1_line_dedup(spark, str(tmp_path)).collect()}
    removed = {1: 0, 2: 3, 3: 3, 4: 1, 5: 0, 6: 0}
    assert got == {i: (removed[i], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in want.items()}
    kept = {r.doc_id: r.text for r in corpus_pipeline.unique_lines(spark, docs, "").collect()}
    assert kept == {1: want[1], 2: want[2], 4: want[4]}  # a whole copy leaves no stub of blanks
