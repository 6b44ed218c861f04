"""Each stage of the pipeline against brute force on what the stage before kept."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_jaccard_join import brute as classes
from tests.llm.test_line_dedup import brute as lines

SF = "/root/testdata/sf0.001"


def without_repeats(docs):
    """Texts without near repeats of long lines and exact repeats of any that is not blank; blank documents go."""
    near = {i: x[2].split("\n") for i, x in lines(docs, 2, 40).items()}
    seen, out = set(), {}
    for i, text in sorted(docs):
        kept, left = [], list(near[i])
        for line in text.split("\n"):
            # what the near search keeps comes in order
            if left and left[0] == line:
                left.pop(0)
                again = line in seen and line.strip(" \t\r")
                seen.add(line)
                if not again:
                    kept.append(line)
        if "".join(kept).strip():
            out[i] = "\n".join(kept)
    return out


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    have, tokenizer = docs, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for name, stage in corpus_pipeline.STAGES:
        if name == "ngram_jaccard":
            # the stage before leaves no near copies of these small tables
            copies = have.where("length(text) > 600").orderBy("doc_id").limit(4).selectExpr("doc_id + 1000000 as doc_id", "text || ' one more' as text", "lang", "source", "n_chars")
            have = spark.createDataFrame(have.unionByName(copies).collect(), have.schema)
        before = [(r.doc_id, r.text) for r in have.collect()]
        have = stage(spark, have, SF)
        have = spark.createDataFrame(have.collect(), have.schema)
        if name == "packing":
            assert sum(r.length for r in have.collect()) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in before)
            continue
        assert have.columns == list(corpus_pipeline.COLUMNS)
        got = {r.doc_id: r.text for r in have.collect()}
        if name == "language_id":
            assert len(got) >= 0.97 * len(before)  # clean texts stay
        elif name == "line_dedup":
            assert got == without_repeats(before)
        elif name == "ngram_jaccard":
            assert set(got) == {i for i, (_, c) in classes(before, 5, 80).items() if i == c} and len(got) < len(before)
        elif name == "decontamination":
            bad = {d for d, _ in leaks(before, items)}
            assert set(got) == {i for i, _ in before} - bad and bad


def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 100
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
