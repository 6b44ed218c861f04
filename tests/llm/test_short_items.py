"""Benchmark items of any length against brute force on all diagonals, without seeds."""

import itertools
import random

import corpus_pipeline
from tests.llm.test_decontamination import words
from tidepool.llm.decontamination import benchmark_overlaps
from tidepool.llm.queries import op6_decontamination


def brute(docs, items):
    out = set()
    for (d, t), (i, u) in itertools.product(docs, items):
        a, b = words(t), words(u)
        for shift in range(1 - len(b), len(a)) if b else ():
            same = [a[k + shift] == b[k] for k in range(len(b)) if 0 <= k + shift < len(a)]
            width, need = min(16, len(same)), -(-min(16, len(b)) * 8 // 10)
            if any(sum(same[s : s + width]) >= need for s in range(len(same) - width + 1)):
                out.add((d, i))
    return out


def test_every_substitution_the_share_admits(spark, tmp_path):
    rng, docs, items = random.Random(5), [], []
    for n in range(1, 18):
        b = [f"q{n}x{k}" for k in range(n)]
        items.append((n, " ".join(b)))
        e = min(16, n) * 2 // 10
        for gone in itertools.islice(itertools.combinations(range(n), e), 0, None, 1 if e < 3 else 9):
            docs.append((len(docs), " ".join(["pad"] * rng.randrange(4) + ["zz" if k in gone else x for k, x in enumerate(b)] + ["end"] * rng.randrange(3))))
        docs.append((len(docs), " ".join(["zz" if k <= e else x for k, x in enumerate(b)])))  # one too many
        docs.append((len(docs), " ".join(b[e:])))  # cut off at the text's end
    items += [(50, None), (51, ""), (52, "日本語の質問")]
    docs += [(9000, None), (9001, ""), (9002, "x 日本語の質問 y")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute(docs, items) | {(9002, 52)}
    assert {(r.doc_id, r.item_id) for r in op6_decontamination(spark, str(tmp_path)).collect()} == want
    kept = {r.doc_id for r in corpus_pipeline.without_benchmark(spark, df, str(tmp_path)).collect()}
    assert kept == {i for i, _ in docs} - {d for d, _ in want}
    once = benchmark_overlaps(df.where("doc_id = 0").withColumn("text", df.text), spark.createDataFrame([(1, "q1x0")], "item_id long, text string"), any_length=True)
    assert [(r.n_matched, r.n_tokens) for r in once.collect()] == [(1, 1)]
