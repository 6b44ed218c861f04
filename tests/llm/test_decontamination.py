import itertools
import random
import re

from pyspark.sql import functions as F
from tidepool.llm import decontamination
from tidepool.llm.decontamination import MASKS, benchmark_overlaps, decontaminate


def words(t):
    return [x for x in re.split(r"[^0-9a-zà-ÿ]+", (t or "").lower()) if x]


def masked(w):
    """Seed tokens of every mask -> places."""
    out = {}
    for m in MASKS:
        for p in range(len(w) - max(m)):
            out.setdefault((m, *(w[p + k] for k in m)), []).append(p)
    return out


def brute(docs, items):
    """Every diagonal of every pair that has a seed in common."""
    out, known = set(), [(i, words(u), masked(words(u))) for i, u in items]
    for d, t in docs:
        a = words(t)
        own = masked(a)
        for i, b, seeds in known:
            for shift in {p - q for s in own.keys() & seeds.keys() for p in own[s] for q in seeds[s]}:
                same = [a[k + shift] == b[k] for k in range(len(b)) if 0 <= k + shift < len(a)]
                width, need = min(16, len(same)), -(-min(16, len(b)) * 8 // 10)
                if any(sum(same[s : s + width]) >= need for s in range(len(same) - width + 1)):
                    out.add((d, i))
    return out


def test_masks_survive_three_substitutions_in_sixteen():
    runs = [{s + k for k in m} for m in MASKS for s in range(16 - max(m))]
    assert all(any(r.isdisjoint(gone) for r in runs) for gone in itertools.combinations(range(16), 3))


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(f"q{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 12, 30, 60])))) for i in range(12)] + [(50, None), (51, "")]
    docs = []
    for d in range(120):
        w = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            b = (rng.choice(items)[1] or "").split()
            b = b[rng.randrange(len(b) // 2 + 1) :]
            for _ in range(rng.randrange(0, len(b) // 4 + 1)):
                b[rng.randrange(len(b))] = "zz"
            p = rng.randrange(len(w) + 1)
            w[p:p] = b
        docs.append((d, ", ".join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    docs += [(300, None), (301, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(3)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(3))
    want = brute(docs, items)
    assert len(want) > 20
    for limit in (2_000_000, 0):  # sent to the executors, and by a shuffle
        monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", limit)
        got = benchmark_overlaps(df, bench, any_length=False)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    kept = {r.doc_id for r in decontaminate(df, bench, any_length=False).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    odd = df.where("doc_id = 5").unionByName(df.where("doc_id = 5")).unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert decontaminate(odd, bench.limit(0)).count() == 3 and benchmark_overlaps(df.limit(0), bench).collect() == []


def test_no_python(spark):
    sf = "/root/testdata/sf0.001"
    plan = benchmark_overlaps(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_start_is_that_of_the_best_diagonal(spark):
    item = [f"q{i}" for i in range(40)]
    docs = [(1, " ".join(item[:16] + ["w"] * 30 + item)), (2, " ".join(["w"] * 3 + item + ["v"] * 5 + item)), (3, " ".join(item[20:]))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "v")], "item_id long, text string")
    got = benchmark_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.n_matched, r.n_tokens, r.start) for r in got) == [(1, 7, 40, 40, 46), (2, 7, 40, 40, 3), (2, 8, 1, 1, 43), (3, 7, 20, 40, 0)]
