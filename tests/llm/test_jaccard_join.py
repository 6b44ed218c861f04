import random
import re

import numpy as np
import pytest

from tidepool.llm import jaccard_join
from tidepool.llm.jaccard_join import histogram, jaccard_components, least_difference


def sets_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = {i: sets_of(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((top(i), top(j)))
                up[q] = p
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_copies(rng, n):
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.6:
            w = list(rng.choice(base))
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                p = rng.randrange(len(w) + 1)
                w[p : p + rng.randrange(2)] = [f"X{rng.randrange(99)}"] * rng.randrange(2)
        else:
            w = [f"w{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 2, 3, 5, 12, 40, 150, 400]))]
        if w:
            base.append(w)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_matches_brute_force(spark, k, percent):
    rows = near_copies(random.Random(k), 500) + [(500, None), (501, ""), (502, " \n"), (503, "A b"), (504, "a B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, shingle=k, percent=percent).collect()}
    assert got == brute(rows, k, percent)


def test_blocks_and_shuffles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "LEAF", 3)  # several rounds of pivots, then blocks
    monkeypatch.setattr(jaccard_join, "BROADCAST_MEMBERS", 0)
    rows = near_copies(random.Random(9), 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == brute(rows, 3, 90)


@pytest.mark.parametrize("leaf", [2000, 10])
def test_families_around_the_limit(spark, monkeypatch, leaf):
    """Families whose members are partly linked to a pivot, partly in its window and partly beyond, so that regions join again."""
    rounds = []
    links = jaccard_join._links
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "_links", lambda *a: rounds.append(links(*a)) or rounds[-1])
    rng, rows = random.Random(3), []
    for f in range(6):
        base = [f"f{f}w{i}" for i in range(80)]
        other = [f"f{f}o{i}" if i in (10, 11, 12, 40) else w for i, w in enumerate(base)]  # a second middle, beyond the first one's links
        for k in range(60):
            w = list((base, other)[k % 3 == 2])
            for p in rng.sample(range(80), rng.randrange(0, 5)):
                w[p] = f"v{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, shingle=5, percent=80).collect()}
    assert got == brute(rows, 5, 80)
    # windows beyond the links were met and went on to another round
    assert len(rounds[0][1]) > 1 and rounds[0][1][0]["within"] > rounds[0][1][0]["linked"] > 0


def test_pivots_decide_the_links_of_the_documents(spark, monkeypatch):
    rounds = []
    links = jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda *a: rounds.append(links(*a)) or rounds[-1])
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    classes = jaccard_components(docs).groupBy("component_id").count().where("count > 1").count()
    done = rounds[0][1]
    assert classes > 100 and done[0]["pivots"] > 100 and done[0]["linked"] > 10


def test_bounds_of_histograms():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900)).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.append(x[rng.random(len(x)) < rng.random()], rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64) * np.uint64(2)))
        assert least_difference(histogram(x), histogram(y)) <= len(np.setxor1d(x, y))
    assert least_difference(histogram(x), histogram(x)) == 0


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "A b c d"), (5, "A b c d"), (6, "q")], "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.n_shingles, r.component_id) for r in jaccard_components(docs.withColumn("n", docs.doc_id).withColumn("rid", docs.doc_id)).collect())
    assert got == [(5, 2, 5), (5, 2, 5), (6, 1, 6), (99, 2, 5), (99, 2, 5)]
    assert jaccard_components(docs.limit(0)).collect() == []
    lone = jaccard_components(docs.where("doc_id is null")).collect()
    assert [r.component_id for r in lone] == [None, None]
