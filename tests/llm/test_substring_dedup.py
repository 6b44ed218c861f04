import hashlib
import random

from tidepool.llm.substring_dedup import dedup_substrings


def brute(rows, window):
    """rows: (id, text) in order of id; windows by a dictionary of first places."""
    first, out = {}, {}
    split = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(split):
        w = split[i]
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (i, s))
    for i, w in split.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone.update(range(s, s + window))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def ran(df):
    return {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256((r.kept_text or "").encode()).hexdigest()) for r in df.collect()}


def test_matches_brute_force(spark):
    rng = random.Random(5)
    passages = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(15, 70))] for _ in range(6)]
    rows = []
    for i in range(400):
        text = []
        for _ in range(rng.randrange(0, 5)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randrange(len(p) // 2)
                text += p[a : a + rng.randrange(10, 60)]
            else:
                text += [f"w{rng.randrange(12)}" for _ in range(rng.randrange(30))]
        if rng.random() < 0.1:
            text = ["a"] * rng.randrange(60)
        rows.append((i, " \t\n"[rng.randrange(3)].join(text) + rng.choice(["", " ", "\x0b"])))
    rows += [(400, None), (401, ""), (402, "é " * 50), (403, rows[7][1]), (404, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 7):
        assert ran(dedup_substrings(docs.repartition(parts))) == brute(rows, 20)


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ran(dedup_substrings(docs.repartition(5))) == brute(rows, 20)


def test_odd_tables(spark):
    text = " ".join(str(i) for i in range(30))
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.n_removed) for r in dedup_substrings(docs.withColumn("n_words", docs.doc_id)).collect())
    assert got == [(1, 0), (1, 0), (2, 30), (99, 30)]
    assert dedup_substrings(docs.limit(0)).collect() == []


def test_factors_are_copies_that_reach_farthest(spark):
    rng = random.Random(6)
    source = [[f"s{d}w{rng.randrange(60)}" for _ in range(120)] for d in range(4)]
    rows = [(d, " ".join(w)) for d, w in enumerate(source)]
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 4)):
            w, a = rng.choice(source), rng.randrange(60)
            text += w[a : a + rng.randrange(15, 60)] + [f"own{i}x{rng.randrange(9)}" for _ in range(rng.randrange(3))]
        rows.append((10 + i, " ".join(text)))
    rows += [(100, None), (101, ""), (None, rows[12][1])]
    words = {i: (t or "").split() for i, t in rows}
    for parts in (1, 5):
        got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), factors=True).collect()
        assert len(got) == len(rows) and sum(len(r.factors) for r in got) > 60
        for r in got:
            own, covered, at = words[r.doc_id], set(), 0
            for f in r.factors:
                assert f.start >= at and words[f.ref_id][f.ref_start : f.ref_start + f.length] == own[f.start : f.start + f.length]
                assert (f.ref_id if f.ref_id is not None else 999, f.ref_start) < (r.doc_id if r.doc_id is not None else 999, f.start)
                at = f.start + f.length
                covered.update(range(f.start, at))
            assert len(covered) == r.n_removed == sum(f.length for f in r.factors)
