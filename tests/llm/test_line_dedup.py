import random

from pyspark.sql import functions as F
from tidepool.llm import line_dedup
from tidepool.llm.line_dedup import dedup_lines, index_keys, probe_keys, removed_lines, within_edits


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def close(a, b, edits):
    """distance(a, b) <= edits, on the diagonals that can matter."""
    row = {j: j for j in range(min(len(b), edits) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - edits), min(len(b), i + edits) + 1):
            new[j] = i if j == 0 else min(row.get(j, 99) + 1, new.get(j - 1, 99) + 1, row.get(j - 1, 99) + (x != b[j - 1]))
        row = new
    return row.get(len(b), 99) <= edits


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k, p = rng.randrange(3), rng.randrange(len(s) + 1)
        s[p : p + (k > 0)] = ["é", "q", "the"[rng.randrange(3)]][rng.randrange(3) : rng.randrange(3) + 1][:1] if k < 2 else []
    return "".join(s)


def test_edit_distance_and_segments(spark):
    rng = random.Random(1)
    for edits in (1, 2, 4):
        rows = []
        for _ in range(600):
            a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 60)))
            b = edited(rng, a, rng.randrange(0, edits + 3)) if rng.random() < 0.9 else a[::-1]
            rows.append((a, b, distance(a, b) <= edits))
        got = spark.createDataFrame(rows, "a string, b string, want boolean").select("a", "b", "want", within_edits(F.col("a"), F.col("b"), edits).alias("got"), F.arrays_overlap(index_keys(F.col("a"), F.length("a"), edits), probe_keys(F.col("b"), F.length("b"), edits)).alias("met"))
        for r in got.collect():
            assert abs(len(r.a) - len(r.b)) > edits or close(r.a, r.b, edits) == r.want
            assert r.got == r.want, (edits, r)
            assert r.met or not r.want or len(r.a) > len(r.b) or len(r.a) <= edits, (edits, r)


def brute(rows, edits, least):
    first, lines = {}, {}
    for i, t in sorted(rows):
        lines[i] = [] if t is None else t.split("\n")
        for p, x in enumerate(lines[i]):
            if len(x) >= least:
                first.setdefault(x, (i, p))
    order, gone = sorted(first, key=first.get), set()
    for k, x in enumerate(order):
        if any(abs(len(x) - len(y)) <= edits and close(x, y, edits) for y in order[:k]):
            gone.add(x)
    out = {}
    for i, t in rows:
        kept = [x for p, x in enumerate(lines[i]) if len(x) < least or (first[x] == (i, p) and x not in gone)]
        out[i] = (len(lines[i]), len(lines[i]) - len(kept), None if t is None else "\n".join(kept))
    return out


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    pool = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(20, 50))) for _ in range(40)]
    rows = []
    for i in range(150):
        rows.append((i, "\n".join(edited(rng, rng.choice(pool), rng.choice([0, 0, 1, 2, 3])) if rng.random() < 0.9 else "" for _ in range(rng.randrange(0, 6)))))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lines", F.lit(1)).repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in dedup_lines(docs, min_chars=24).collect()}
    assert got == brute(rows, 2, 24)
    monkeypatch.setattr(line_dedup, "BROADCAST_NUMBERS", 0)  # by a shuffle
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text, r.lines) for r in dedup_lines(docs, min_chars=24, carry=("lines",)).collect()}
    assert got == {k: (*v, 1) for k, v in brute(rows, 2, 24).items()}
    line = "a line that is long enough to be judged, it is"
    odd = spark.createDataFrame([(None, line), (1, line), (1, line)], "doc_id long, text string")
    assert sorted((r.doc_id or 9, r.n_removed) for r in dedup_lines(odd).collect()) == [(1, 0), (1, 0), (9, 1)]
    assert dedup_lines(odd.limit(0)).collect() == []


def test_no_python_and_one_shuffle_of_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = removed_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_lines_of_every_script(spark):
    """Unlike lines that share a segment are told apart by their letters, in any script; near ones are found."""
    rng = random.Random(11)
    scripts = {"latin": range(0x61, 0x7B), "cyrillic": range(0x430, 0x450), "greek": range(0x3B1, 0x3CA), "han": range(0x4E00, 0x5200), "emoji": range(0x1F600, 0x1F640)}
    for codes in scripts.values():
        draw = lambda n: "".join(chr(rng.choice(codes)) for _ in range(n))
        head = draw(24)
        lines = [head + draw(36) for _ in range(300)]
        sig = [r.s for r in spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, x string").orderBy("k").select(line_dedup.letter_parity(F.col("x")).alias("s")).collect()]
        assert sum(bin(a ^ b).count("1") <= 4 for k, a in enumerate(sig) for b in sig[:k]) < 2200  # of 44,850 pairs
        rows = [(k, x) for k, x in enumerate(lines[:40])] + [(100 + k, edited(rng, x, k % 4)) for k, x in enumerate(lines[:40])]
        got = {r.doc_id: r.kept_text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=40).collect()}
        assert got == {i: x[2] for i, x in brute(rows, 2, 40).items()}
