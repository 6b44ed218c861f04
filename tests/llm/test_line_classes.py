"""Lines meet by segments of length classes; only lines that share one are read again."""

import random

from pyspark.sql import functions as F
from tests.llm.test_line_dedup import brute
from tidepool.llm import line_dedup
from tidepool.llm.line_dedup import dedup_lines


def tables(spark, monkeypatch, rows):
    """Result of dedup_lines, and rows of each table on the way that holds text."""
    made, plain = {}, line_dedup.written

    def written(df, name):
        out = plain(df, name)
        if {"line", "lines", "text"} & set(out.columns):
            made[name] = out.count()
        return out

    with monkeypatch.context() as m:
        m.setattr(line_dedup, "written", written)
        got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return got, made


def test_only_lines_with_shared_segments_are_read_again(spark, monkeypatch):
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    rows = [(k, draw(60)) for k in range(300)]
    rows += [(300, rows[7][1][:-1]), (301, rows[8][1]), (302, "short\nshort")]
    got, made = tables(spark, monkeypatch, rows)
    assert got == brute(rows, 2, 40)
    assert sum(made.values()) == 2  # the two near each other


def test_two_edits_at_any_length(spark):
    """Any two of an insertion, a deletion and a replacement at any two places, at lengths on both sides of the bounds of classes."""
    rng, rows = random.Random(6), []
    draw = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(n))
    for n in range(42, 62):
        for kinds in ("id", "di", "ii", "dd", "rr", "ir", "rd"):
            x = draw(n)
            y, at = list(x), sorted((rng.choice([0, 1, n // 3 - 1, n // 3, n // 3 + 1, rng.randrange(n)]), rng.choice([n - 1, n - 2, 2 * n // 3, 2 * n // 3 + 1, rng.randrange(n)])))
            for kind, p in zip(reversed(kinds), reversed(at), strict=True):
                y[p : p + (kind != "i")] = [] if kind == "d" else ["#"]
            rows += [(len(rows), x), (len(rows) + 1, "".join(y))]
    order = rows[:]
    rng.shuffle(order)
    rows = [(k, x) for k, (_, x) in enumerate(order)]
    want = {i: v for i, v in brute(rows, 2, 40).items()}
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(v[1] for v in want.values()) == len(rows) // 2


def test_join_keys(spark):
    """Four keys of most lines and twice as many near the end of a class; lines within more than two edits share one too."""
    rng = random.Random(7)
    rows = [("x" * n, n) for n in range(40, 80)]
    got = spark.createDataFrame(rows, "a string, n int").select("n", F.size(line_dedup.join_keys(F.col("a"), F.col("n"), 2)).alias("k"))
    assert {r.k for r in got.collect() if r.n % 8 < 6} == {4} and {r.k for r in got.collect() if r.n % 8 >= 6} == {8}
    for edits in (1, 2, 3, 4):
        pairs = []
        for _ in range(500):
            x = "".join(rng.choice("abcdé") for _ in range(rng.randrange(8 * (edits + 1), 70)))
            y = list(x)
            for _ in range(edits):
                p, kind = rng.randrange(len(y)), rng.randrange(3)
                y[p : p + (kind > 0)] = ["#"] if kind < 2 else []
            pairs.append((x, "".join(y)))
        side = lambda c: line_dedup.join_keys(F.col(c), F.length(c), edits)  # noqa: B023, E731
        assert spark.createDataFrame(pairs, "a string, b string").where(~F.arrays_overlap(side("a"), side("b"))).collect() == []
