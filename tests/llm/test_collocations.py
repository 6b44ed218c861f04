"""Collocations against counts of all phrases, and the bounds by which they grow."""

import random
import re
from collections import Counter

import numpy as np

import tidepool.llm.collocations as c

SF = "/root/testdata/sf0.001"


def brute(docs, top=2000, least=30):
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", "".join(x.lower() if x.isascii() else x for x in text or "")):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for m in range(1, 5):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in candidates.items():
        gone |= {(lang, p[i : i + j]) for j in range(2, len(p)) for i in range(len(p) - j + 1) if 100 * a >= 80 * f[lang, p[i : i + j]]}
    out = {}
    for (lang, p), a in candidates.items():
        if (lang, p) not in gone:
            low = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-low[0], -a, " ".join(p).encode(), f[lang, p[: low[1]]], f[lang, p[low[1] :]]))
    return sorted((lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for lang, rows in out.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def made(n=1500, seed=3):
    """Texts with frequent words between which phrases of different strength stand, in three languages."""
    rnd = random.Random(seed)
    phrases = ["new york", "in new york city", "king of spain", "the king of spain", "aa aa", "aa aa aa", "x y z", "été à", "a b c d e f", "Zz\tzz"]
    for _ in range(n):
        words = [rnd.choice(phrases) if rnd.random() < 0.4 else rnd.choice("the of in a b c d x y king new aa".split()) for _ in range(rnd.randint(0, 30))]
        yield rnd.choice(["en", "en", "en", "de", None]), "".join(w + rnd.choice([" ", " ", "  ", " ", ", ", ".\n", "\t"]) for w in words)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_made_texts(spark):
    docs = [*made(), (None, None), ("en", ""), ("en", " ,;.\n"), ("fr", "nothing twice")]
    df = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 as h1", "2 as a", "'x' as word", "3 as n").repartition(5)
    want = brute(docs)
    assert rows(c.collocations(df)) == want and len(want) > 100


def test_growth_stops_at_the_places_asked_for(spark, monkeypatch):
    """Few places: later rounds and parts that are never grown give the same as all counts."""
    docs = list(made(2500, 5))
    df = spark.createDataFrame(docs, "lang string, text string")
    for top, first in ((1, 1), (7, 1), (20, 2)):
        monkeypatch.setattr(c, "FIRST", first)
        monkeypatch.setattr(c, "FURTHER", 2)
        limits, seen = c._limits, []
        monkeypatch.setattr(c, "_limits", lambda *a: seen.append(limits(*a)) or seen[-1])
        assert rows(c.collocations(df, top=top)) == brute(docs, top)
        monkeypatch.setattr(c, "_limits", limits)
        assert any(x for s in seen for x in s.values())


def test_full_bit_sets_only_cost_time(spark, monkeypatch):
    monkeypatch.setattr(c.BitSet, "has", lambda self, *words: np.ones(len(words[0]), bool))
    docs = list(made(600))
    assert rows(c.collocations(spark.createDataFrame(docs, "lang string, text string"))) == brute(docs)


def test_words_that_share_a_hash_take_another_seed(spark, monkeypatch):
    real = c.mix
    monkeypatch.setattr(c, "GATHERED", 100)
    docs = list(made(300))
    df = spark.createDataFrame(docs, "lang string, text string")
    first = df.mapInArrow(c._word_counts(0), "lang string, word string, h long, n long").groupBy("lang", "word", "h").sum("n").collect()
    assert len({r.h for r in first}) == len(first) and real is c.mix
    calls = []
    plain = c._word_counts

    def clash(seed):
        calls.append(seed)
        own = plain(seed)
        if seed:
            return own
        import pyarrow as pa

        def run(batches):
            for b in own(batches):
                yield b.set_column(2, "h", pa.array([7] * b.num_rows, pa.int64()))

        return run

    monkeypatch.setattr(c, "_word_counts", clash)
    assert rows(c.collocations(df)) == brute(docs) and calls == [0, 1]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    got = spark.createDataFrame([(big, big, big - 1), (big // 3, big, big)], "a long, l long, r long").select(c._score("a", "l", "r").alias("s"), c._nearly("l", "a").alias("x")).collect()
    assert [r.s for r in got] == [2_000_000 * big // (2 * big - 1), 2_000_000 * (big // 3) // (2 * big)] and all(r.x for r in got)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows(c.collocations(docs)) == brute([(r.lang, r.text) for r in docs.collect()])
