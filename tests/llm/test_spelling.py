"""Spelling variants against all pairs of words."""

import zlib
from collections import Counter
import re

import pytest

from tidepool.llm.spelling import spelling_variants

SF = "/root/testdata/sf0.001"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, noise, min_count=5, min_length=6, ratio=5):
    counts = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if n >= min_count and len(w) >= min_length}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    all_near = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if near(w, v)] for w in words}
    form = {}
    for w, vs in all_near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(all_near[w]), words.get(form[w])))
    return out


@pytest.mark.parametrize("noise", [None, 7])
def test_planted_words(spark, noise):
    base = ["bookkeeper", "ÉCOLEÉCOLE", "aaaaaaa", "kitten", "sitten", "zzzzzzzz×zz", "x" * 300, "mississippi"]
    rows, i = [], 0
    for w in base:
        variants = {w[:k] + w[k + 1 :] for k in range(min(len(w), 12))} | {w[:k] + "qé"[k % 2] + w[k + 1 :] for k in range(0, min(len(w), 12), 2)} | {w[:3] + "yy" + w[3:], w + w[-1]}
        for n, v in [(900, w), *((5 + 13 * k % 240, v) for k, v in enumerate(sorted(variants)))]:
            for _ in range(0, n, 10):
                rows.append((i % 40 if i % 41 else None, " ".join([v] * min(10, n)) + ("." if i % 3 else "-" + v)))
                i += 1
    # a chain of forms: a variant of a variant
    rows += [(50 + k, " ".join([w] * 5)) for w, n in (("wordchains", 130), ("wordchainy", 25), ("wordchaxny", 5)) for k in range(n // 5)]
    rows += [(3, None), (4, ""), (5, " \n\t12 $$"), (6, "kitten$kitten kitten²kitten")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as rank", "'b' as word", "2 as n")
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(docs, noise=noise).collect()}
    want = brute(rows, noise)
    assert got == want and any(w != root and form != root for w, form, root, *_ in want)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(docs, noise=199).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 199)
    assert got == want and len(want) > 100


def test_long_texts_are_searched_whole(spark, monkeypatch):
    import tidepool.llm.spelling as s

    monkeypatch.setattr(s, "SLICE", 50)
    assert [b"".join(s._slices(x)) for x in (b"", b"a" * 200, b"ab cd " * 60)] == [b"", b"a" * 200, b"ab cd " * 60]
    monkeypatch.undo()
    text = "letters " * 700_000
    got = spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.word, r.n) for r in got] == [("letters", 700_000)]
