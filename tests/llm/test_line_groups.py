"""Large groups of lines that share most of their text: few pairs become rows, and the result is that of all pairs."""

import random

from tests.llm.test_line_dedup import brute
from tidepool.llm import line_dedup
from tidepool.llm.line_dedup import dedup_lines


def met(spark, monkeypatch, lines):
    """The most pairs of lines that were rows at once; the result is compared."""
    rows, made, plain = list(enumerate(lines)), {}, line_dedup.written

    def written(df, name):
        out = plain(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    with monkeypatch.context() as m:
        m.setattr(line_dedup, "written", written)
        got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 2, 40)
    return max(v for k, v in made.items() if k.startswith("pairs"))


def test_lines_near_each_other(spark, monkeypatch):
    lines = [f"the running title of a long report, page {k} of it, and its date" for k in range(100, 400)]
    random.Random(3).shuffle(lines)
    assert met(spark, monkeypatch, lines) < 44_850 / 4  # of 44,850


def test_lines_near_one_text(spark, monkeypatch):
    rng = random.Random(4)
    text = "of a text that was copied often, each copy got a word of its own, which is in no other one of all these copies"
    draw = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    at = [rng.randrange(len(text)) for _ in range(200)]
    lines = [text[:k] + draw(6) + text[k:] for k in at]
    assert met(spark, monkeypatch, lines) < 2_000  # of 19,900
