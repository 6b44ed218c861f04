import random
import re

import pytest
from pyspark.sql import functions as F

from tidepool.llm.license_scan import scan_licenses
from tidepool.llm.licenses import LICENSES

TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}


def plain(text):
    w = [re.sub(r"^[^0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff]+$", "", x) for x in re.split(r"[\x20\x09-\x0D]+", text)]
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w if x]


def holds(text, template, share):
    """Whether some run of words of the template's length holds enough of its shingles."""
    w, t = plain(text or ""), plain(template)
    want = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    return any(len(want.intersection(grams[i : i + len(want) + 5])) >= share * len(want) for i in range(len(grams)))


def test_finds_what_brute_force_finds(spark):
    rng = random.Random(3)
    long = " ".join(f"clause{rng.randrange(300)}" for _ in range(150))
    templates = {**TEMPLATES, "long": long, "other": " ".join(f"term{i}" for i in range(33))}
    rows = []
    for i in range(400):
        w = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 120))]
        for name in rng.sample(sorted(templates), rng.randrange(0, 3)):
            t = templates[name].split()
            if rng.random() < 0.4:
                for _ in range(rng.randrange(1, 4)):
                    t[rng.randrange(len(t))] = "changed"
            if rng.random() < 0.3:
                t = [x + rng.choice(["###", "!!"]) for x in t]
            p = rng.randrange(len(w) + 1)
            w[p:p] = t
        rows.append((i, rng.choice([" ", "\n"]).join(w)))
    rows += [(900, None), (901, ""), (902, TEMPLATES["MIT"]), (902, TEMPLATES["MIT"]), (None, TEMPLATES["GPL-3.0"].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(1)).repartition(3)
    got = {(r.doc_id, r.license) for r in scan_licenses(docs, templates).collect()}
    assert got == {(i, k) for i, text in rows for k, t in templates.items() if holds(text, t, 0.8)}
    assert scan_licenses(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        scan_licenses(docs, {"short": "two words"})


def test_places(spark):
    docs = spark.createDataFrame([(1, "One two. Released under the MIT License.\nand more")], "doc_id long, text string")
    assert [tuple(r) for r in scan_licenses(docs, TEMPLATES).collect()] == [(1, "MIT", 2, 6, 1.0)]


def test_full_texts_with_edits(spark):
    """Whole license texts, changed up to the limit of containment and a little beyond, among other words: as brute force finds
    them, all of them, each once."""
    rng = random.Random(11)
    whole, rows = {k: v[0] for k, v in LICENSES.items() if len(plain(v[0])) > 40}, []
    for name in sorted(whole):
        for n in (0, 1, 2, 4, 6, 9):
            w = whole[name].split()
            for p in rng.sample(range(len(w)), min(n, len(w) // 10 + 2)):
                w[p] = f"changed{p}"
            rows.append((len(rows), " ".join([*(f"a{rng.randrange(99)}" for _ in range(rng.randrange(80))), *w, *(f"b{rng.randrange(99)}" for _ in range(30))])))
    rows.append((len(rows), " ".join(f"w{i % 977}" for i in range(30_000)) + " " + whole["MIT"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.license) for r in scan_licenses(docs, whole).collect()]
    want = {(i, k) for i, text in rows for k, t in whole.items() if holds(text, t, 0.8)}
    assert set(got) == want and len(want) > 60
    assert len(got) == len(set(got))


def test_production_templates(spark):
    rows = [(1, "x " + LICENSES["BSD-3-Clause"][0]), (2, "Licensed under the MIT License."), (3, "Distributed under the Apache License, Version 2.0."), (4, "nothing of this kind at all, in five words"), (5, "Released under the MIT License.")]
    got = {(r.doc_id, r.license) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, "BSD-3-Clause"), (2, "MIT"), (3, "Apache-2.0"), (5, "MIT")} <= got and not any(i == 4 for i, _ in got)
