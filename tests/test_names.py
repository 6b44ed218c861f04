"""Names in texts, against looking for each name in each text."""

import random

import pytest

from tidepool.operators import names, registry, retrieval


@pytest.mark.parametrize("shard", [100_000, 40])
def test_contained_equals_a_loop(spark, monkeypatch, shard):
    monkeypatch.setattr(names, "SHARD_NAMES", shard)
    rnd = random.Random(4)
    make = lambda n: "".join(rnd.choice("abABß éÉİ北京") for _ in range(n))
    known = {make(rnd.randint(1, 4)) for _ in range(150)} | {"anna", "Annapolis", "", "ANNA"}
    texts = [(i, make(rnd.randint(0, 30))) for i in range(80)] + [(90, None), (91, ""), (92, "in ANNAPOLIS")]
    df = spark.createDataFrame(texts, "name_id long, text string").repartition(3)
    table = spark.createDataFrame([(n,) for n in known] * 2 + [(None,)], "name string")
    for fold in (str.casefold, None):
        f = fold or str
        got = sorted((r.name_id, r.name) for r in names.contained(df, table, fold=fold).collect())
        assert got == sorted((i, n) for i, t in texts if t for n in known if n and f(n) in f(t))
    assert names.contained(df, table.limit(0)).collect() == [] and names.contained(df.limit(0), table).collect() == []


def test_hints_in_any_case_and_in_order(spark):
    texts = spark.createDataFrame([("p", "From ANNAPOLIS to big corp"), ("q", "x y"), ("r", "al and X, STRASSE")], "page_slug string, text string")
    entities = spark.createDataFrame([("e1", "Big Corp"), ("e2", "Annapolis"), ("x", "X"), ("str", "straße")], "id string, title string")
    aliases = spark.createDataFrame([("anna", "e3"), ("al", "x"), ("ANNAPOLIS", "e2")], "alias string, entity_id string")
    every = spark.createDataFrame([(i,) for i in ("e1", "e2", "e3", "x", "str")], "id string")
    got = {r.page_slug: r.hints for r in registry.entity_hints(texts, entities, aliases, every).collect()}
    assert got == {"p": ["e2", "e3", "e1"], "r": ["x", "str"]}  # aliases first; one character is no name
    got = {r.page_slug: r.hints for r in registry.entity_hints(texts, entities, aliases, every.where("id <> 'e3'"), 1).collect()}
    assert got == {"p": ["e2"], "r": ["x"]}


def test_names_in_questions_that_hold_each_other(spark):
    asked = spark.createDataFrame([(1, "Who saw NEW YORK city"), (2, "york"), (3, None)], "query_id long, query string")
    known = spark.createDataFrame([("a", "New York"), ("b", "york"), ("c", "new york City"), ("d", "")], "entity_id string, name string")
    assert sorted(tuple(r) for r in retrieval.contained_names(asked, known).collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "b")]
