"""Operators of this library beyond what the queries with SQL compare: odd input, Han text, retries, long chains, streams of rejections."""

import pandas as pd
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators import chunks, facts, links, maintain, registry, retrieval, tables
from tidepool.streaming import ledger


def test_counted_numbers_structs_and_ties(spark):
    rows = spark.range(1000).select(F.struct((F.col("id") % 7).alias("a"), F.col("id").alias("b")).alias("ord"), F.col("id"))
    got = tables.counted(rows.repartition(5), "ord").collect()
    order = sorted(range(1000), key=lambda i: (i % 7, i))
    assert {r.id: r.nth for r in got} == {i: n + 1 for n, i in enumerate(order)}
    assert tables.counted(rows.limit(0), "ord").collect() == []
    assert sorted(r.nth for r in tables.counted(rows.select(F.lit(1).alias("one")), "one").collect()) == list(range(1, 1001))


def test_long_citation_chains(spark):
    n = 80  # beyond any fixed number of rounds that fits short chains
    nodes = spark.range(n).select("id", (F.col("id") == 0).alias("blocked")).unionByName(spark.createDataFrame([(500, False), (501, False)], "id long, blocked boolean"))
    edges = spark.range(1, n).select("id", (F.col("id") - 1).alias("source")).unionByName(spark.createDataFrame([(500, 501), (501, 500)], "id long, source long"))
    got = {r.id: r.allowed for r in maintain.external_allowed(nodes, edges).collect()}
    assert got == {**{i: False for i in range(n)}, 500: True, 501: True}


def test_local_marks(spark):
    rows = [("pages/a.md", "plain", None), ("Secret/x.md", "plain", None), ("b", "privacy: local-only\nx", None), ("c", "x", "local-only"), ("d", "x", "provider-allowed"), ("e", "password: hunter22", None), ("f/secret.md", "x", None)]
    df = spark.createDataFrame(rows, "path string, text string, label string")
    blocked = maintain.locally_blocked(F.col("path"), F.col("text"), F.col("label"), globs=("secret/*",))
    assert [r[0] for r in df.select(blocked).collect()] == [False, True, True, True, False, True, False]
    assert df.select(maintain.locally_blocked(F.col("path"), F.col("text"), F.col("label"), local_only=True)).distinct().collect()[0][0] is True


def test_provenance_layers(spark):
    deep = "body"
    for layer in range(40):
        deep = f"source_ref: r{layer}\n\n{deep}" if layer % 2 else f"---\nsource_ref: r{layer}\n---\n{deep}"
    six = "privacy: local-only\n\nbody"
    for layer in range(5):
        six = f"---\nprivacy: provider-allowed\n---\n{six}" if layer % 2 else f"source_agent: a\n\n{six}"
    plain = "a: b\n---\nno header"
    body, mark = registry.provenance(F.col("t"))
    too_deep = "\n".join("---\nsource_ref: r\n---\nsource_ref: r\n" for _ in range(40)) + "body"
    rows = spark.createDataFrame([(deep,), (six,), (plain,), ("",), (None,), (too_deep,)], "t string").select(body.alias("b"), mark.alias("m")).collect()
    assert [(r.b, r.m) for r in rows[:5]] == [("body", None), ("body", "local-only"), (plain, None), ("", None), (None, None)]
    assert rows[5].m == "too deep"


def test_contained_aliases_of_any_length(spark):
    pages = spark.createDataFrame([("p", "concept", "我在京\nat Port of Spain, x"), ("q", "concept", "[[京]] a@京.com"), ("r", "concept", None)], "page_slug string, page_type string, text string")
    aliases = spark.createDataFrame([("京", "kyo", "place"), ("Port of Spain", "pos", "place"), ("port of spain", "low", "place"), ("", "none", "place"), ("a@", "at", "place")], "alias string, entity_id string, entity_type string")
    got = {(r.from_page, r.to_entity, r.line_number) for r in links.alias_links(links.page_lines(pages), aliases).collect()}
    assert got == {("p", "kyo", 1), ("p", "pos", 2), ("q", "京", 1)}


def test_names_without_letters_and_long_words(spark):
    q = spark.createDataFrame([(1, "is !? a name"), (2, "x" * 20_000), (3, "在北京工作")], "query_id int, query string")
    names = spark.createDataFrame([("marks", "!?"), ("han", "北京"), ("no", "zz"), ("none", "")], "entity_id string, name string")
    assert {(r.query_id, r.entity_id) for r in retrieval.contained_names(q, names).collect()} == {(1, "marks"), (3, "han")}


def test_page_of_a_vector(spark):
    pages = spark.createDataFrame([("a", "concept", None, "x/a", "A", "one"), ("b", "concept", None, "x/b", "B", "two")], "page_slug string, page_type string, status string, relative_path string, title string, text string")
    v = spark.createDataFrame([(1, [0.0, 1.0], "b"), (2, [1.0, 0.0], "a")], "vec_id long, embedding array<double>, page_slug string")
    q = spark.createDataFrame([(7, "nothing")], "query_id long, query string")
    got = retrieval.ask(pages, q, "semantic", vectors=v, query_vectors=spark.createDataFrame([(7, [0.0, 1.0])], "query_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r.page_slug for r in got] == ["b", "a"]


def test_embedding_batches_fail_item_by_item(spark):
    def embed(texts: pd.Series) -> pd.Series:
        if (texts == "bad").any():
            raise ValueError("bad")
        return texts.map(lambda t: [0.0] * (2 if t == "short" else 3))

    rows = spark.createDataFrame([("a",), ("bad",), ("short",), ("b",)], "text string").coalesce(1)
    got = {r.text: r.v for r in rows.select("text", chunks.embedding(F.col("text"), embed, 3).alias("v")).collect()}
    assert got["a"] == got["b"] == [0.0, 0.0, 0.0] and got["bad"] is None and got["short"] is None


def test_han_summary_and_unsupported(spark):
    rows = [(1, "s", "uses", "Python", "2024"), (2, "s", "decided", "开始", "2025"), (3, "t", "odd thing", "x", "2024"), (4, "u", "status", "done.", "2024")]
    f = spark.createDataFrame([(*r, "literal", None, None) for r in rows], "id long, subject string, predicate string, object string, asserted_at string, object_type string, valid_to string, superseded_by long")
    titles = spark.createDataFrame([], "id string, title string")
    got = {r.subject: r.summary for r in facts.summary_paragraphs(f, titles).collect()}
    assert got["s"] == "方向与决策：已决定开始。\n\n实现与运行：使用 Python。"
    assert got["t"].startswith("Local summary placeholder: 1 accepted") and got["u"] == "Progress: done."
    assert facts.summary_paragraphs(f, titles, language="en").where("subject = 's'").first().summary == "Direction and decisions: decided: 开始.\n\nImplementation: uses: Python."


def test_names_are_folded(spark):
    got = [r[0] for r in spark.createDataFrame([("Stra\u00dfe",), ("\uff21\u3000b",), (" A\tb ",), (None,)], "n string").select(T.normalize_name(F.col("n"))).collect()]
    assert got == ["strasse", "a b", "a b", None]


def test_tier_alerts_wait_after_a_rejection(spark, tmp_path):
    folder = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    schema = "entity_id string, rejected int"
    stream = spark.readStream.schema(schema).json(folder)
    out = []
    for batch in ([("a", None)] * 3, [("a", 2)], [("a", None)] * 5, [("a", None)] * 9):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(folder)
        query = ledger.tier_alerts(stream, 3, 100).writeStream.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert out == [("a", 2, 3), ("a", 2, 13)]


def test_forced_pages_and_snapshot_come_first(spark):
    from tidepool.operators import assemble

    pages = spark.createDataFrame([("a", "A", "alpha"), ("b", "B", "beta"), ("c", "C", "gamma")], "page_slug string, title string, text string")
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id int, rank int, page_slug string")
    q = spark.createDataFrame([(1, "q")], "query_id int, query string")
    got = assemble.inject(found, pages, q, 500, include=("c", "b"), snapshot="now").first().context
    assert got == "## Snapshot\n\nnow\n\n## C\n\ngamma\n\n## B\n\nbeta\n\n## A\n\nalpha"
    assert assemble.inject(found, pages, q, 500).first().context == "## A\n\nalpha\n\n## B\n\nbeta"


def test_typed_tables(spark, tmp_path):
    row = spark.createDataFrame([("e", "person", "E", 2)], "id string, type string, title string, tier int")
    tables.write_table(row, str(tmp_path), "entities")
    back = tables.read_table(spark, str(tmp_path), "entities")
    assert back.schema == tables.schema("entities") and back.first().title == "E" and tables.broken_rows(back, "entities").collect() == []
    assert len(tables.TABLES) == 12
