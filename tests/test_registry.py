import pytest
from pyspark.sql import functions as F

from tidepool.operators import registry


def test_corpus_inbox_and_headers(spark):
    pages = spark.createDataFrame([("a", "entity", "x", []), ("b", "project", "y", []), ("c", "entity", "z", ["slug"])], "page_slug string, page_type string, text string, errors array<string>")
    scratch = spark.createDataFrame([("scratch/working", "w")], "marker string, text string")
    assert {r.page_slug for r in registry.corpus(pages, scratch).collect()} == {"a", "b", "scratch/working"}
    assert {r.page_slug for r in registry.corpus(pages, scratch, "entity").collect()} == {"a"}
    files = spark.createDataFrame([("n.md", bytearray(b"\xef\xbb\xbfhi")), ("bad.md", bytearray(b"\xff\xfe")), ("processed/x.md", bytearray(b"x")), ("failed/y.md", bytearray(b"y")), ("done.md", bytearray(b"d"))], "path string, content binary")
    got = {r.path: (r.text, r.read_error) for r in registry.inbox(files, spark.createDataFrame([("done.md",)], "path string")).collect()}
    assert got == {"n.md": ("hi", None), "bad.md": (None, "not UTF-8")}
    assert tuple(registry.inbox_counts(files).first()) == (3, 1) and registry.failed_inbox(files, 5).count() == 1
    body, privacy = registry.provenance(F.col("t"))
    rows = spark.createDataFrame([("source_ref: a\nprivacy: provider-allowed\n\nprivacy: local-only\n\nbody",), ("body",)], "t string").select(body.alias("b"), privacy.alias("p")).collect()
    assert [(r.b, r.p) for r in rows] == [("body", "local-only"), ("body", None)]
    kinds = spark.createDataFrame([(None, "project", [], None), (None, "entity", ["x", "person"], "org"), ("place", "entity", [], None), (None, "entity", [], "org")], "e string, p string, t array<string>, o string")
    assert [r[0] for r in kinds.select(registry.entity_type(F.col("e"), F.col("p"), F.col("t"), F.col("o"))).collect()] == ["project", "person", "place", "org"]


def test_events_and_reviews(spark):
    ledger = spark.createDataFrame([("1", "k", ["p"], {}), ("2", "k", [], {"entity_id": "p"}), ("3", "z", ["p"], {}), ("4", "k", None, None)], "id string, kind string, affected_pages array<string>, metadata map<string,string>")
    assert [r.id for r in registry.recent_events(ledger, 5, "k", "p").collect()] == ["2", "1"]
    assert [r.id for r in registry.recent_events(ledger, 2).collect()] == ["4", "3"]
    reviews = spark.createDataFrame([("a", "x", "pending", "none", ["payload"]), ("b", "x", "pending", "approve", []), ("c", "y", "done", "none", [])], "review_id string, kind string, status string, action string, errors array<string>")
    assert [r.review_id for r in registry.invalid_reviews(reviews).collect()] == ["a"]
    assert registry.pending_reviews(reviews, "x").count() == 2 and registry.review_headers(reviews).columns == ["review_id", "kind", "status"]


def test_lookups(spark):
    pages = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", "B2")], "page_slug string, text string")
    assert [r.text for r in registry.included_pages(["a"], pages).collect()] == ["A"]
    with pytest.raises(ValueError, match="no page: q"):
        registry.included_pages(["a", "q"], pages)
    own, many = registry.unique_slugs(pages)
    assert own.count() == 1 and many.first().pages == 2
    log = spark.createDataFrame([("t", 1, "add", 5.0), ("t", 2, "set", 10.0), ("t", 3, "add", 2.0), ("u", 1, "add", 1.0)], "key string, seq int, op string, value double")
    assert {r.key: r.value for r in registry.stats(log).collect()} == {"t": 12.0, "u": 1.0}
    props = spark.createDataFrame([(1, "e", 2, "r1", None, None), (2, "e", 2, "r2", None, None)], "id int, entity_id string, proposed_tier int, review_file string, decision string, decided_at string")
    dec = spark.createDataFrame([("r1", "e", 2), ("zz", "e", 2)], "review_id string, entity_id string, proposed_tier int")
    assert {r.review_id: r.proposal_id for r in registry.proposal_of(dec, props).collect()} == {"r1": 1, "zz": 2}
    done = registry.decided_proposals(props, spark.createDataFrame([(1, "approved", "2026")], "proposal_id int, decision string, decided_at string"))
    assert {r.id: r.decision for r in done.collect()} == {1: "approved", 2: None}
    e = spark.createDataFrame([("x", "X")], "id string, title string")
    pend = spark.createDataFrame([("X", "r", "al", "entity"), ("X", "r", "no", "entity"), ("X", "r", "lit", "literal")], "subject string, predicate string, object string, object_type string")
    al = spark.createDataFrame([("al", "x")], "alias string, entity_id string")
    assert {tuple(r) for r in registry.resolved_pending(pend, e, al).collect()} == {("x", "r", "x", "entity"), ("x", "r", "lit", "literal")}
