"""Ingest of small batches with a fixed extraction."""

import json

from tidepool.operators import ingest

ITEMS = "item_id long, text string, event_id string, entry_date string, source_ref string"
SAID = {
    "one": {"entities": [{"name": "Alice", "type": "person", "confidence": 0.95}, {"name": "Acme", "type": "org", "confidence": 0.9}], "facts": [{"subject": "Alice", "predicate": "works at", "object": "Acme", "object_type": "Org", "confidence": 0.9}, {"subject": "Alice", "predicate": "has role", "object": "lead", "object_type": "text", "confidence": 0.9}, {"subject": "Bob", "predicate": "uses", "object": "C:\\x", "object_type": "entity", "confidence": 0.9}], "timeline_summary": "met Alice"},
    "two": {"entities": [{"name": "alice", "type": "person"}], "facts": [{"subject": "alice", "predicate": "role", "object": "chief", "object_type": "text", "confidence": 0.95}, {"subject": "alice", "predicate": "role", "object": "lead", "object_type": "text", "confidence": 0.3}], "timeline_summary": "again"},
}


def fixed(text):
    return json.dumps(SAID.get(text.strip(), {}))


def test_batch(spark):
    items = spark.createDataFrame([(1, "one", "E1", "2026-01-01", "r"), (2, "two", "E2", "2026-01-02", "r")], ITEMS)
    signals = ingest.extract(ingest.parts(items), fixed)
    entities = spark.createDataFrame([("zed", "Zed"), ("alice", "Alice")], "id string, title string")
    facts = spark.createDataFrame([], "id long, subject string, predicate string, object string, valid_to string, superseded_by long")
    out = ingest.ingest(signals, items, entities, spark.createDataFrame([], "alias string, entity_id string"), facts)
    assert {(r.entity_id, r.title) for r in out["entities"].collect()} == {("acme", "Acme")}
    assert {(r.subject, r.predicate, r.object, r.outcome) for r in out["decided"].collect()} == {("alice", "works_at", "acme", "added"), ("alice", "role", "lead", "added"), ("alice", "role", "chief", "conflict review")}
    assert [(r.subject, r.object, r.object_type) for r in out["pending"].collect()] == [("Bob", "C:\\x", "literal")]
    assert {(r.page_slug, r.event_id, r.description) for r in out["timeline"].collect()} == {("alice", "E1", "met Alice")}
    assert {r.entity_id: r.mentions for r in out["mentions"].collect()} == {"alice": 2, "acme": 1}
    pages = spark.createDataFrame([("zed",)], "page_slug string")
    counted = spark.createDataFrame([("alice", "Alice", 1)], "id string, title string, mention_count int")
    assert [r.page_slug for r in ingest.stub_pages(out["timeline"], counted, pages).collect()] == ["alice"]
    assert ingest.stub_pages(out["timeline"], counted.withColumn("title", counted.title).replace("Alice", "v1.2", "title"), pages).count() == 0


def test_parts_and_items(spark):
    items = spark.createDataFrame([(1, "ab\ncd\nefghijklmnop\nq"), (2, "")], "item_id long, text string")
    assert [r.text for r in ingest.parts(items, 6).orderBy("part").collect()] == ["ab\ncd", "\nefghi", "jklmno", "p\nq"]
    ledger = spark.createDataFrame([("a", "ai_chat", "x"), ("b", "bulk_imported", "x"), ("c", "ai_chat", None), ("d", "ai_chat", "x"), ("e", "ai_chat", "x")], "id string, kind string, raw_payload string")
    done = spark.createDataFrame([("d",)], "id string")
    assert [r.id for r in ingest.event_items(ledger, done, "a").collect()] == ["e"]
    assert [r.id for r in ingest.event_items(ledger, done, event_id="a").collect()] == ["a"]
    once = ingest.not_done(items.selectExpr("item_id", "text", "'o' as origin"), spark.createDataFrame([], "key string"))
    assert once.count() == 2 and ingest.not_done(once.drop("key"), once).count() == 0


def test_procedures_chats_answers(spark):
    c = spark.createDataFrame([("a-b", "A b", 0.9), ("new", "Deploy", 0.9), ("low", "Low", 0.5), ("x", "deploy  IT", 0.9)], "suggested_slug string, title string, confidence double")
    have = spark.createDataFrame([("a-b", "Other"), ("z", "Deploy it")], "slug string, title string")
    assert [r.suggested_slug for r in ingest.new_procedures(c, have, have.limit(0)).collect()] == ["new"]
    events = spark.createDataFrame([("1", "ai_chat", "My Chat", "hi"), ("2", "ai_chat", "My chat", "yo"), ("3", "capture", "x", "n"), ("4", "ai_chat", "old", "o")], "id string, kind string, title string, raw_payload string")
    pages = spark.createDataFrame([("my-chat", "0"), ("p", "4")], "page_slug string, source_event string")
    got = ingest.promoted_chats(events, pages, lambda s: s.str.upper()).orderBy("page_slug").collect()
    assert [(r.page_slug, r.text) for r in got] == [("my-chat_1", "HI"), ("my-chat_2", "YO")]
    res = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query_id int, rank int, page_slug string")
    texts = spark.createDataFrame([("a", "A"), ("b", "B")], "page_slug string, text string")
    q = spark.createDataFrame([(1, "q")], "query_id int, query string")
    assert [tuple(r) for r in ingest.answers(res, texts, q, lambda q, t: q + "".join(t)).collect()] == [(1, "qAB")]


class ProviderError(Exception):
    status_code = 429


CALLS = 0


def flaky(text):
    n = int(text)
    if n == 500:
        raise TimeoutError("late")
    if n == 501:
        raise RuntimeError("wrapped") from ProviderError("busy")
    if n == 502:
        raise KeyError("x")
    if n == 503:
        return "[1, 2]"
    if n == 504:
        raise FileNotFoundError("gone")
    return '{"timeline_summary": "' + text + '"}'


def test_failing_texts_leave_the_others(spark):
    texts = spark.range(1000).selectExpr("id as item_id", "cast(0 as int) as part", "cast(id as string) as text").repartition(4)
    signals, failures = ingest.extract_all(texts, flaky, provider=(ProviderError,))
    got = {r.item_id: (r.kind, r.error_class, r.attempts) for r in failures.collect()}
    assert got == {500: ("transient", "TimeoutError", 3), 501: ("transient", "RuntimeError,ProviderError", 3), 502: ("content", "KeyError", 1), 503: ("content", "JSONDecodeError", 1), 504: ("infrastructure", "FileNotFoundError", 1)}
    assert {r.item_id: r.signal.timeline_summary for r in signals.collect()} == {i: str(i) for i in range(1000) if not 500 <= i <= 504}
    signals, failures = ingest.extract_all(texts.limit(0), flaky)
    assert signals.collect() == [] and failures.collect() == []
