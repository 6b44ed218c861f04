"""Streams give what the batch operators give."""

import json
from datetime import timedelta

from pyspark.sql import functions as F

from tidepool.operators import assemble
from tidepool.sources import documents
from tidepool.streaming import ledger

ULID = "01ARZ3NDEKTSV4RRFFQ69G5{:03d}".format


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def event(n, **more):
    return {"id": ULID(n), "kind": "ai_chat", "timestamp": "2026-01-01T00:00:00Z", "confidence": 0.5, "metadata": {}, **more}


def drain(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_apply_once_over_restarts(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    write(folder, "a.json", [event(1), event(2), event(2)])
    for n in range(3):
        good, _ = ledger.split_bad(ledger.tail(spark, str(folder)))
        ledger.apply_once(good.select("id", "kind"), ["id"], out, mark).awaitTermination(120)
        write(folder, f"b{n}.json", [event(2), event(10 + n)])
    got = [r.id for r in spark.read.parquet(out).collect()]
    assert sorted(got) == [ULID(k) for k in (1, 2, 10, 11)]


def test_bad_rows_go_to_their_own_sink(spark, tmp_path):
    write(tmp_path / "in", "a.json", [event(1), "{broken", event(3, kind="odd"), event(4, confidence=3)])
    good, bad = ledger.split_bad(ledger.tail(spark, str(tmp_path / "in")))
    assert drain(good, "append", "good_rows").count() == 1
    assert sorted(e for r in drain(bad, "append", "bad_rows").collect() for e in r.errors)[0] == "broken"


def test_stream_sets_aside_what_the_batch_does(spark, tmp_path):
    rows = [event(1), event(2, timestamp="not a time"), event(3, more="x"), event(4, timestamp=None), event(5, confidence=2), "  ", "[1]", "{}"]
    write(tmp_path / "in", "a.json", rows)
    good, bad = documents.read_ledger(spark, str(tmp_path / "in"))
    streamed = ledger.split_bad(ledger.tail(spark, str(tmp_path / "in")))
    assert {r.id for r in drain(streamed[0], "append", "good_stream").collect()} == {r.id for r in good.collect()} == {ULID(1)}
    errors = lambda df: sorted((r.id or "", tuple(r.errors)) for r in df.collect())
    assert errors(drain(streamed[1], "append", "bad_stream")) == errors(bad) and len(errors(bad)) == 6


def test_each_proposal_once(spark, tmp_path):
    for n in range(4):
        write(tmp_path / "in", f"{n}.json", [{"entity_id": "a"}] * 3 + [{"entity_id": "b"}])
    stream = spark.readStream.schema("entity_id string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = drain(ledger.tier_alerts(stream), "append", "alerts").collect()
    assert sorted((r.entity_id, r.proposed_tier, r.mentions) for r in got) == [("a", 1, 8), ("a", 2, 3), ("b", 2, 3)]
    counts = drain(ledger.mention_counts(stream), "complete", "mention_totals").collect()
    assert {(r.entity_id, r.mentions) for r in counts} == {("a", 12), ("b", 4)}


def test_lifecycle_equals_batch(spark, tmp_path):
    runs = [("a", i, i % 7 != 6) for i in range(20)] + [("b", i, True) for i in range(6)] + [("c", i, i < 2) for i in range(6)]
    for n in range(5):
        write(tmp_path / "in", f"{n}.json", [{"slug": s, "seq": i, "ok": ok} for s, i, ok in runs if i % 20 // 4 == n])
    schema = "slug string, seq long, ok boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = drain(ledger.procedure_states(stream), "update", "states")
    last = {r.slug: (r.status, r.success_count, r.fail_count) for r in got.orderBy(F.col("success_count") + F.col("fail_count")).collect()}
    want = {r.slug: (r.status, r.success_count, r.fail_count) for r in assemble.procedure_states(spark.createDataFrame(runs, schema)).collect()}
    assert last == want


def test_repeats_and_touched_pages(spark, tmp_path):
    write(tmp_path / "in", "a.json", [{"k": "x", "page_slug": "p", "at": "2026-01-01T00:00:00Z"}] * 2 + [{"k": "y", "page_slug": "q", "at": "2026-01-01T00:00:00Z"}])
    stream = spark.readStream.schema("k string, page_slug string, at timestamp").json(str(tmp_path / "in"))
    assert drain(ledger.without_repeats(stream, ["k"]), "append", "uniq").count() == 2
    assert drain(ledger.without_repeats(stream, ["k"], "at"), "append", "uniq_within").count() == 2
    seen = []
    ledger.maintain_index(stream, str(tmp_path / "mark"), lambda slugs, n: seen.extend(r.page_slug for r in slugs.collect())).awaitTermination(120)
    assert sorted(seen) == ["p", "q"]


def alerts_over_restarts(spark, tmp_path, files, schema, **more):
    """Rows of tier_alerts, one start of the query for each file, over one checkpoint."""
    for n, rows in enumerate(files):
        write(tmp_path / "in", f"{n}.json", rows)
        stream = ledger.tier_alerts(spark.readStream.schema(schema).json(str(tmp_path / "in")), **more)
        out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(120)
    return sorted(tuple(r) for r in spark.read.parquet(out).collect())


def test_counts_go_on_after_a_restart(spark, tmp_path):
    again = [{"entity_id": "a", "rejected": 2}]
    files = [[{"entity_id": "a"}] * 3, again, [{"entity_id": "a"}] * 9, [{"entity_id": "a"}] * 5]
    got = alerts_over_restarts(spark, tmp_path, files, "entity_id string, rejected int")
    assert got == [("a", 1, 8), ("a", 2, 3), ("a", 2, 13)]  # turned down at 3, so due again at 13


def test_idle_entities_are_forgotten(spark, tmp_path):
    at = lambda e, day, n=1: [{"entity_id": e, "at": f"2026-01-{day:02d}T00:00:00Z"}] * n
    # a has two mentions, then the clock goes on by b; a starts anew, and reaches 3 with the mentions of day 22 alone
    files = [at("a", 1, 2) + at("d", 1) + at("c", 18, 2), at("b", 20), at("b", 21), at("a", 22) + at("c", 22), at("a", 22, 2)]
    more = {"time": "at", "idle": timedelta(days=5), "late": "1 hour"}
    got = alerts_over_restarts(spark, tmp_path, files, "entity_id string, at timestamp", **more)
    assert [(e, m) for e, _, m in got] == [("a", 3), ("c", 3)]
    state = spark.read.format("statestore").option("path", str(tmp_path / "mark")).option("stateVarName", "seen").load()
    counts = {r.key.entity_id: r.value.n for r in state.collect()}
    assert counts == {"a": 3, "b": 2, "c": 3}  # no row for d: its timer has cleared the state


def test_a_hot_entity_sends_few_rows(spark, tmp_path):
    write(tmp_path / "in", "a.json", [{"entity_id": "a"}] * 30_000 + [{"entity_id": None}])
    stream = ledger.tier_alerts(spark.readStream.schema("entity_id string").json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("hot_alerts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("hot_alerts").count() == 2
    parts = list(ledger._mentions_of_batches(iter([spark.createDataFrame([("a", None, None)] * 900, "entity_id string, rejected int, at timestamp").toPandas()])))
    assert [len(p) for p in parts] == [1] and int(parts[0].n[0]) == 900
