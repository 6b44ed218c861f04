"""Conversations as JSON lines: order over split files, one form a file."""

import json

from tidepool.sources import documents


def test_forms_and_order_over_blocks(spark, tmp_path):
    said = lambda c, n: {"conversation_id": c, "role": "user", "content": f"{n} " + "x" * 90}
    files = {
        "flat": [said(f"c{n % 3}", n) for n in range(900)],
        "nested": [{"id": "" if n % 2 else f"n{n}", "messages": [{"role": "user", "content": "hi"}, {"role": "bot", "content": str(n), "model": "m"}]} for n in range(300)],
        "mixed": [said("c", 1), {"messages": []}],
        "list": [said("c", 1), [1]],
        "other": [{"a": 1}],
    }
    for name, rows in files.items():
        (tmp_path / f"{name}.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows) + "\n \n")
    (tmp_path / "broken.jsonl").write_text('{"conversation_id": "c", "role": "r", "content": "x"}\n{"conv')
    (tmp_path / "blank.jsonl").write_text(" \n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        nested, flat, refused = documents.conversation_rows(spark, str(tmp_path))
        assert [r.content.split()[0] for r in flat.orderBy("pos").collect()] == [str(n) for n in range(900)]
        assert [(r.nth, r.id) for r in nested.orderBy("nth").collect()] == [(n + 1, None if n % 2 else f"n{n}") for n in range(300)]
        errors = {r.file.rpartition("/")[2]: r.error for r in refused.collect()}
        assert set(errors) == {"mixed.jsonl", "list.jsonl", "other.jsonl", "broken.jsonl"} and errors["mixed.jsonl"] != errors["list.jsonl"] == errors["broken.jsonl"]
        docs = {r.conversation_id: r for r in documents.conversations_flat(flat).collect()}
        assert docs["c1"].content.startswith("**user**: 1 x") and docs["c1"].content.count("**user**") == 300
        titles = {r.conversation_id for r in documents.conversations_nested(nested).collect()}
        assert {"n0", "conversation-2"} <= titles
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
