"""Listings, lookups and key-value tables around the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators import facts as facts_ops
from tidepool.operators import names

#: The header keys that may stand before a text, and the one privacy mark that permits sharing.
HEADER_KEYS = ("source_agent", "source_context", "source_channel", "source_ref", "privacy")
SHARED = "provider-allowed"
#: Headers that may stand one in another.
DEPTH = 32
#: Page type -> entity type.
ENTITY_TYPE = {"project": "project", "concept": "concept", "event": "event", "experience": "experience", "conversation": "conversation"}


def corpus(pages: DataFrame, scratch: DataFrame, page_type: str | None = None) -> DataFrame:
    """Valid pages of a type; without a type also the two scratch texts as pages. pages: page_slug, page_type, text, errors."""
    valid = pages.where(F.size("errors") == 0)
    if page_type:
        return valid.where(F.col("page_type") == page_type).select("page_slug", "page_type", "text")
    return valid.select("page_slug", "page_type", "text").unionByName(scratch.select(F.col("marker").alias("page_slug"), F.lit("scratch").alias("page_type"), "text"))


def inbox(files: DataFrame, processed: DataFrame) -> DataFrame:
    """path, text, read_error of unprocessed files(path, content): bytes that are no UTF-8 are an error of their row only."""
    raw = files.where(~F.col("path").rlike("(^|/)(processed|failed)/")).join(processed.select("path"), "path", "left_anti")
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    return raw.select("path", F.when(ok, F.regexp_replace(F.col("content").cast("string"), "^﻿", "")).alias("text"), F.when(~ok, "not UTF-8").alias("read_error"))


def inbox_metadata(raw: DataFrame) -> DataFrame:
    """path, text, metadata, read_error of inbox rows: front matter that has no end, or lines that are no `key: value`, is an error of
    its row only."""
    from tidepool.sources.documents import split_front_matter

    meta, _ = split_front_matter(F.col("text"))
    opened = F.col("text").rlike(r"\A---\r?\n")
    block = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    bad = F.exists(F.split(block, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^(?:\s*#|\s*-\s|\s+\S|[^:\s][^:]*:)"))
    closed = F.col("text").rlike(r"(?s)\A---\r?\n(?:.*?\r?\n)?---(?:\r?\n|\z)")
    error = F.coalesce(F.col("read_error"), F.when(opened & (~closed | bad), "metadata"))
    return raw.select("path", "text", F.when(error.isNull(), meta).alias("metadata"), error.alias("read_error"))


def inbox_counts(files: DataFrame) -> DataFrame:
    """pending and failed files by the first part of their path."""
    first = F.substring_index("path", "/", 1)
    return files.agg(F.count_if(~first.isin("processed", "failed")).alias("pending"), F.count_if(first == "failed").alias("failed"))


def failed_inbox(files: DataFrame, n: int) -> DataFrame:
    return files.where(F.col("path").startswith("failed/")).orderBy("path").limit(n)


def provenance(text: Column, depth: int = DEPTH) -> tuple[Column, Column]:
    """(text without its header lines and front matter, privacy mark or null); any mark but the sharing one wins.

    Headers may stand in front matter and front matter before headers, each up to `depth` times. What is left beyond that
    many counts as the mark "too deep", which does not permit sharing.
    """
    front, line = r"\A---\r?\n(?s:.*?)\r?\n---(?:\r?\n|\z)", rf"\A(?:[ \t]*(?:{'|'.join(HEADER_KEYS)}):[^\n]*(?:\n|\z))+"
    trim = lambda c: F.regexp_replace(c, r"\A[\s\x{FEFF}]+|\s+\z", "")
    one = rf"{front}|{line}"

    def peel(s, _):
        def without(rest):
            body = F.when(rest == "", s["body"]).otherwise(trim(F.substring(s["body"], F.length(rest) + 1, F.length(s["body"]))))
            return F.struct(body.alias("body"), F.concat(s["head"], rest, F.lit("\n")).alias("head"), (rest == "").alias("done"))

        # a lambda's argument is evaluated once, and nothing is once the last header is off
        return F.when(s["done"], s).otherwise(F.get(F.transform(F.array(F.regexp_extract(s["body"], one, 0)), without), F.lit(0)))

    start = F.struct(trim(text).alias("body"), F.lit("").alias("head"), F.lit(False).alias("done"))
    # a layer is at most a front matter and a header
    out = F.aggregate(F.sequence(F.lit(1), F.lit(2 * depth)), start, peel)
    marks = F.transform(F.regexp_extract_all(out["head"], F.lit(r"(?m)^[ \t]*privacy:([^\n]*)"), F.lit(1)), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+$", "")), "^[\"']|[\"']$", ""))
    deep = F.when(out["body"].rlike(one), F.array(F.lit("too deep"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(marks, deep)
    return out["body"], F.coalesce(F.get(F.filter(every, lambda x: x != SHARED), F.lit(0)), F.get(every, F.lit(0)))


def entity_type(explicit: Column, page_type: Column, tags: Column, existing: Column) -> Column:
    """Stated type, else that of the page type, else the first tag that is one, else what the registry has."""
    known = list(ENTITY_TYPE.values()) + ["person", "org", "place"]
    return F.coalesce(explicit, T.lookup(page_type, ENTITY_TYPE, F.lit(None)), F.get(F.filter(tags, lambda x: x.isin(known)), F.lit(0)), existing)


def pending_reviews(reviews: DataFrame, kind: str | None = None) -> DataFrame:
    out = reviews.where("status = 'pending'")
    return out.where(F.col("kind") == kind) if kind else out


def review_headers(reviews: DataFrame) -> DataFrame:
    """Header columns only: the scan reads no payload."""
    return reviews.select("review_id", "kind", "status")


def invalid_reviews(reviews: DataFrame) -> DataFrame:
    """Pending, undecided items with broken content, to set aside."""
    return reviews.where((F.col("status") == "pending") & (F.col("action") == "none") & (F.size("errors") > 0))


def procedures(pages: DataFrame, status: str | None = None, n: int = 20) -> DataFrame:
    out = pages.where("page_type = 'procedure'")
    return (out.where(F.col("status") == status) if status else out).orderBy("page_slug").limit(n)


def recent_events(ledger: DataFrame, n: int = 10, kind: str | None = None, entity: str | None = None) -> DataFrame:
    """Newest events of a kind that touch an entity. ledger: id, kind, affected_pages, metadata."""
    out = ledger.where(F.col("kind") == kind) if kind else ledger
    if entity:
        meta = [F.try_element_at("metadata", F.lit(k)) == entity for k in ("entity_id", "slug", "subject")]
        out = out.where(F.coalesce(T.any_of([F.array_contains("affected_pages", entity), *(F.coalesce(m, F.lit(False)) for m in meta)]), F.lit(False)))
    return out.orderBy(F.desc("id")).limit(n)


def recent_runs(ledger: DataFrame, n: int = 5) -> DataFrame:
    """id, line: the newest n procedure runs that name a procedure and a result, newest first. ledger: id, timestamp, raw_payload, metadata."""
    get = lambda k: F.nullif(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    runs = ledger.where((get("operation") == "run") & get("procedure").isNotNull() & get("result").isNotNull())
    line = F.concat(F.substring(F.col("timestamp").cast("string"), 1, 10), F.lit(" "), get("procedure"), F.lit(" "), get("result"), F.lit(": "), F.trim(F.coalesce("raw_payload", F.lit(""))))
    return runs.orderBy(F.desc("id")).limit(n).select("id", line.alias("line"))


def name_order(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, entity_id, nth: every name once, in the order in which names are looked up: aliases by their text, then each entity's
    title and id, by id. The first owner keeps a name; of equal aliases the smallest id."""
    rows = aliases.select(F.col("alias").alias("name"), "entity_id", F.struct(F.lit(0).alias("a"), F.col("alias").alias("b"), F.lit(0).alias("c"), F.col("entity_id").alias("d")).alias("nth"))
    for c, name in ((0, "title"), (1, "id")):
        rows = rows.unionByName(entities.select(F.col(name).alias("name"), F.col("id").alias("entity_id"), F.struct(F.lit(1).alias("a"), F.col("id").alias("b"), F.lit(c).alias("c"), F.col("id").alias("d")).alias("nth")))
    return rows.groupBy("name").agg(F.min("nth").alias("nth")).select("name", F.col("nth.d").alias("entity_id"), "nth")


def entity_hints(texts: DataFrame, entities: DataFrame, aliases: DataFrame, shareable: DataFrame, n: int = 30) -> DataFrame:
    """page_slug, hints: the first n shareable entities, in order of their names, that a text names.

    texts: page_slug, text. A name of two characters or more counts wherever it stands in the text, whatever the case of
    either (full case folding). A text that names none has no row.
    """
    order = name_order(entities, aliases).where(F.length("name") >= 2).join(shareable.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    found = names.contained(texts.select("page_slug", "text"), order).join(order, "name")
    first = found.groupBy("page_slug", "entity_id").agg(F.min("nth").alias("nth"))
    nth = F.row_number().over(Window.partitionBy("page_slug").orderBy("nth"))
    return first.withColumn("k", nth).where(F.col("k") <= n).groupBy("page_slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "entity_id"))), lambda x: x["entity_id"]).alias("hints"))


def resolved_pending(pending: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pending facts both of whose ends now have an entity, by id, alias or title."""
    known = facts_ops.alias_map(entities, aliases)
    out = pending.join(known.select(F.col("name").alias("subject"), F.col("entity_id").alias("_s")), "subject", "left").join(known.select(F.col("name").alias("object"), F.col("entity_id").alias("_o")), "object", "left")
    keep = F.col("_s").isNotNull() & ((F.col("object_type") != "entity") | F.col("_o").isNotNull())
    return out.where(keep).withColumn("subject", F.col("_s")).withColumn("object", F.when(F.col("object_type") == "entity", F.col("_o")).otherwise(F.col("object"))).select(*pending.columns)


def included_pages(slugs: list[str], pages: DataFrame) -> DataFrame:
    """Pages in the caller's order; a slug without a page is an error."""
    asked = pages.sparkSession.createDataFrame(list(enumerate(slugs)), "nth int, page_slug string")
    out = asked.join(pages, "page_slug", "left")
    first = [c for c in pages.columns if c != "page_slug"][0]
    if missing := [r.page_slug for r in out.where(F.col(first).isNull()).select("page_slug").collect()]:
        raise ValueError(f"no page: {', '.join(sorted(missing))}")
    return out.orderBy("nth")


def unique_slugs(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with a slug of their own, slugs that several have)."""
    many = pages.groupBy("page_slug").agg(F.count("*").alias("pages")).where("pages > 1")
    return pages.join(many.select("page_slug"), "page_slug", "left_anti"), many


def proposal_of(decisions: DataFrame, proposals: DataFrame) -> DataFrame:
    """review_id, proposal_id: by review reference, else the latest undecided one for the same entity and tier."""
    by_ref = proposals.select(F.col("review_file").alias("review_id"), F.col("id").alias("ref_id"))
    latest = proposals.where("decision is null").groupBy("entity_id", "proposed_tier").agg(F.max("id").alias("open_id"))
    return decisions.join(by_ref, "review_id", "left").join(latest, ["entity_id", "proposed_tier"], "left").select("review_id", F.coalesce("ref_id", "open_id").alias("proposal_id"))


def decided_proposals(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals with the decisions(proposal_id, decision, decided_at) of a batch."""
    d = decisions.select(F.col("proposal_id").alias("id"), F.col("decision").alias("_d"), F.col("decided_at").alias("_at"))
    return proposals.join(d, "id", "left").withColumn("decision", F.coalesce("_d", "decision")).withColumn("decided_at", F.coalesce("_at", "decided_at")).select(*proposals.columns)


def stats(log: DataFrame) -> DataFrame:
    """key, value of an append-only log(key, seq, op, value): the last `set`, and the sum of the `add` rows after it."""
    last = log.where("op = 'set'").groupBy("key").agg(F.max("seq").alias("_at"), F.max_by("value", "seq").alias("_set"))
    rows = log.where("op = 'add'").join(last.select("key", "_at"), "key", "left").where(F.col("_at").isNull() | (F.col("seq") > F.col("_at")))
    added = rows.groupBy("key").agg(F.sum("value").alias("_add"))
    return last.join(added, "key", "full_outer").select("key", (F.coalesce("_set", F.lit(0.0)) + F.coalesce("_add", F.lit(0.0))).alias("value"))


def usage(stats_: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """tokens, usd, active_jobs, last_ingest_at in one row."""
    def value(key: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("key") == key, F.col("value"))), F.lit(0.0))

    one = stats_.agg(value("tokens").alias("tokens"), value("usd").alias("usd"))
    active = jobs.agg(F.count_if(F.col("status").isin("running", "paused")).alias("active_jobs"))
    return one.join(F.broadcast(active)).join(F.broadcast(runs.agg(F.max("at").alias("last_ingest_at"))))


def mentions_added(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities with the mentions of a batch added to their count."""
    return entities.join(mentions.select(F.col("entity_id").alias("id"), "mentions"), "id", "left").withColumn("mention_count", F.col("mention_count") + F.coalesce("mentions", F.lit(0))).select(*entities.columns)


def event_pages(events: DataFrame) -> DataFrame:
    """page_slug, events: touched pages of a batch of events(affected_pages)."""
    return events.select(F.explode(F.array_distinct("affected_pages")).alias("page_slug")).groupBy("page_slug").agg(F.count("*").alias("events"))
