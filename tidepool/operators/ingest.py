"""Ingest: collect items, extract signals with the caller's function, resolve, decide, and give the changes as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators import facts as facts_ops
from tidepool.operators import links as links_ops
from tidepool.operators.tables import cut

ENTITY = "struct<name:string,type:string,confidence:double>"
FACT = "struct<subject:string,predicate:string,object:string,object_type:string,valid_from:string,valid_to:string,confidence:double>"
PROCEDURE = "struct<suggested_slug:string,title:string,summary:string,steps:array<string>,confidence:double>"
SIGNAL = f"struct<entities:array<{ENTITY}>,facts:array<{FACT}>,procedure_candidates:array<{PROCEDURE}>,timeline_summary:string,suggested_page_type:string>"
NOT_ITEMS = ("bulk_imported", "laundry_ingested")


def event_items(ledger: DataFrame, done: DataFrame, cursor: str = "", event_id: str | None = None) -> DataFrame:
    """Events to ingest: with text, of an ingestible kind, after the cursor and not done; one event alone ignores the cursor."""
    items = ledger.where(F.col("raw_payload").isNotNull() & ~F.col("kind").isin(*NOT_ITEMS))
    items = items.where(F.col("id") == event_id) if event_id else items.where(F.col("id") > cursor)
    return items.join(done.select("id"), "id", "left_anti")


def operation_key(origin: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\0", origin, F.sha2(text, 256)), 256)


def not_done(items: DataFrame, committed: DataFrame) -> DataFrame:
    """Items whose operation key no run has committed."""
    return items.withColumn("key", operation_key(F.col("origin"), F.col("text"))).join(committed.select("key"), "key", "left_anti")


def collected(inbox: DataFrame, events: DataFrame, limit: int | None = None) -> DataFrame:
    """source, key, text of the items to work on: the inbox by path, then events by id, of all of them the first `limit`."""
    rows = inbox.select(F.lit("inbox").alias("source"), F.col("path").alias("key"), "text").unionByName(events.select(F.lit("events").alias("source"), F.col("id").alias("key"), F.col("raw_payload").alias("text")))
    out = rows.orderBy(F.col("source") != "inbox", "key")
    return out if limit is None else out.limit(limit)


def dry_counts(items: DataFrame) -> DataFrame:
    """source, items: what a run would work on."""
    return items.groupBy("source").agg(F.count("*").alias("items"))


def advanced_cursor(ledger: DataFrame, unfinished: DataFrame) -> DataFrame:
    """cursor: the last event id before the first unfinished one; the last of all where none is unfinished, null where all are later."""
    stop = unfinished.agg(F.min("id").alias("stop"))
    return ledger.select("id").join(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("id") < F.col("stop"))).agg(F.max("id").alias("cursor"))


def parts(items: DataFrame, limit: int = 6000) -> DataFrame:
    """item_id, part, text: texts above the limit are cut before the last line end inside it, if that lies beyond half, else at the limit."""
    text, half = F.col("text"), limit // 2
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))

    def step(s, _):
        window = F.substring(text, s["at"] + 1, F.lit(limit))
        last = F.lit(limit) - F.locate("\n", F.reverse(window))
        size = F.when((last < limit) & (last > half), last).otherwise(limit)
        more = F.length(text) - s["at"] > limit
        return F.struct((s["at"] + F.when(more, size).otherwise(0)).alias("at"), F.when(more, F.array_append(s["cuts"], s["at"] + size)).otherwise(s["cuts"]).alias("cuts"))

    steps = F.sequence(F.lit(0), F.floor(F.length(text) / (half + 1)).cast("int"))
    cuts = F.concat(F.array(F.lit(0)), F.aggregate(steps, start, step, lambda s: s["cuts"]))
    rows = items.where(F.length(text) > 0).withColumn("cuts", cuts).select("item_id", "text", "cuts", F.posexplode("cuts").alias("part", "at"))
    end = F.coalesce(F.get("cuts", F.col("part") + 1), F.length("text"))
    return rows.select("item_id", "part", F.substring("text", F.col("at") + 1, end - F.col("at")).alias("text"))


def extract(texts: DataFrame, fn: Callable[[str], str]) -> DataFrame:
    """item_id, part, signal: the caller's fn gives the signal of a text as JSON. Python runs on the workers, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b.item_id, "part": b.part, "payload": b.text.map(fn)})

    raw = texts.select("item_id", "part", "text").mapInPandas(run, f"item_id {dict(texts.dtypes)['item_id']}, part int, payload string")
    return raw.select("item_id", "part", normalized_signal(F.col("payload")).alias("signal"))


ATTEMPT = "payload string, attempts int, error_class string, message string, status_code int, from_model boolean"


def _chain(error: BaseException) -> list[BaseException]:
    out: list[BaseException] = []
    while error is not None and error not in out:
        out.append(error)
        error = error.__cause__ or error.__context__
    return out


def _attempt(fn: Callable, args: tuple, retries: int, provider: tuple[type[BaseException], ...]) -> tuple:
    """What fn gives, or what went wrong at the last attempt; only passing failures are tried again."""
    for n in range(1, retries + 2):
        try:
            return fn(*args), n, None, None, None, None
        except Exception as e:  # whatever the caller's function raises is a row
            chain = _chain(e)
            names = [type(x).__name__ for x in chain]
            codes = [x.status_code for x in chain if isinstance(getattr(x, "status_code", None), int)]
            of_model = any(isinstance(x, provider) for x in chain)
            named = any(t in x.lower() for x in names for t in T.TRANSIENT_ERRORS) or any(c in T.TRANSIENT_CODES or c >= 500 for c in codes)
            if n > retries or not (isinstance(e, (TimeoutError, ConnectionError)) or of_model and named):
                return None, n, ",".join(names), " ".join(map(str, chain)), codes[0] if codes else None, of_model


def extract_all(texts: DataFrame, fn: Callable[[str], str], retries: int = 2, provider: tuple[type[BaseException], ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(signals: item_id, part, signal; failures: item_id, part, kind, error_class, message, attempts) of all texts.

    A text on which fn fails is a row of failures, by kind (see failure_kind), and stops no other. Timeouts, broken
    connections and passing errors of the provider's classes are tried again, at most retries times. Payloads that are no JSON
    object are failures of content. Every text is given to fn in one pass, whose outcome is a checkpoint that both tables read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = pd.DataFrame([_attempt(fn, (x,), retries, provider) for x in b.text], columns=[c.split()[0] for c in ATTEMPT.split(", ")])
            yield pd.DataFrame({"item_id": b.item_id.reset_index(drop=True), "part": b.part.reset_index(drop=True), **{c: found[c] for c in found}})

    raw = cut(texts.select("item_id", "part", "text").mapInPandas(run, f"item_id {dict(texts.dtypes)['item_id']}, part int, {ATTEMPT}"))
    # without an error class nothing was raised
    object_ = F.json_object_keys("payload").isNotNull()
    error = F.coalesce("error_class", F.when(~object_, "JSONDecodeError"))
    failed = raw.withColumn("error_class", error).where("error_class is not null")
    failures = failed.select("item_id", "part", T.failure_kind(F.col("error_class"), F.col("message"), F.col("status_code"), F.col("from_model")).alias("kind"), "error_class", "message", "attempts")
    return raw.where(F.col("error_class").isNull() & object_).select("item_id", "part", normalized_signal(F.col("payload")).alias("signal")), failures


def normalized_signal(payload: Column) -> Column:
    """A signal from JSON: missing confidences are one half, object types are canonical."""
    s = F.from_json(payload, SIGNAL)
    half = lambda x: F.coalesce(x["confidence"], F.lit(0.5)).alias("confidence")
    entities = F.transform(s["entities"], lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), half(x)))
    found = F.transform(s["facts"], lambda x: F.struct(x["subject"].alias("subject"), T.normalize_predicate(x["predicate"]).alias("predicate"), x["object"].alias("object"), T.object_type(x["object_type"]).alias("object_type"), x["valid_from"].alias("valid_from"), x["valid_to"].alias("valid_to"), half(x)))
    steps = F.transform(s["procedure_candidates"], lambda x: F.struct(x["suggested_slug"].alias("suggested_slug"), x["title"].alias("title"), x["summary"].alias("summary"), x["steps"].alias("steps"), half(x)))
    return F.struct(entities.alias("entities"), found.alias("facts"), steps.alias("procedure_candidates"), s["timeline_summary"].alias("timeline_summary"), s["suggested_page_type"].alias("suggested_page_type"))


def _best(df: DataFrame, key: list[str]) -> DataFrame:
    """The row of each key with the highest confidence, the first on ties."""
    w = Window.partitionBy(*key).orderBy(F.desc("confidence"), "part", "pos")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merged_entities(signals: DataFrame) -> DataFrame:
    rows = signals.select("item_id", "part", F.posexplode("signal.entities").alias("pos", "e")).select("item_id", "part", "pos", "e.*")
    return _best(rows.withColumn("norm", T.normalize_name(F.col("name"))), ["item_id", "norm"])


def merged_facts(signals: DataFrame) -> DataFrame:
    rows = signals.select("item_id", "part", F.posexplode("signal.facts").alias("pos", "f")).select("item_id", "part", "pos", "f.*")
    return _best(rows, ["item_id", "subject", "predicate", "object", "valid_from", "valid_to"])


def merged_procedures(signals: DataFrame) -> DataFrame:
    rows = signals.select("item_id", "part", F.posexplode("signal.procedure_candidates").alias("pos", "p")).select("item_id", "part", "pos", "p.*")
    return _best(rows, ["item_id", "suggested_slug"])


def focused(facts: DataFrame, entities: DataFrame, reject: float = facts_ops.REJECT, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts above the reject limit with paths and addresses as literals, entities that some fact names).

    registry: name, title of known entities; a path or address stays an entity where one of that name has a title that is none.
    """
    kept = facts.where(F.col("confidence") >= reject).withColumn("norm", T.normalize_name(F.col("object")))
    artifact = (F.col("object_type") == "entity") & T.artifact_value(F.col("object"))
    if registry is not None:
        real = registry.where(~T.artifact_value(F.col("title"))).select(T.normalize_name(F.col("name")).alias("norm"), F.lit(True).alias("real")).distinct()
        kept = kept.join(real, "norm", "left")
        artifact = artifact & F.col("real").isNull()
    kept = kept.withColumn("object_type", F.when(artifact, "literal").otherwise(F.col("object_type"))).select(*facts.columns)
    ends = kept.select("item_id", F.explode(F.array_compact(F.array("subject", F.when(F.col("object_type") == "entity", F.col("object"))))).alias("name")).select("item_id", T.normalize_name(F.col("name")).alias("norm")).distinct()
    return kept, entities.join(ends, ["item_id", "norm"], "left_semi")


def ingest(signals: DataFrame, items: DataFrame, entities: DataFrame, aliases: DataFrame, facts: DataFrame) -> dict[str, DataFrame]:
    """Changes that signals make: entities (new), decided, facts (new, with ids), pending (an end is not known), procedures, timeline,
    mentions, links (that new timeline lines make) and reviews (kind, key, payload).

    signals: item_id, part, signal; items: item_id (in order), event_id, entry_date, source_ref. All facts of the batch see
    each other in order of item and place.
    """
    registry = entities.select(F.explode(F.array("id", "title")).alias("name"), "title").unionByName(aliases.join(entities.select(F.col("id").alias("entity_id"), "title"), "entity_id").select(F.col("alias").alias("name"), "title"))
    kept, named = focused(merged_facts(signals), merged_entities(signals), registry=registry)
    names = named.select("item_id", "name", "norm", F.col("type").alias("hint_type"), "confidence")
    resolved = facts_ops.resolve(names.select(F.struct("item_id", "norm", "hint_type", "confidence").alias("mention_id"), "name", "hint_type", "confidence"), entities, aliases)
    known = resolved.select(F.col("mention_id.item_id").alias("item_id"), F.col("mention_id.norm").alias("norm"), F.col("mention_id.hint_type").alias("type"), F.col("mention_id.confidence").alias("confidence"), "name", "entity_id", "how")
    end = known.select("item_id", "norm", "entity_id")
    c = kept.withColumn("norm", T.normalize_name(F.col("subject"))).join(end.withColumnRenamed("entity_id", "subject_id"), ["item_id", "norm"], "left")
    c = c.withColumn("norm", F.when(F.col("object_type") == "entity", T.normalize_name(F.col("object")))).join(end.withColumnRenamed("entity_id", "object_id"), ["item_id", "norm"], "left")
    open_end = F.col("subject_id").isNull() | ((F.col("object_type") == "entity") & F.col("object_id").isNull())
    origin = items.select("item_id", "event_id", "source_ref", "entry_date")
    ready = c.where(~open_end).select("item_id", "part", "pos", F.col("subject_id").alias("subject"), "predicate", F.coalesce("object_id", "object").alias("object"), "object_type", "valid_from", "valid_to", "confidence")
    ready = ready.join(origin, "item_id").withColumn("ord", F.struct("item_id", "part", "pos"))
    decided = facts_ops.decide(ready, facts_ops.active_facts(facts).select("subject", "predicate", "object"))
    touched = decided.where("outcome = 'added'").groupBy("subject", "event_id").agg(F.min("entry_date").alias("entry_date"))
    said = signals.groupBy("item_id").agg(F.min_by(F.col("signal.timeline_summary"), "part").alias("description")).join(items.select("item_id", "event_id"), "item_id")
    timeline = touched.join(said.select("event_id", "description"), "event_id").select(F.col("subject").alias("page_slug"), "entry_date", "event_id", "description")
    pending = c.where(open_end).select("item_id", "subject", "predicate", "object", "object_type", "valid_from", "valid_to", "confidence")
    procedures = merged_procedures(signals).join(origin, "item_id").select("item_id", "suggested_slug", "title", "summary", "steps", "confidence", "event_id", "source_ref")
    lines = timeline.groupBy("page_slug").agg(F.lit(None).cast("string").alias("page_type"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_date", "event_id", "description"))), lambda x: x["description"]), "\n").alias("text"))
    kind = F.col("type") if "type" in entities.columns else F.lit(None).cast("string")
    types = entities.select(F.col("id").alias("entity_id"), "title", kind.alias("entity_type"))
    owned = types.select(F.col("title").alias("alias"), "entity_id", "entity_type").unionByName(aliases.join(types, "entity_id").select("alias", "entity_id", "entity_type"))
    return {
        "entities": known.where("how = 'created'").groupBy("entity_id").agg(F.min("type").alias("type"), F.min("name").alias("title")),
        "decided": decided,
        "facts": facts_ops.new_facts(decided, facts),
        "pending": pending,
        "procedures": procedures,
        "timeline": timeline,
        "mentions": known.where("entity_id is not null").groupBy("entity_id").agg(F.count("*").alias("mentions")),
        "links": links_ops.alias_links(links_ops.page_lines(lines), owned),
        "reviews": reviews_of(decided, pending, known, procedures),
    }


def reviews_of(decided: DataFrame, pending: DataFrame, resolved: DataFrame, procedures: DataFrame, accept: float = facts_ops.ACCEPT) -> DataFrame:
    """kind, key, payload of what a person has to decide: facts of low confidence, conflicts, facts with an open end, names that
    were not resolved, and procedures."""
    fact = ["subject", "predicate", "object", "object_type", "valid_from", "valid_to", "confidence"]
    rows = lambda df, kind, payload: df.select(F.lit(kind).alias("kind"), "item_id", F.to_json(F.struct(*payload)).alias("payload"))
    out = rows(decided.where("outcome = 'low-confidence review'"), "low_confidence", fact)
    out = out.unionByName(rows(decided.where("outcome = 'conflict review'"), "fact_conflict", fact)).unionByName(rows(pending, "pending_fact", fact))
    out = out.unionByName(rows(resolved.where("how in ('unresolved', 'ambiguous')"), "new_entity", ["name", "type", "confidence"]))
    out = out.unionByName(rows(procedures.where(F.col("confidence") >= accept), "procedure_candidate", ["suggested_slug", "title", "summary", "steps", "confidence"]))
    return out.select("kind", F.sha2(F.concat_ws("\0", F.col("item_id").cast("string"), "kind", "payload"), 256).alias("key"), "payload")


def stub_pages(timeline: DataFrame, entities: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages to create for touched entities without one; passing names wait for their second mention. entities: id, title, mention_count."""
    new = timeline.select(F.col("page_slug").alias("id")).distinct().join(pages.select(F.col("page_slug").alias("id")), "id", "left_anti").join(entities, "id")
    due = ~T.is_transient(F.col("id"), F.col("title")) | (F.col("mention_count") >= 2)
    return new.where(due).select(F.col("id").alias("page_slug"), "title", F.lit(T.STUB).alias("text"))


def touch(timeline: DataFrame, new: DataFrame, pages: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(timeline with the new lines, pages to create): a page gets one line for each event, however often it is touched.

    timeline: page_slug, pos, entry_date, event_id, description; new has the same without pos.
    """
    from tidepool.sources.sinks import append_timeline

    nth = F.row_number().over(Window.partitionBy("page_slug").orderBy("entry_date", "event_id")) - 1
    fresh = new.dropDuplicates(["page_slug", "event_id"]).withColumn("pos", nth.cast("long"))
    return append_timeline(timeline, fresh.select(*timeline.columns)), stub_pages(new, entities, pages)


def new_procedures(candidates: DataFrame, pages: DataFrame, pending: DataFrame, accept: float = facts_ops.ACCEPT) -> DataFrame:
    """Procedure candidates with enough confidence that no page or review has by slug or title."""
    c = candidates.where((F.col("confidence") >= accept) & F.col("title").isNotNull()).withColumn("norm", T.normalize_name(F.col("title")))
    have = pages.select("slug", "title").unionByName(pending.select("slug", "title"))
    c = c.join(have.select(F.col("slug").alias("suggested_slug")), "suggested_slug", "left_anti")
    return c.join(have.select(T.normalize_name(F.col("title")).alias("norm")), "norm", "left_anti")


def promoted_chats(events: DataFrame, pages: DataFrame, draft: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """page_slug, title, text of chats(id, title, raw_payload) that no page came from yet; draft turns a chat into a page text.

    pages: page_slug, source_event. Slugs that exist get a number.
    """
    from tidepool.operators.assemble import unique_names

    new = events.where("kind in ('ai_chat', 'human_chat')").join(pages.select(F.col("source_event").alias("id")), "id", "left_anti")
    text = F.pandas_udf(draft, "string")(F.col("raw_payload")) if draft else F.col("raw_payload")
    rows = new.select(F.col("id").alias("key"), F.coalesce(T.slug(F.col("title")), F.lit("conversation")).alias("name"), "title", text.alias("text"))
    return unique_names(rows, pages.select(F.col("page_slug").alias("name"))).select(F.col("unique_name").alias("page_slug"), "title", "text", F.col("key").alias("source_event"))


def answers(results: DataFrame, pages: DataFrame, queries: DataFrame, fn: Callable[[str, list[str]], str]) -> DataFrame:
    """query_id, answer: the caller's fn on each question and the texts of its ranked pages."""
    asked = results.select("query_id", "rank", "page_slug").join(pages.select("page_slug", "text"), "page_slug").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts")).join(queries, "query_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"query_id": b.query_id, "answer": [fn(q, list(t)) for q, t in zip(b["query"], b.texts, strict=True)]})

    return asked.select("query_id", "query", "texts").mapInPandas(run, f"query_id {dict(queries.dtypes)['query_id']}, answer string")
