"""Budgeted context, snapshots, reviews and procedures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators.tables import counted

STATUSES = ("raw", "tested", "stable")
#: Numbers of runs of which one task folds at most as many at once.
RUN_BLOCK = 10_000


def prioritized(text: Column, query: Column) -> Column:
    """Paragraphs in order of shared words with the question, then as they stand."""
    asked = F.array_distinct(T.tokenize(query))
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda p, i: F.struct((-F.size(F.array_intersect(F.array_distinct(T.tokenize(p)), asked))).alias("n"), i.alias("i"), p.alias("p")))
    return F.array_join(F.transform(F.array_sort(parts), lambda s: s["p"]), "\n\n")


def pack(fragments: DataFrame, budget: int) -> DataFrame:
    """query_id, rank, page_slug, action (whole, cut, skipped), tokens: fragments in rank order into a token budget.

    A fragment that fits is taken whole; the first that does not is cut to what is left if at least 20 tokens are, and later
    small ones may still fit. fragments: query_id, rank, page_slug, tokens; a question has at most as many as pages were asked for.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", "page_slug", "tokens")))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.lit(None).cast("array<struct<rank:int,page_slug:string,action:string,tokens:bigint>>").alias("out"))

    def take(s, f):
        whole, cut = f["tokens"] <= s["left"], s["left"] >= 20
        used = F.when(whole, f["tokens"]).when(cut, s["left"]).otherwise(F.lit(0)).cast("long")
        row = F.struct(f["rank"].alias("rank"), f["page_slug"].alias("page_slug"), F.when(whole, "whole").when(cut, "cut").otherwise("skipped").alias("action"), used.alias("tokens"))
        return F.struct((s["left"] - used).alias("left"), F.concat(F.coalesce(s["out"], F.array().cast("array<struct<rank:int,page_slug:string,action:string,tokens:bigint>>")), F.array(row)).alias("out"))

    return fragments.groupBy("query_id").agg(F.aggregate(rows, start, take)["out"].alias("out")).select("query_id", F.inline("out"))


def inject(results: DataFrame, pages: DataFrame, queries: DataFrame, budget: int, include: tuple[str, ...] = (), snapshot: str | None = None) -> DataFrame:
    """query_id, context: the ranked pages of each question as one Markdown text within the token budget.

    A snapshot's text stands first, then the pages of `include` in their order, whatever their rank; both count against the budget.
    """
    if snapshot is not None:
        pages = pages.select("page_slug", "title", "text").unionByName(queries.sparkSession.createDataFrame([("snapshot", "Snapshot", snapshot)], "page_slug string, title string, text string"))
        include = ("snapshot", *include)
    if include:
        forced = queries.select("query_id", F.posexplode(F.array(*map(F.lit, include))).alias("i", "page_slug")).select("query_id", (F.col("i") - len(include)).cast("int").alias("rank"), "page_slug")
        results = forced.unionByName(results.select("query_id", F.col("rank").cast("int").alias("rank"), "page_slug").where(~F.col("page_slug").isin(*include)))
    body = results.select("query_id", "rank", "page_slug").join(pages.select("page_slug", "title", "text"), "page_slug").join(queries, "query_id")
    body = body.withColumn("whole", F.concat(F.lit("## "), "title", F.lit("\n\n"), "text")).withColumn("tokens", T.approximate_tokens(F.col("whole")).cast("long"))
    packed = pack(body.select("query_id", "rank", "page_slug", "tokens"), budget).where("action <> 'skipped'")
    short = F.substring(F.concat(F.lit("## "), "title", F.lit("\n\n"), prioritized(F.col("text"), F.col("query"))), F.lit(1), F.floor(F.col("used") * 3.5).cast("int"))
    parts = packed.select("query_id", "page_slug", "action", F.col("tokens").alias("used")).join(body, ["query_id", "page_slug"]).withColumn("part", F.when(F.col("action") == "whole", F.col("whole")).otherwise(short))
    return parts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n\n").alias("context"))


def latest_by_source(entries: DataFrame) -> DataFrame:
    """Newest entry of each (scope, source) with a note of how many came before. entries: scope, pos, source, text."""
    g = entries.groupBy("scope", "source").agg(F.max("pos").alias("pos"), F.max_by("text", "pos").alias("text"), F.count("*").alias("n"))
    return g.select("scope", "pos", "source", F.when(F.col("n") > 1, F.concat("text", F.lit(" (+"), (F.col("n") - 1).cast("string"), F.lit(" earlier)"))).otherwise(F.col("text")).alias("text"))


def recent_entries(entries: DataFrame, max_items: int = 20, max_chars: int = 4000) -> DataFrame:
    """Newest entries of each scope while there are fewer than max_items and the running length stays within max_chars; the
    newest alone is cut to the limit."""
    w = Window.partitionBy("scope").orderBy(F.desc("pos"))
    top = entries.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= max_items).withColumn("chars", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = top.where((F.col("chars") <= max_chars) | (F.col("nth") == 1))
    return kept.select("scope", "pos", "source", F.substring("text", 1, max_chars).alias("text"))


def snapshot(entries: DataFrame, strategy: str = "recent", max_items: int = 20, max_chars: int = 4000) -> DataFrame:
    """scope, items, body: one text for each scope, oldest first."""
    chosen = recent_entries(latest_by_source(entries) if strategy == "dedup" else entries, max_items, max_chars)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("- "), "source", F.lit(": "), "text").alias("line")))), lambda x: x["line"])
    return chosen.groupBy("scope").agg(F.count("*").alias("items"), F.array_join(lines, "\n").alias("body"))


def next_state(s: Column, ok: Column, stable_at: int, unstable_at: int) -> Column:
    """Procedure state after a run: raw -> tested -> stable, and back."""
    good, bad = s["good"] + ok.cast("long"), s["bad"] + (~ok).cast("long")
    up = F.when(s["status"] == "raw", "tested").when((s["status"] == "tested") & (good >= stable_at) & (bad == 0), "stable").otherwise(s["status"])
    down = F.when((s["status"] == "stable") & (bad >= unstable_at), "tested").when((s["status"] == "tested") & (bad > good), "raw").otherwise(s["status"])
    return F.struct(F.when(ok, up).otherwise(down).alias("status"), good.alias("good"), bad.alias("bad"))


def procedure_states(runs: DataFrame, stable_at: int = 5, unstable_at: int = 2) -> DataFrame:
    """slug, status, success_count, fail_count after all runs(slug, seq, ok) in order of seq.

    What a run does depends on the counts up to it, which windows give, and on the status before. Each run is thus a map of
    the three statuses; maps of runs in a row are composed, first inside blocks of seq and then over the blocks, so that no
    task folds all runs of a procedure at once.
    """
    numbered_ = runs.withColumn("_block", F.floor(F.col("seq") / RUN_BLOCK))
    sizes = numbered_.groupBy("slug", "_block").agg(F.count_if("ok").alias("g"), F.count_if(~F.col("ok")).alias("b"))
    upto = Window.partitionBy("slug").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("slug", "_block", F.coalesce(F.sum("g").over(upto), F.lit(0)).alias("g"), F.coalesce(F.sum("b").over(upto), F.lit(0)).alias("b"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("seq", "ok"))), lambda x: x["ok"])
    blocks = numbered_.groupBy("slug", "_block").agg(order.alias("runs")).join(sizes, ["slug", "_block"])

    def after(status):
        start = F.struct(F.lit(status).alias("status"), F.col("g").cast("long").alias("good"), F.col("b").cast("long").alias("bad"))
        return F.aggregate("runs", start, lambda s, ok: next_state(s, ok, stable_at, unstable_at))["status"]

    maps = blocks.select("slug", "_block", *(after(x).alias(x) for x in STATUSES), F.size(F.filter("runs", lambda x: x)).cast("long").alias("good"), F.size(F.filter("runs", lambda x: ~x)).cast("long").alias("bad"))
    rows = F.array_sort(F.collect_list(F.struct("_block", *STATUSES)))
    last = F.aggregate(rows, F.lit(STATUSES[0]), lambda s, m: F.when(s == STATUSES[0], m[STATUSES[0]]).when(s == STATUSES[1], m[STATUSES[1]]).otherwise(m[STATUSES[2]]))
    return maps.groupBy("slug").agg(last.alias("status"), F.sum("good").alias("success_count"), F.sum("bad").alias("fail_count"))


def new_procedure(slug: Column, title: Column) -> Column:
    """The fields of a procedure that is created: raw, without runs."""
    return F.struct(F.lit("procedure").alias("type"), slug.alias("slug"), title.alias("title"), F.lit(STATUSES[0]).alias("status"), F.lit(0).alias("success_count"), F.lit(0).alias("fail_count"))


def run_events(runs: DataFrame) -> DataFrame:
    """Ledger rows of runs(id, timestamp, slug, ok, note): the metadata that recent_runs reads."""
    result = F.when(F.col("ok"), "success").otherwise("failure")
    meta = F.create_map(F.lit("operation"), F.lit("run"), F.lit("procedure"), F.col("slug"), F.lit("result"), result)
    return runs.select("id", "timestamp", F.lit("page_edited").alias("kind"), F.col("note").alias("raw_payload"), F.array(F.col("slug")).alias("affected_pages"), meta.alias("metadata"))


def numbered(rows: DataFrame, existing: DataFrame, by: str = "date", order: str = "key") -> DataFrame:
    """seq of new rows within each date, after the largest existing one."""
    top = existing.groupBy(by).agg(F.max("seq").alias("_top"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_nth", nth).join(top, by, "left").withColumn("seq", F.coalesce("_top", F.lit(0)) + F.col("_nth")).drop("_nth", "_top")


def unique_names(rows: DataFrame, existing: DataFrame, name: str = "name", order: str = "key") -> DataFrame:
    """unique_name: `x`, `x_1`, `x_2` ... after the names of that base that exist."""
    base = lambda c: F.regexp_replace(c, r"_\d+$", "")
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("old", r"_(\d+)$", 1), F.lit("")), F.lit("9999999999")).cast("long"), F.lit(0))
    top = existing.select(F.col(name).alias("old")).select(base(F.col("old")).alias(name), number.alias("n")).groupBy(name).agg((F.max("n") + 1).alias("_next"))
    nth = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    k = nth + F.coalesce(F.col("_next"), F.lit(0))
    return rows.join(top, name, "left").withColumn("_k", k).withColumn("unique_name", F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat(name, F.lit("_"), F.col("_k").cast("string")))).drop("_next", "_k")


def pending_by_kind(reviews: DataFrame) -> DataFrame:
    """kind, pending of undecided reviews; kinds that are no name count as unknown."""
    kind = F.when(F.coalesce(F.col("kind").rlike("^[a-z][a-z_]*$"), F.lit(False)), F.col("kind")).otherwise("unknown")
    return reviews.where("status = 'pending'").groupBy(kind.alias("kind")).agg(F.count("*").alias("pending"))


def review_outcomes(reviews: DataFrame) -> DataFrame:
    """applied, approved, rejected, deferred, quarantined, skipped of a batch."""
    bad = F.size("errors") > 0
    n = lambda c: F.count_if(c)
    return reviews.where("status = 'pending'").agg(
        n(~bad & F.col("action").isin("approve", "reject")).alias("applied"), n(~bad & (F.col("action") == "approve")).alias("approved"), n(~bad & (F.col("action") == "reject")).alias("rejected"),
        n(~bad & (F.col("action") == "defer")).alias("deferred"), n(bad & (F.col("action") == "none")).alias("quarantined"), n(~bad & (F.col("action") == "none")).alias("skipped"),
    )


#: Kinds of reviews that can be approved, with the fields of their payload.
FACT_PAYLOAD = "subject string, predicate string, object string, object_type string, valid_from string, confidence double, replaces bigint"
PAYLOADS = {
    "fact_conflict": FACT_PAYLOAD,
    "low_confidence": FACT_PAYLOAD,
    "pending_fact": FACT_PAYLOAD,
    "new_entity": "entity_id string, name string, type string",
    "procedure_candidate": "suggested_slug string, title string, summary string, steps array<string>",
    "tier_proposal": "entity_id string, proposed_tier int",
    "summary": "page_slug string, summary string",
}


def apply_reviews(reviews: DataFrame, facts: DataFrame) -> dict[str, DataFrame]:
    """What decided reviews change: facts (new, with ids), superseded, entities, procedures, tiers, summaries, decided, deferred.

    reviews: review_id, kind, status, action, payload, errors; payloads as in PAYLOADS. A name without an entity_id gets
    its slug. Reviews of other kinds can be rejected or put off, not approved.
    """
    ready = reviews.where((F.col("status") == "pending") & (F.size("errors") == 0))
    approved = ready.where(F.col("action") == "approve")

    def of(*kinds):
        rows = approved.where(F.col("kind").isin(*kinds))
        return rows.select("review_id", F.from_json("payload", PAYLOADS[kinds[0]]).alias("f")).select("review_id", "f.*")

    start = facts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("start"))
    added = counted(of("fact_conflict", "low_confidence", "pending_fact"), "review_id").join(F.broadcast(start)).withColumn("id", F.col("start") + F.col("nth")).drop("start", "nth")
    closed = added.where("replaces is not null").select(F.col("replaces").alias("old_id"), F.col("id").alias("new_id"), F.col("valid_from").alias("valid_to"))
    steps = F.coalesce("steps", F.array().cast("array<string>"))
    decided = ready.where((F.col("action") == "reject") | ((F.col("action") == "approve") & F.col("kind").isin(*PAYLOADS)))
    return {
        "facts": added.drop("replaces"),
        "superseded": closed,
        "entities": of("new_entity").select(F.coalesce("entity_id", T.slug(F.col("name"))).alias("id"), "type", F.col("name").alias("title")).where("id is not null").dropDuplicates(["id"]),
        "procedures": of("procedure_candidate").select(F.coalesce("suggested_slug", T.slug(F.col("title"))).alias("slug"), "title", T.numbered_steps(F.coalesce("summary", F.lit("")), steps).alias("text")),
        "tiers": of("tier_proposal").select("review_id", "entity_id", "proposed_tier"),
        "summaries": of("summary").select("page_slug", "summary"),
        "decided": decided.select("review_id", F.col("action").alias("status")),
        "deferred": ready.where("action = 'defer'").select("review_id"),
    }


def recall_probe(prompts: DataFrame, max_chars: int = 96) -> DataFrame:
    """prompt_id, reasons, query of prompts that call for recall."""
    out = prompts.select("prompt_id", T.recall_reasons(F.col("prompt")).alias("reasons"), T.minimal_query(F.col("prompt"), max_chars).alias("query"))
    return out.where((F.size("reasons") > 0) & F.col("query").isNotNull())
