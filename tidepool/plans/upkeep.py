"""Queries over the registry, reviews, imports, the index and ingest, with content compared and not counts alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators import assemble, chunks, facts, importing, ingest, links, maintain, registry, retrieval
from tidepool.plans.building import _chunks, _DIFF, _index
from tidepool.plans.catalog import query
from tidepool.plans.retrieving import _corpus, _KEYWORD
from tidepool.plans.views import DIMENSION, Tables

_NONE = "array<string>"


def _named(prefix: str, column) -> F.Column:
    return F.concat(F.lit(prefix), column.cast("string"))


# --- selections and orders --------------------------------------------------------------------------------------------


@query("select id, subject, norm_pred from kb_facts where superseded_by is null and valid_to is null and norm_pred = 'role' and subject like '%7'")
def found_active(t: Tables) -> DataFrame:
    """Active facts of (subject, predicate) pairs in any spelling."""
    wanted = t.table("customer").where("c_custkey % 10 = 7").select(_named("customer-", F.col("c_custkey")).alias("subject"), F.lit("Has Role").alias("predicate"))
    return facts.find_active(t.facts(), wanted).select("id", "subject", "norm_pred")


@query(f"with {_KEYWORD} select * from (select query_id, page_slug, round(score * weight, 6) as score, row_number() over (partition by query_id order by round(score * weight, 9) desc, page_slug) as rank from k join w using (page_slug) where doc_id % 7 = 1) where rank <= 3")
def typed_ask(t: Tables) -> DataFrame:
    """Questions over the pages of one type."""
    return retrieval.ask(t.pages(plain=True), t.questions(), top=3, page_type="project").select("query_id", "page_slug", F.round("score", 6).alias("score"), "rank")


@query(f"with {_KEYWORD} select query_id, page_slug, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, 'pages/' || list_extract(['entity','project','concept','event','experience','conversation','procedure'], (doc_id % 7 + 1)::int) || '/' || page_slug || '.md') as rank from k join w using (page_slug)) where rank <= 5")
def keyword_order(t: Tables) -> DataFrame:
    """Keyword scores before page weights: by score, then by the page's path."""
    return retrieval.keyword_ranked(retrieval.keyword_scores(_corpus(t), t.questions()), t.pages(), 5).withColumn("score", F.round("score", 6))


@query("select event_id as review_id, event_type as kind, 'pending' as status from events where event_type = 'click' and event_id % 4 <> 0")
def pending_of_kind(t: Tables) -> DataFrame:
    rows = t.table("events").select(F.col("event_id").alias("review_id"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 4 == 0, "done").otherwise("pending").alias("status"), "props")
    return registry.review_headers(registry.pending_reviews(rows, "click"))


@query("select page_slug, status from kb_pages where page_type = 'procedure' and status = 'tested' order by page_slug limit 20")
def tested_procedures(t: Tables) -> DataFrame:
    return registry.procedures(t.pages(), "tested").select("page_slug", "status")


@query("select id, kind from kb_ledger where kind = 'ai_chat' and (page_slug = 'user-3' or event_id % 10 = 0) order by id desc limit 10")
def entity_events(t: Tables) -> DataFrame:
    """Newest events of a kind that touch an entity, by page or in their metadata."""
    meta = F.when(F.col("event_id") % 10 == 0, F.create_map(F.lit("slug"), F.lit("user-3"))).otherwise(F.create_map(F.lit("other"), F.lit("user-3")))
    ledger = t.ledger().withColumn("affected_pages", F.array("page_slug")).withColumn("metadata", meta)
    return registry.recent_events(ledger, 10, "ai_chat", "user-3").select("id", "kind")


@query("select id, strftime(ts, '%Y-%m-%d') || ' p' || e.user_id || ' ' || case when e.event_type = 'error' then 'failure' else 'success' end || ': note' as line from kb_ledger join events e using (event_id) where e.event_id % 3 = 0 order by id desc limit 5")
def procedure_last_runs(t: Tables) -> DataFrame:
    """The newest five procedure runs of the ledger."""
    k = F.col("event_id")
    e = t.table("events").select(F.lpad(k.cast("string"), 26, "0").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), _named("p", F.col("user_id")).alias("slug"), (F.col("event_type") != "error").alias("ok"), F.lit(" note ").alias("note"), k)
    runs = assemble.run_events(e.where(k % 3 == 0)).unionByName(assemble.run_events(e.where(k % 3 == 1)).withColumn("metadata", F.create_map(F.lit("operation"), F.lit("create"))))
    return registry.recent_runs(runs)


@query("select from_page, relation, line_number from kb_backlinks where to_entity = 'part-7' order by 1, 2")
def links_to_one(t: Tables) -> DataFrame:
    return links.backlinks_to(t.backlinks(), "part-7").select("from_page", "relation", "line_number")


@query("select file_path, status from kb_files where job_id = (select min(source) from documents where text is not null) and status in ('failed', 'pending') order by 1")
def job_listing(t: Tables) -> DataFrame:
    """A job's open and failed files by path."""
    f = t.files()
    log = f.select("job_id", "file_path", F.col("doc_id").alias("seq"), "status", F.lit(None).cast("string").alias("error"))
    return importing.job_files(log, f.agg(F.min("job_id")).first()[0], ["failed", "pending"]).select("file_path", "status")


@query("select source, key, text from (select 0 as prio, 'inbox' as source, 'in/' || lpad(doc_id::varchar, 9, '0') as key, sha256(text) as text from documents where text is not null union all select 1, 'events', id, sha256(e.props) from kb_ledger join events e using (event_id) where kind <> 'odd') order by prio, key limit 100")
def work_items(t: Tables) -> DataFrame:
    """The first hundred items to work on: inbox files before events."""
    inbox = t.table("documents").where("text is not null").select(F.concat(F.lit("in/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), "text")
    events = t.ledger().where("kind <> 'odd'").select("id", F.col("props").alias("raw_payload"))
    return ingest.collected(inbox, events, 100).withColumn("text", F.sha2("text", 256))


@query("select source, count(*) as items from (select 'inbox' as source from documents where text is not null union all select 'events' from kb_ledger where kind <> 'odd') group by 1")
def dry_ingest(t: Tables) -> DataFrame:
    """What an ingest run would work on."""
    events = t.ledger().where("kind <> 'odd'").select("id", F.col("props").alias("raw_payload"))
    inbox = t.table("documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), "text")
    return ingest.dry_counts(ingest.collected(inbox, events))


@query("select doc_id, status from kb_files where doc_id % 6 = 1")
def broken_reviews(t: Tables) -> DataFrame:
    """Pending, undecided reviews with broken content."""
    k = F.col("doc_id")
    rows = t.files().select("doc_id", F.col("status").alias("label"), F.when(k % 2 == 1, "pending").otherwise("done").alias("status"), F.lit("none").alias("action"), F.when(k % 3 == 1, F.array(F.lit("payload"))).otherwise(F.array().cast(_NONE)).alias("errors"))
    return registry.invalid_reviews(rows).select("doc_id", F.col("label").alias("status"))


@query("select vec_id from embeddings where vec_id % 9 = 0")
def odd_vectors(t: Tables) -> DataFrame:
    """Vectors whose length is not the model's."""
    v = t.table("embeddings").select("vec_id", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 7)).otherwise(F.col("embedding")).alias("embedding"), F.size("embedding").alias("n"))
    return chunks.wrong_dimension(v, v.agg(F.max("n")).first()[0]).select("vec_id")


@query("select source as page_slug, count(*) as pages from documents group by 1 having count(*) > 1")
def shared_slugs(t: Tables) -> DataFrame:
    """Slugs that several pages have."""
    return registry.unique_slugs(t.table("documents").select(F.col("source").alias("page_slug")))[1]


@query("""select 'pending' as kind, count(*) filter (doc_id % 3 = 1) as n, null as path from documents union all select 'failed', count(*) filter (doc_id % 3 = 2), null from documents
 union all select 'next', null, path from (select 'failed/' || lpad(doc_id::varchar, 9, '0') as path from documents where doc_id % 3 = 2 order by 1 limit 20)""")
def inbox_totals(t: Tables) -> DataFrame:
    """Pending and failed files of the inbox, and the first twenty that failed, by path."""
    k = F.col("doc_id")
    files = t.table("documents").select(F.concat(F.when(k % 3 == 0, "processed/").when(k % 3 == 1, "").otherwise("failed/"), F.lpad(k.cast("string"), 9, "0")).alias("path"))
    counts = registry.inbox_counts(files).select(F.stack(F.lit(2), F.lit("pending"), F.col("pending"), F.lit("failed"), F.col("failed")).alias("kind", "n")).withColumn("path", F.lit(None).cast("string"))
    return counts.unionByName(registry.failed_inbox(files, 20).select(F.lit("next").alias("kind"), F.lit(None).cast("long").alias("n"), "path"))


def _flaky(text: str) -> str:
    n = len(text) % 50
    if n == 7:
        raise TimeoutError("no answer")
    if n == 9:
        raise ValueError("no signal") from UnicodeError("bad text")
    return "no JSON" if n == 11 else '{"timeline_summary": "' + str(n) + '"}'


@query("""select doc_id as item_id, case length(text) % 50 when 7 then 'transient' when 9 then 'content' when 11 then 'content' else 'signal' end as outcome, case when length(text) % 50 = 7 then 3 end as attempts,
 case when length(text) % 50 not in (7, 9, 11) then (length(text) % 50)::varchar end as said from documents where text is not null""")
def extraction_outcomes(t: Tables) -> DataFrame:
    """Every text's signal, or how its extraction failed: timeouts are tried three times, and none stops the others."""
    texts = t.table("documents").where("text is not null").select(F.col("doc_id").alias("item_id"), F.lit(0).alias("part"), "text")
    signals, failures = ingest.extract_all(texts, _flaky)
    failed = failures.select("item_id", F.col("kind").alias("outcome"), F.when(F.col("attempts") > 1, F.col("attempts")).alias("attempts"), F.lit(None).cast("string").alias("said"))
    return failed.unionByName(signals.select("item_id", F.lit("signal").alias("outcome"), F.lit(None).cast("int").alias("attempts"), F.col("signal.timeline_summary").alias("said")))


# --- registry and facts -----------------------------------------------------------------------------------------------


@query("""select f.id, case when s.page is not null then s.page when f.object_type = 'entity' and o.page is not null then o.page else f.subject end as page_slug from
 (select c_custkey as id, case when c_custkey % 4 = 0 then 'CUSTOMER-' || c_custkey when c_custkey % 4 = 1 then upper(c_name) when c_custkey % 4 = 2 then 'Alias of ' || c_custkey else 'nobody' end as subject, case when c_custkey % 3 = 0 then 'literal' else 'entity' end as object_type, 'nation-' || c_nationkey as object from customer) f
 left join (select 'CUSTOMER-' || c_custkey as name, 'file-' || c_custkey as page from customer where false union all select upper(c_name), min('file-' || c_custkey) from customer group by 1 union all select 'Alias of ' || c_custkey, 'file-' || c_custkey from customer) s on s.name = f.subject left join (select 'nation-' || n_nationkey as name, 'nation-' || n_nationkey as page from nation) o on o.name = f.object""")
def canonical_fact_pages(t: Tables) -> DataFrame:
    """The page of a fact: by its subject's title or alias in any case, else by its object, else the subject as it is."""
    k = F.col("c_custkey")
    c = t.table("customer")
    subject = F.when(k % 4 == 0, _named("CUSTOMER-", k)).when(k % 4 == 1, F.upper("c_name")).when(k % 4 == 2, _named("Alias of ", k)).otherwise("nobody")
    f = c.select(k.alias("id"), subject.alias("subject"), F.when(k % 3 == 0, "literal").otherwise("entity").alias("object_type"), _named("nation-", F.col("c_nationkey")).alias("object"))
    e = c.select(_named("c/", k).alias("id"), F.col("c_name").alias("title"), F.concat(F.lit("pages/entity/file-"), k.cast("string"), F.lit(".md")).alias("page_path"))
    e = e.unionByName(t.table("nation").select(_named("nation-", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("title"), F.lit(None).cast("string").alias("page_path")))
    return retrieval.canonical_pages(f, e, c.select(_named("ALIAS of ", k).alias("alias"), _named("c/", k).alias("entity_id"))).select("id", "page_slug")


_HINTS = """s as (select alias as name, entity_id, 0 as a, alias as b, 0 as c from kb_aliases union all select title, id, 1, id, 0 from kb_entities where type in ('place', 'org') union all select id, id, 1, id, 1 from kb_entities where type in ('place', 'org')),
 o as (select name, entity_id, row_number() over (order by a, b, c, entity_id) as nth from (select *, row_number() over (partition by name order by a, b, c, entity_id) as k from s) where k = 1 and length(name) >= 2 and entity_id not like '%3'),
 f as (select 'doc-' || doc_id as page_slug, entity_id, min(nth) as nth from (select doc_id, replace(lower(text), 'ß', 'ss') as folded from documents where text is not null) d join o on contains(folded, lower(name)) group by 1, 2)"""


def _hints(t: Tables, n: int) -> DataFrame:
    named = t.entities().where("type in ('place', 'org')").select("id", "title")
    aliases = t.aliases().select("alias", "entity_id")
    shareable = named.select("id").unionByName(aliases.select(F.col("entity_id").alias("id"))).where("id not like '%3'")
    return registry.entity_hints(_corpus(t), named, aliases, shareable, n)


@query(f"with {_HINTS} select page_slug, count(*) as hints from f group by 1")
def hint_counts(t: Tables) -> DataFrame:
    """How many known and shareable entities each text names."""
    return _hints(t, 1 << 30).select("page_slug", F.size("hints").cast("long").alias("hints"))


@query(f"with {_HINTS} select page_slug, string_agg(entity_id, ' ' order by k) as hints from (select *, row_number() over (partition by page_slug order by nth) as k from f) where k <= 30 group by 1")
def entity_hints(t: Tables) -> DataFrame:
    """The first thirty entities that each text names, in the order of their names."""
    return _hints(t, 30).select("page_slug", F.array_join("hints", " ").alias("hints"))


@query("select event_id as id, 'customer-' || (user_id + 1) as subject, case when event_id % 2 = 0 then 'nation-' || event_id % 30 else 'text' end as object from events join (select c_custkey from customer) on c_custkey = user_id + 1 where event_id % 2 = 1 or event_id % 30 < 25")
def resolved_pending(t: Tables) -> DataFrame:
    """Pending facts both of whose ends have an entity by now."""
    k = F.col("event_id")
    p = t.table("events").select(k.alias("id"), F.concat(F.lit("Customer#"), F.lpad((F.col("user_id") + 1).cast("string"), 9, "0")).alias("subject"), F.when(k % 2 == 0, _named("nation-", k % 30)).otherwise("text").alias("object"), F.when(k % 2 == 0, "entity").otherwise("literal").alias("object_type"))
    return registry.resolved_pending(p, t.entities(), t.aliases()).select("id", "subject", "object")


@query("select doc_id as id, case when doc_id % 4 = 0 then 'same' else 'p-' || doc_id end as suggested_slug from documents where doc_id % 100 >= 80 and doc_id % 4 <> 0 and doc_id % 5 <> 0 and doc_id % 3 <> 0")
def fresh_procedures(t: Tables) -> DataFrame:
    """Procedure candidates that no page or review has by slug or title."""
    k = F.col("doc_id")
    d = t.table("documents")
    c = d.select(k.alias("id"), F.when(k % 4 == 0, "same").otherwise(_named("p-", k)).alias("suggested_slug"), F.when(k % 5 == 0, _named("  KNOWN ", k)).otherwise(_named("new ", k)).alias("title"), (k % 100 / 100.0).alias("confidence"))
    pages = d.where(k % 5 == 0).select(F.lit("same").alias("slug"), _named("known ", k).alias("title"))
    pending = d.where(k % 3 == 0).select(_named("p-", k).alias("slug"), F.lit("x").alias("title"))
    return ingest.new_procedures(c, pages, pending).select("id", "suggested_slug")


@query("select id as source_event, case when event_type = 'click' then 'talk-' || event_id else 'chat-' || event_id end as page_slug from kb_ledger where kind in ('ai_chat', 'human_chat') and event_id % 3 <> 0")
def promoted_chats(t: Tables) -> DataFrame:
    """Chats that no page came from yet, each with a slug of its own."""
    title = F.concat(F.when(F.col("event_type") == "click", "Talk ").otherwise("chat, "), F.col("event_id").cast("string"))
    ledger = t.ledger().withColumn("title", title).withColumn("raw_payload", F.col("props"))
    pages = ledger.where("event_id % 3 = 0").select(F.lit("old").alias("page_slug"), F.col("id").alias("source_event"))
    return ingest.promoted_chats(ledger, pages).select("source_event", "page_slug")


@query("select doc_id, sha256('doc' || doc_id || chr(0) || sha256(text)) as key from (select min(doc_id) as doc_id, text from documents where text is not null and doc_id % 3 <> 0 group by text, doc_id)")
def not_done_items(t: Tables) -> DataFrame:
    """Items whose operation no run has committed."""
    d = t.table("documents").where("text is not null").select("doc_id", _named("doc", F.col("doc_id")).alias("origin"), "text")
    done = d.where("doc_id % 3 = 0").select(ingest.operation_key(F.col("origin"), F.col("text")).alias("key"))
    return ingest.not_done(d, done).select("doc_id", "key")


@query("select 'r' || o_orderkey as review_id, case when o_orderkey % 3 = 0 then o_orderkey else m end as proposal_id from orders left join (select o_custkey, max(o_orderkey) as m from orders where o_orderstatus = 'P' group by 1) using (o_custkey)")
def proposal_refs(t: Tables) -> DataFrame:
    """The proposal of a decision: by review, else the latest open one of the same entity and tier."""
    o, n = t.table("orders"), F.col("o_orderkey")
    p = o.select(n.alias("id"), F.when(n % 3 == 0, _named("r", n)).alias("review_file"), F.col("o_custkey").alias("entity_id"), F.lit(2).alias("proposed_tier"), F.when(F.col("o_orderstatus") != "P", "approved").alias("decision"))
    d = o.select(_named("r", n).alias("review_id"), F.col("o_custkey").alias("entity_id"), F.lit(2).alias("proposed_tier"))
    return registry.proposal_of(d, p)


@query("select o_orderkey as id, case when o_orderkey % 4 = 0 then 'approved' end as decision, case when o_orderkey % 4 = 0 then '2024-01-01' end as decided_at from orders")
def decided_tiers(t: Tables) -> DataFrame:
    o, n = t.table("orders"), F.col("o_orderkey")
    none = F.lit(None).cast("string")
    done = o.where(n % 4 == 0).select(n.alias("proposal_id"), F.lit("approved").alias("decision"), F.lit("2024-01-01").alias("decided_at"))
    return registry.decided_proposals(o.select(n.alias("id"), none.alias("decision"), none.alias("decided_at")), done)


@query("select event_type || ' x' as alias, count(distinct user_id) as owners from events group by 1 having count(distinct user_id) > 1")
def alias_owners(t: Tables) -> DataFrame:
    """Aliases that more than one entity claims, in a batch against the table."""
    a = t.table("events").select(F.concat("event_type", F.lit(" x")).alias("alias"), _named("u", F.col("user_id")).alias("entity_id")).distinct()
    return facts.add_aliases(a.where("entity_id = 'u1'"), a)[1].select("alias", F.size("owners").cast("long").alias("owners"))


@query("select id, mention_count + coalesce(n, 0) as mention_count from kb_entities left join (select 'customer-' || o_custkey as id, count(*) as n from orders group by 1) using (id)")
def mention_totals(t: Tables) -> DataFrame:
    m = t.table("orders").groupBy(_named("customer-", F.col("o_custkey")).alias("entity_id")).agg(F.count("*").alias("mentions"))
    return registry.mentions_added(t.entities(), m).select("id", "mention_count")


@query("select 'tokens' as key, round(sum(value), 4) as value from events where event_id > (select max(event_id) from events where event_id % 1000 = 0) union all select 'usd', round(sum(value), 4) from events")
def stat_values(t: Tables) -> DataFrame:
    """Counters of an append-only log: the last value set and what was added after it."""
    e = t.table("events")
    log = e.select(F.lit("tokens").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 1000 == 0, "set").otherwise("add").alias("op"), F.when(F.col("event_id") % 1000 == 0, 0.0).otherwise(F.col("value").cast("double")).alias("value"))
    log = log.unionByName(e.select(F.lit("usd").alias("key"), F.col("event_id").alias("seq"), F.lit("add").alias("op"), F.col("value").cast("double").alias("value")))
    return registry.stats(log).withColumn("value", F.round("value", 4))


@query("select 5.0 as tokens, 0.5 as usd, count(*) filter (o_orderstatus in ('F', 'P')) as active_jobs, strftime(max(o_orderdate), '%Y-%m-%d') as last_ingest_at from orders")
def usage_row(t: Tables) -> DataFrame:
    o = t.table("orders")
    jobs = o.select(F.when(F.col("o_orderstatus") == "F", "running").when(F.col("o_orderstatus") == "P", "paused").otherwise("completed").alias("status"))
    stats = t.spark.createDataFrame([("tokens", 5.0), ("usd", 0.5)], "key string, value double")
    return registry.usage(stats, jobs, o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("at")))


@query("""select subject || coalesce(nullif('', ''), '') as page_slug, array_to_string(list_distinct_sorted, ',') as sources from (select 'user-' || (user_id - user_id % 4) as subject, list_sort(list(distinct 's' || event_id % 7)) as list_distinct_sorted from events group by 1)""")
def merged_lists(t: Tables) -> DataFrame:
    """Sources of merged pages, each once."""
    n = F.col("user_id")
    own = t.table("events").groupBy(_named("user-", n).alias("page_slug"), n).agg(F.array_sort(F.collect_set(_named("s", F.col("event_id") % 7))).alias("sources"))
    pages = own.withColumn("aliases", F.array("page_slug")).withColumn("tags", F.lit(None).cast(_NONE))
    pairs = own.where(n % 4 != 0).select(F.col("page_slug").alias("loser"), _named("user-", n - n % 4).alias("canonical"))
    return maintain.merge_sources(pages, pairs).select("page_slug", F.array_join(F.array_sort("sources"), ",").alias("sources"))


@query("select id from kb_facts where id % 100 = 7 or (object_type = 'entity' and object like '%3')")
def chosen_facts(t: Tables) -> DataFrame:
    """Facts asked for and facts whose object is gone, each once."""
    return maintain.chosen_facts(t.facts(), t.facts().where("id % 100 = 7"), t.entities().where("id not like '%3'")).select("id")


@query("""with p as (select 'customer-' || c_custkey as id, case when c_custkey % 10 = 1 then 'new ' || c_name else c_name end as title, 1 + c_custkey % 3 as tier, c_custkey % 8 = 0 as leak, c_custkey % 6 = 0 as stub from customer where c_custkey % 5 <> 0)
 select 'registry' as metric, (select count(*) from p where id like '%1') + (select count(*) from customer where c_custkey % 5 = 0) as value union all select 'leaks', count(*) from p where leak and not stub union all select 'stubs', count(*) from p where stub
 union all select 'missing_pages', count(*) from customer where c_custkey % 5 = 0 union all select 'collisions', 0 union all select 'aliases', count(*) from p union all select 'sources', 2 union all select 'predicates', (select count(distinct predicate) from kb_facts where predicate <> norm_pred)""")
def reconcile_counts(t: Tables) -> DataFrame:
    """What a reconcile plan would change, counted."""
    pages, e, aliases, missing, archived = _reconciled(t)
    return maintain.plan_counts(**maintain.reconcile_plan(pages, e, t.facts(), aliases, missing, archived))


def _reconciled(t: Tables):
    k = F.col("c_custkey")
    c = t.table("customer").select(k, _named("customer-", k).alias("page_slug"), F.when(k % 10 == 1, F.concat(F.lit("new "), "c_name")).otherwise(F.col("c_name")).alias("title"), (1 + k % 3).cast("int").alias("tier"))
    text = F.when(k % 6 == 0, T.STUB).when(k % 8 == 0, "x\nsource_agent: y").otherwise("x")
    pages = c.where(k % 5 != 0).select("page_slug", "title", "tier", text.alias("text"), F.array(_named("the ", k)).alias("aliases"))
    e = t.entities().where("id like 'customer-%'").select("id", "type", "title", "tier", "mention_count")
    aliases = t.spark.createDataFrame([], "alias string, entity_id string")
    missing = t.spark.createDataFrame([("a_1.md",), ("b.md",)], "path string")
    return pages, e, aliases, missing, t.spark.createDataFrame([("a.md",)], "path string")


@query("select 'customer-' || c_custkey as id, case when c_custkey % 10 = 1 then 'new ' || c_name else c_name end as title, case when c_custkey % 5 <> 0 then 'the ' || c_custkey end as alias from customer")
def reconciled(t: Tables) -> DataFrame:
    """The registry after a reconcile run: titles as the pages say, and their aliases."""
    pages, e, aliases, missing, archived = _reconciled(t)
    out = maintain.apply_reconcile(maintain.reconcile_plan(pages, e, t.facts(), aliases, missing, archived), pages, e, t.facts(), aliases)
    return out["entities"].join(out["aliases"].withColumnRenamed("entity_id", "id"), "id", "left").select("id", "title", "alias")


@query("select id, case when id like '%9' then 0 else mention_count end as mention_count from kb_entities where type = 'person'")
def rebuilt_registry(t: Tables) -> DataFrame:
    """Registry rows from pages; counts of known rows stay."""
    e = t.entities().where("type = 'person'").withColumn("first_seen", F.lit("2020")).withColumn("last_seen", F.lit("2021"))
    pages = e.select(F.col("id").alias("page_slug"), F.lit("entity").alias("page_type"), "type", "title", "tier", F.lit("2022").alias("created"), F.col("id").alias("relative_path"), F.lit("x").alias("text"))
    return maintain.rebuilt(pages, e.where("id not like '%9'"), t.aliases())["entities"].select("id", "mention_count")


@query("select 'registry' as kind, count(*) as issues from (select 1 from kb_entities where id like '%9' and tier <> 1 or id like '%2' or id like '%4')")
def registry_lint(t: Tables) -> DataFrame:
    """The fifth lint check: registry rows that differ from their pages."""
    e = t.entities().select("id", "title", "tier")
    pages = e.where("id not like '%2'").withColumn("tier", F.when(F.col("id").endswith("9"), 1).otherwise(F.col("tier")))
    none = t.timeline().limit(0)
    out = maintain.lint(t.user_pages().limit(0), none, e.where("id not like '%4'"), t.facts().limit(0), "2024-02-09", page_entities=pages)
    return out.groupBy("kind").agg(F.count("*").alias("issues"))


@query("select doc_id, case when doc_id % 3 = 0 then 'new ' || doc_id else text end as text from (select doc_id, case when doc_id % 2 = 0 then '(stub - waiting for more evidence)' else 'own words' end as text from documents where doc_id % 7 <> 0) where not (doc_id % 3 = 0 and doc_id % 2 = 1) union all select doc_id, 'own words' from documents where doc_id % 7 <> 0 and doc_id % 3 = 0 and doc_id % 2 = 1")
def refreshed_summaries(t: Tables) -> DataFrame:
    """New summaries replace stubs, never what a person wrote."""
    k = F.col("doc_id")
    pages = t.table("documents").where(k % 7 != 0).select(k, _named("d", k).alias("page_slug"), F.lit(False).alias("curated"), F.when(k % 2 == 0, T.STUB).otherwise("own words").alias("text"), F.lit(None).cast("string").alias("summary_hash"))
    return maintain.refreshed(pages, pages.where(k % 3 == 0).select("page_slug", _named("new ", k).alias("summary"))).select("doc_id", "text")


@query("""with f as (select subject, f.id, asserted_at, norm_pred, case when norm_pred in ('role', 'works_as') then 0 when norm_pred = 'status' then 1 else 2 end as g, object, case when object_type = 'entity' then e.title end as title from kb_facts f left join kb_entities e on e.id = f.object where superseded_by is null and valid_to is null),
 h as (select subject, g, case norm_pred when 'status' then object when 'role' then '角色为 ' || object else '所在地为 ' || coalesce(title, object) end as phrase, max(asserted_at || lpad(id::varchar, 12, '0')) as newest from f group by 1, 2, 3), n as (select *, row_number() over (partition by subject, g order by newest desc) as nth from h),
 l as (select subject, g, string_agg(phrase, '；' order by nth) as text from n where nth <= 3 group by 1, 2), b as (select subject, string_agg(case g when 0 then '方向与决策' when 1 then '进展' else '实现与运行' end || '：' || text || '。', chr(10) || chr(10) order by g) as body from l group by 1)
 select subject, sha256(body) as body from b""")
def chinese_summaries(t: Tables) -> DataFrame:
    """Summaries in Chinese, without the sentence on what is left out."""
    out = facts.summary_paragraphs(t.facts(), t.entities().select("id", "title"), language="zh")
    return out.select("subject", F.sha2(F.regexp_replace("summary", "\n\n另有 [0-9]+ 条事实[^\n]*$", ""), 256).alias("body"))


@query("select page_slug, string_agg(description, chr(10) order by pos desc) as summary from (select *, row_number() over (partition by page_slug order by pos desc) as n from (select page_slug, description, max(pos) as pos from kb_timeline group by 1, 2)) where n <= 5 group by 1")
def said_lately(t: Tables) -> DataFrame:
    """The last five texts of a timeline, for pages without facts."""
    return facts.recent_said(t.timeline())


# --- reviews, imports, index, ingest ----------------------------------------------------------------------------------


_APPLIED = "r as (select event_id, list_extract(['fact_conflict','low_confidence','pending_fact','new_entity','procedure_candidate','tier_proposal','summary','ingest_error'], (event_id % 8 + 1)::int) as kind, list_extract(['approve','reject','defer','none'], (event_id % 7 % 4 + 1)::int) as action from events where event_id % 13 <> 0)"


def _decided(t: Tables) -> dict[str, DataFrame]:
    k = F.col("event_id")
    kinds = [*assemble.PAYLOADS, "ingest_error"]
    s = k.cast("string")
    fact = F.to_json(F.struct(F.concat(F.lit("s"), s).alias("subject"), F.lit("role").alias("predicate"), s.alias("object"), F.lit("literal").alias("object_type"), F.lit("2024").alias("valid_from"), F.lit(0.9).alias("confidence"), F.when(k % 8 == 0, k + 10**6).alias("replaces")))
    other = F.to_json(F.struct(F.concat(F.lit("e"), s).alias("entity_id"), F.concat(F.lit("N "), s).alias("name"), F.lit("person").alias("type"), F.concat(F.lit("p"), s).alias("suggested_slug"), F.concat(F.lit("T "), s).alias("title"), F.lit("sum").alias("summary"), F.array(F.lit("one")).alias("steps"), F.lit(2).alias("proposed_tier"), F.concat(F.lit("d"), s).alias("page_slug")))
    kind = F.get(F.array(*map(F.lit, kinds)), (k % 8).cast("int"))
    action = F.get(F.array(*map(F.lit, ("approve", "reject", "defer", "none"))), (k % 7 % 4).cast("int"))
    rows = t.table("events").select(F.lpad(s, 9, "0").alias("review_id"), kind.alias("kind"), F.lit("pending").alias("status"), action.alias("action"), F.when(k % 8 < 3, fact).otherwise(other).alias("payload"), F.when(k % 13 == 0, F.array(F.lit("payload"))).otherwise(F.array().cast(_NONE)).alias("errors"))
    return assemble.apply_reviews(rows, t.spark.range(100, 101).select("id"))


@query(f"with {_APPLIED} select lpad(event_id::varchar, 9, '0') as review_id, 's' || event_id as subject, 100 + row_number() over (order by event_id) as id from r where action = 'approve' and kind in ('fact_conflict', 'low_confidence', 'pending_fact')")
def reviewed_facts(t: Tables) -> DataFrame:
    """Facts of approved reviews, with ids in order."""
    return _decided(t)["facts"].select("review_id", "subject", "id")


@query(f"""with {_APPLIED} select 'entities' as change, 'e' || event_id as key, 'N ' || event_id as value from r where action = 'approve' and kind = 'new_entity' union all select 'procedures', 'p' || event_id, 'sum' || chr(10) || chr(10) || '1. one' from r where action = 'approve' and kind = 'procedure_candidate'
 union all select 'tiers', 'e' || event_id, '2' from r where action = 'approve' and kind = 'tier_proposal' union all select 'summaries', 'd' || event_id, 'sum' from r where action = 'approve' and kind = 'summary' union all select 'decided', lpad(event_id::varchar, 9, '0'), action from r where action = 'reject' or (action = 'approve' and kind <> 'ingest_error')
 union all select 'deferred', lpad(event_id::varchar, 9, '0'), 'defer' from r where action = 'defer' union all select 'superseded', (event_id + 1000000)::varchar, '2024' from r where action = 'approve' and kind = 'fact_conflict'""")
def reviewed_changes(t: Tables) -> DataFrame:
    """All other changes that decided reviews make."""
    d = _decided(t)
    row = lambda name, key, value: d[name].select(F.lit(name).alias("change"), F.col(key).cast("string").alias("key"), value.cast("string").alias("value"))
    out = row("entities", "id", F.col("title"))
    for name, key, value in (("procedures", "slug", F.col("text")), ("tiers", "entity_id", F.col("proposed_tier")), ("summaries", "page_slug", F.col("summary")), ("decided", "review_id", F.col("status")), ("deferred", "review_id", F.lit("defer")), ("superseded", "old_id", F.col("valid_to"))):
        out = out.unionByName(row(name, key, value))
    return out


@query("select job_id, total, processed, failed, status, case when status in ('completed', 'failed') then '2024-02-01' end as finished_at from (select *, case when processed < total then 'running' when failed = 0 then 'completed' else 'failed' end as status from (select job_id, count(*) as total, count(*) filter (doc_id % 3 <> 0) as processed, count(*) filter (doc_id % 3 = 1 and doc_id % 5 = 0) as failed from kb_files where job_id = (select min(job_id) from kb_files) group by 1))")
def finished_jobs(t: Tables) -> DataFrame:
    """A job from its first row to its counters: registered, marked, finished."""
    f = t.files()
    job = f.agg(F.min("job_id")).first()[0]
    own = f.where(F.col("job_id") == job)
    k = F.col("doc_id")
    done = own.where(k % 3 != 0).select("file_path", F.when((k % 3 == 1) & (k % 5 == 0), "failed").otherwise("extracted").alias("status"), F.lit(None).cast("string").alias("error"))
    log = importing.registered(own, job).unionByName(importing.marked(done, job, 1))
    return importing.finished(importing.new_job(own, job, "/in", "2024-01-01"), log, "2024-02-01").select("job_id", "total", "processed", "failed", "status", "finished_at")


@query("select doc_id from kb_files where doc_id % 3 = 0 or (doc_id % 3 = 1 and doc_id % 5 = 0)")
def resumed_files(t: Tables) -> DataFrame:
    """What a job that stopped has still to do."""
    f, k = t.files(), F.col("doc_id")
    done = f.where(k % 3 != 0).select("file_path", F.when((k % 3 == 1) & (k % 5 == 0), "failed").otherwise("extracted").alias("status"), F.lit(None).cast("string").alias("error"))
    return importing.resumed(f, importing.registered(f, "j").unionByName(importing.marked(done, "j", 1)), "j").select("doc_id")


@query("select count(*) as files, (sum(greatest(1, (size + 3) // 4)) + 1500 * count(*))::bigint as tokens, round(sum(usd), 4) as usd, sum(docs)::bigint as documents from (select kind, size, case when kind in ('pdf', 'jsonl') or size <= 8000 then 1 else greatest(1, len(regexp_extract_all(text, '(?m)^#{1,6}\\s+.+$'))) end as docs, (greatest(1, (size + 3) // 4) + 500) / 1e6 * 3 + 1000 / 1e6 * 0.02 as usd from kb_files where doc_id % 3 <> 0 and file_hash not in (select file_hash from kb_files where doc_id % 3 = 0 and (status in ('extracted', 'ingested') or not aborted)))")
def dry_import(t: Tables) -> DataFrame:
    """What an import would cost, without doing it."""
    f = t.files()
    return importing.dry_counts(f.where("doc_id % 3 <> 0"), f.where("doc_id % 3 = 0")).withColumn("usd", F.round("usd", 4))


@query(f"with {_DIFF}, y as (select count(*) filter (action <> 'orphan') as scanned, count(*) filter (action = 'added') as added, count(*) filter (action = 'updated') as updated, count(*) filter (action = 'orphan') as removed, count(*) filter (action = 'unchanged') as unchanged, 25 as private from x), z as (select sum(greatest(1, ceil(length(text) / 3.5)))::bigint as tokens from c join x using (page_slug) where action in ('added', 'updated')) select *, round(tokens / 1e6 * 0.02, 6) as usd from y, z")
def reindex_report(t: Tables) -> DataFrame:
    """What a reindex run does, in one row."""
    new = _chunks(t)
    return chunks.reindex_report(chunks.index_diff(new, _index(t)), new, t.table("nation"))


@query(f"with {_DIFF} select page_slug, action from x where regexp_extract(page_slug, '(\\d+)', 1)::bigint % 4 = 0 and page_slug not like '%gone'")
def reindex_filtered(t: Tables) -> DataFrame:
    """A run over some pages only."""
    slugs = t.pages().where("doc_id % 4 = 0").select("page_slug")
    new, index = chunks.filtered(_chunks(t), _index(t), slugs)
    return chunks.index_diff(new, index).select("page_slug", "action")


@query(f"with {_DIFF} select page_slug, content_hash, 64 as dimension from h")
def reindexed_rows(t: Tables) -> DataFrame:
    """The index after a run: every chunk once, with its hash and a vector of the model's length."""
    new, index = _chunks(t), _index(t).withColumn("embedding", F.array_repeat(F.lit(0.0).cast("float"), DIMENSION))
    out = chunks.reindexed(index, new, chunks.index_diff(new, index))
    return out.select("page_slug", "content_hash", F.size("embedding").alias("dimension"))


def _signals(t: Tables) -> DataFrame:
    """A signal of each event as a model would give it: two names and a fact, twice for some."""
    k, s = F.col("event_id"), F.col("event_id").cast("string")
    name = F.concat(F.lit("Customer#"), F.lpad((F.col("user_id") + 1).cast("string"), 9, "0"))
    fact = lambda conf: F.concat(F.lit('{"subject":"'), name, F.lit('","predicate":"Uses Tool","object":"'), F.concat(F.lit("tool "), (k % 5).cast("string")), F.lit(f'","object_type":"string","confidence":{conf}}}'))
    payload = F.concat(F.lit('{"entities":[{"name":"'), name, F.lit('","type":"person","confidence":0.9}],"facts":['), fact("0.6"), F.lit(","), F.when(k % 2 == 0, fact("0.9")).otherwise(fact("0.55")), F.lit('],"procedure_candidates":[{"suggested_slug":"p-'), s, F.lit('","title":"P '), s, F.lit('","summary":"s","steps":["a"],"confidence":0.9}],"timeline_summary":"event '), s, F.lit('"}'))
    return t.table("events").select(k.alias("item_id"), F.lit(0).alias("part"), ingest.normalized_signal(payload).alias("signal"))


@query("select event_id as item_id, 'uses' as predicate, case when event_id % 2 = 0 then 0.9 else 0.6 end as confidence, 'literal' as object_type from events")
def best_signals(t: Tables) -> DataFrame:
    """Facts that a signal states twice are one, with the higher confidence."""
    return ingest.merged_facts(_signals(t)).select("item_id", "predicate", "confidence", "object_type")


def _ingested(t: Tables) -> dict[str, DataFrame]:
    items = t.table("events").select(F.col("event_id").alias("item_id"), _named("e", F.col("event_id")).alias("event_id"), F.date_format("ts", "yyyy-MM-dd").alias("entry_date"), F.lit("r").alias("source_ref"))
    e = t.entities().where("type = 'person'").select("id", "type", "title")
    none = t.spark.createDataFrame([], "id long, subject string, predicate string, object string, valid_to string, superseded_by long")
    return ingest.ingest(_signals(t), items, e, t.spark.createDataFrame([], "alias string, entity_id string"), none)


_INGESTED = "i as (select event_id, 'customer-' || (user_id + 1) as subject, 'tool ' || event_id % 5 as object, strftime(ts, '%Y-%m-%d') as entry_date from events join customer on c_custkey = user_id + 1 where event_id % 2 = 0), a as (select subject, object, min(event_id) as event_id from i group by 1, 2)"


@query(f"with {_INGESTED} select event_id as item_id, subject, object, row_number() over (order by event_id) as id, 'e' || event_id as event_id, 'r' as source_ref from a")
def ingested_facts(t: Tables) -> DataFrame:
    """From signals to facts with ids: resolved names, decisions of the batch, where each came from."""
    return _ingested(t)["facts"].select("item_id", "subject", "object", "id", "event_id", "source_ref")


@query(f"with {_INGESTED} select 'timeline' as change, subject || ' ' || entry_date || ' event ' || event_id as value, 1 as n from a join i using (event_id, subject, object) union all select 'low_confidence', e.event_id::varchar, 1 from events e join customer on c_custkey = user_id + 1 where event_id % 2 = 1 and not exists (select 1 from a where a.subject = 'customer-' || (e.user_id + 1) and a.object = 'tool ' || e.event_id % 5 and a.event_id < e.event_id) union all select 'procedure_candidate', event_id::varchar, 1 from events")
def ingested_changes(t: Tables) -> DataFrame:
    """Timeline lines and review items that an ingest run makes."""
    out = _ingested(t)
    lines = out["timeline"].select(F.lit("timeline").alias("change"), F.concat_ws(" ", "page_slug", "entry_date", "description").alias("value"), F.lit(1).alias("n"))
    low = out["decided"].where("outcome = 'low-confidence review'").select(F.lit("low_confidence").alias("change"), F.col("item_id").cast("string").alias("value"), F.lit(1).alias("n"))
    steps = out["reviews"].where("kind = 'procedure_candidate'").select("kind", F.regexp_replace(F.get_json_object("payload", "$.suggested_slug"), "p-", "").alias("value"), F.lit(1).alias("n"))
    return lines.unionByName(low).unionByName(steps.withColumnRenamed("kind", "change"))


@query("select 'user-' || user_id as page_slug, count(*) + count(distinct event_id % 3) as lines, max(event_id) as newest from events group by 1, user_id")
def touched_pages(t: Tables) -> DataFrame:
    """Pages touched by events get one line for each, however often."""
    line = t.timeline()
    new = line.select("page_slug", "entry_date", (-1 - F.col("event_id") % 3).alias("event_id"), "description")
    none = t.entities().limit(0)
    out, _ = ingest.touch(line, new, t.user_pages(), none)
    return out.groupBy("page_slug").agg(F.count("*").alias("lines"), F.max("event_id").alias("newest"))


@query("select doc_id, case when doc_id % 2 = 0 and doc_id % 3 <> 0 then 'literal' else 'entity' end as object_type from documents where doc_id % 100 >= 50")
def focused_facts(t: Tables) -> DataFrame:
    """Paths as objects become literals unless an entity of that name has a title that is none."""
    k = F.col("doc_id")
    f = t.table("documents").select(k.alias("item_id"), F.lit("S").alias("subject"), F.when(k % 2 == 0, _named("C:\\data\\", k)).otherwise(_named("thing ", k)).alias("object"), F.lit("entity").alias("object_type"), (k % 100 / 100.0).alias("confidence"))
    known = t.table("documents").where(k % 3 == 0).select(_named("c:\\DATA\\", k).alias("name"), F.lit("The data folder").alias("title"))
    entities = f.select("item_id", F.lit("s").alias("norm"))
    return ingest.focused(f, entities, registry=known)[0].select(F.col("item_id").alias("doc_id"), "object_type")


@query("""select 'doc-' || doc_id as from_page, 'han-' || n_nationkey as to_entity, 'mentions' as relation, 2 as line_number from documents join nation on n_nationkey = doc_id % 25 where text is not null and doc_id % 3 <> 0""")
def han_links(t: Tables) -> DataFrame:
    """Aliases of one and more Han characters and of several words, each as it is written."""
    k = F.col("doc_id")
    alias = lambda n: F.concat(F.when(n % 3 == 0, F.lit("甲")).when(n % 3 == 1, F.lit("Port of ")).otherwise(F.lit("乙丙")), F.when(n % 3 == 1, n.cast("string")).otherwise(F.get(F.split(F.lit("子丑寅卯辰巳午未申酉戌亥鼠牛虎兔龙蛇马羊猴鸡狗猪天"), ""), n.cast("int"))), F.lit("."))
    aliases = t.table("nation").select(alias(F.col("n_nationkey")).alias("alias"), _named("han-", F.col("n_nationkey")).alias("entity_id"), F.lit("place").alias("entity_type"))
    text = F.concat(F.lit("first line\nseen at "), F.when(k % 3 == 0, F.concat(F.lit("[[x|"), alias(k % 25), F.lit("]]"))).otherwise(alias(k % 25)), F.lit(" then\nlast"))
    pages = t.table("documents").where("text is not null").select(_named("doc-", k).alias("page_slug"), F.lit("entity").alias("page_type"), text.alias("text"))
    return links.alias_links(links.page_lines(pages), aliases).where("to_entity like 'han-%'")
