"""Queries over table changes, lookups and hydration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators import assemble, facts, ingest, links, maintain, retrieval
from tidepool.plans.catalog import query
from tidepool.plans.retrieving import _BM25, _corpus
from tidepool.plans.views import Tables
from tidepool.sources import documents as sources
from tidepool.sources import sinks


@query("select id, nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), '') as slug, regexp_matches(id, '^[a-z0-9]+(-[a-z0-9]+)*$') as valid from kb_entities")
def entity_slugs(t: Tables) -> DataFrame:
    return t.entities().select("id", T.slug(F.col("title")).alias("slug"), T.valid_slug(F.col("id")).alias("valid"))


@query("""select id, regexp_matches(title, '^v?\\d+([-.]\\d+){1,4}$') or regexp_matches(title, '\\b\\d{8}\\b') or regexp_matches(lower(title), '\\.(md|txt|json|toml|ya?ml|py|ts|tsx|js|jsx|pdf|docx?)$') or list_has_any(string_split(id, '-'), ['draft','note','notes','plan','release','review','smoke','test','testing','todo','upgrade','verification','verify']) as transient from (select 'doc-' || doc_id as id, split_part(text, ' ', 1) || '.' || case when doc_id % 4 = 0 then 'md' else 'x' end as title from documents where text is not null)""")
def transient_names(t: Tables) -> DataFrame:
    d = t.table("documents").where("text is not null")
    title = F.concat(F.substring_index("text", " ", 1), F.lit("."), F.when(F.col("doc_id") % 4 == 0, "md").otherwise("x"))
    named = d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), title.alias("title"))
    return named.select("id", T.is_transient(F.col("id"), F.col("title")).alias("transient"))


@query("select id, kind from kb_ledger where kind <> 'odd' and id > lpad('200', 26, '0') and event_id % 3 <> 0")
def ingest_items(t: Tables) -> DataFrame:
    """Events after a cursor that no run has done."""
    ledger = t.ledger().where("kind <> 'odd'").withColumn("raw_payload", F.col("props"))
    return ingest.event_items(ledger, ledger.where("event_id % 3 = 0"), "200".rjust(26, "0")).select("id", "kind")


@query("select id, case when id like '%7' then 'changed' else title end as title, tier from kb_entities union all select 'new-' || n_nationkey, n_name, 3 from nation")
def entity_upsert(t: Tables) -> DataFrame:
    old = t.entities().select("id", "title", "tier")
    new = old.where("id like '%7'").withColumn("title", F.lit("changed")).unionByName(t.table("nation").select(F.concat(F.lit("new-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"), F.lit(3).alias("tier")))
    return facts.upsert(old, new, ["id"])


@query("""with x as (select c.ord from kb_candidates c where c.confidence >= 0.8), g as (select * from kb_candidates where confidence >= 0.8 and valid_to is null), e as (select distinct subject, norm_pred, object from kb_candidates where ord % 97 = 0),
 d as (select c.*, exists(select 1 from e where e.subject = c.subject and e.norm_pred = c.norm_pred and e.object = c.object) as m, exists(select 1 from e where e.subject = c.subject and e.norm_pred = c.norm_pred) as h, (select min(ord) from g where g.subject = c.subject and g.norm_pred = c.norm_pred) as fk, (select min(ord) from g where g.subject = c.subject and g.norm_pred = c.norm_pred and g.object = c.object) as fo from kb_candidates c where c.confidence >= 0.8)
 select ord, 10 + row_number() over (order by ord) as id from d where not m and case when single then not h and not coalesce(ord > fk, false) else not coalesce(ord > fo, false) end""")
def new_fact_ids(t: Tables) -> DataFrame:
    """Ids of the facts that a batch adds, after the largest one that exists."""
    start = t.spark.range(10, 11).select("id")
    return facts.new_facts(facts.decide(t.candidates(), t.known()), start).select("ord", "id")


@query("select c_custkey * 2 as old_id, subject, 'superseded' as state from customer join kb_facts on id = c_custkey * 2 where c_custkey % 5 = 0")
def superseded_facts(t: Tables) -> DataFrame:
    f, k = t.facts(), F.col("c_custkey")
    replaced = t.table("customer").where(k % 5 == 0).select((k * 2).alias("old_id"), (k * 2 + 10**9).alias("new_id"), F.lit("2002-01-01").alias("valid_to"))
    done = facts.supersede(f, replaced).where("superseded_by >= 1000000000 and valid_to = '2002-01-01'")
    return done.select(F.col("id").alias("old_id"), "subject", F.lit("superseded").alias("state"))


@query("select from_page, to_entity, relation, line_number from kb_backlinks where from_page not like '%7' union all select 'order-7', 'part-1', 'mentions', 1")
def replaced_backlinks(t: Tables) -> DataFrame:
    old = t.backlinks()
    pages = old.where("from_page like '%7'").select(F.col("from_page").alias("page_slug")).distinct()
    new = t.spark.createDataFrame([("order-7", "part-1", "mentions", 1), ("order-7", "gone", "mentions", 2)], "from_page string, to_entity string, relation string, line_number int")
    return links.replace_backlinks(old, pages, new, t.entities())


@query("select id, object as old_object, title as new_object, 'literal' as new_type from kb_facts join (select id as object, title from kb_entities where type = 'place' and id like '%1') using (object)")
def literal_plan(t: Tables) -> DataFrame:
    ids = t.entities().where("type = 'place' and id like '%1'").select("id", "title")
    return maintain.literalize(t.facts(), ids)


@query("select page_slug from kb_pages where (doc_id * 7 % 2000) % 10 = 0")
def pages_linking(t: Tables) -> DataFrame:
    targets = t.spark.range(2000).where("id % 10 = 0").select(F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("target"))
    return links.pages_linking(t.pages(), targets)


@query("select c.subject, c.predicate, c.object, c.valid_to from (select distinct subject, predicate, object, valid_to from kb_candidates) c where not exists (select 1 from kb_candidates p where p.ord % 50 = 0 and p.subject = c.subject and p.predicate = c.predicate and p.object = c.object and p.valid_to is not distinct from c.valid_to)")
def unsuppressed_candidates(t: Tables) -> DataFrame:
    c = t.candidates()
    return facts.known_suppression(c, c.where("ord % 50 = 0"), ["subject", "predicate", "object"], ["valid_to"]).select("subject", "predicate", "object", "valid_to")


@query("select prefix, case when n = 1 then id end as id, n as matches from (select substr(id, 1, 24) as prefix, count(*) as n, min(id) as id from kb_ledger group by 1)")
def prefix_lookup(t: Tables) -> DataFrame:
    ledger = t.ledger()
    return sources.by_prefix(ledger.select(F.substring("id", 1, 24).alias("prefix")).distinct(), ledger)


@query("""select page_slug, entry_date, event_id, description from (select 'user-' || (u - u % 4) as page_slug, entry_date, event_id % 5 as event_id, description, row_number() over (partition by u - u % 4, entry_date, event_id % 5 order by u % 4 <> 0, pos, description) as n from (select *, regexp_extract(page_slug, '(\\d+)', 1)::int as u from kb_timeline)) where n = 1""")
def merged_timelines(t: Tables) -> DataFrame:
    """Timelines of four users each merged into one, an entry for each page, date and event."""
    line = t.timeline().withColumn("event_id", F.col("event_id") % 5)
    n = F.regexp_extract("page_slug", r"(\d+)", 1).cast("long")
    pair = line.select("page_slug").distinct().where(n % 4 != 0).select(F.col("page_slug").alias("loser"), F.concat(F.lit("user-"), (n - n % 4).cast("string")).alias("canonical"))
    return maintain.merge_timelines(line, pair)


@query("select 'user-' || user_id as page_slug, count(*) + 1 as entries, max(event_id) as last_event from events group by 1, user_id having true")
def appended_timeline(t: Tables) -> DataFrame:
    """Every user's timeline with one new entry and one that is there already."""
    line = t.timeline()
    first = line.groupBy("page_slug").agg(F.min("event_id").alias("event_id"))
    fresh = first.withColumn("event_id", F.lit(-1).cast("long"))
    new = first.unionByName(fresh).select("page_slug", F.lit(0).cast("long").alias("pos"), F.lit("2024-02-01").alias("entry_date"), "event_id", F.lit("x").alias("description"))
    return sinks.append_timeline(line, new).groupBy("page_slug").agg(F.count("*").alias("entries"), F.max("event_id").alias("last_event"))


@query(f"with {_BM25} select query_id, page_slug, rank, substr(text, 1, 200) as excerpt from bm join (select 'doc-' || doc_id as page_slug, text from documents) using (page_slug) where rank <= 5")
def hydrated_results(t: Tables) -> DataFrame:
    pages = _corpus(t).withColumn("title", F.col("page_slug"))
    line = t.timeline()
    return retrieval.hydrate(retrieval.bm25(_corpus(t), t.questions(), 5), pages, line).select("query_id", "page_slug", "rank", "excerpt")


@query(f"with {_BM25} select query_id, 'keyword' as path, rank, page_slug from bm where rank <= 10")
def retrieval_trace(t: Tables) -> DataFrame:
    hits = retrieval.bm25(_corpus(t), t.questions(), 50).select("query_id", F.lit("keyword").alias("path"), "rank", "page_slug")
    return retrieval.trace(hits).select("query_id", "path", "rank", "page_slug")


@query("""with d as (select page_slug, regexp_extract_all(lower(trim(title || chr(10) || text)), '[a-z0-9]+') as words from kb_pages), q as (select query_id, term, count(*) as qtf from (select p.doc_id as query_id, unnest(regexp_extract_all(lower(trim(p.text)), '[a-z0-9]+')) as term from kb_pages p join embeddings on vec_id = doc_id where vec_id % 20 = 0) group by 1, 2),
 tf as (select page_slug, dl, term, count(*) as tf from (select page_slug, len(words) as dl, unnest(words) as term from d) where term in (select term from q) group by 1, 2, 3), df as (select term, count(*) as df from tf group by 1), n as (select count(*) as n, avg(len(words)) as avgdl from d),
 s as (select query_id, page_slug, count(*) as coverage, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as score from q join tf using (term) join df using (term), n group by 1, 2),
 v as (select q.vec_id as query_id, 'doc-' || v.vec_id as page_slug, row_number() over (partition by q.vec_id order by round(list_distance(q.embedding::double[], v.embedding::double[]), 9), v.vec_id) as rank from (select * from embeddings where vec_id % 20 = 0) q, embeddings v),
 u as (select query_id, page_slug, rank from v where rank <= 50 union all select query_id, page_slug, row_number() over (partition by query_id order by coverage desc, score desc, page_slug) as rank from s where score > 0 qualify rank <= 50),
 f as (select query_id, page_slug, round(round(sum(1.0 / (60 + rank)), 9) * any_value(case when page_type <> 'procedure' or status = 'stable' then 1.0 when status = 'tested' then 0.7 else 0.3 end), 9) as score from u join kb_pages using (page_slug) group by 1, 2)
 select * from (select query_id, page_slug, round(score, 6) as score, row_number() over (partition by query_id order by score desc, page_slug) as rank, 'hybrid' as route from f) where rank <= 5""")
def hybrid_ask(t: Tables) -> DataFrame:
    """Hybrid mode with every page and vector whose id is divisible by 20 as a question, by its whole text."""
    v = t.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    pages = t.pages()
    q = pages.join(asked.select(F.col("query_id").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.ask(pages, q, "hybrid", vectors=v, query_vectors=asked).select("query_id", "page_slug", F.round("score", 6).alias("score"), "rank", "route")


@query("""with recursive x as (select 'p' || user_id as slug, event_type in ('click', 'view', 'purchase') as ok, row_number() over (partition by user_id order by event_id) as n from events), s as (select slug, 0 as n, 'raw' as status, 0 as good, 0 as bad from (select distinct slug from x)
 union all select s.slug, x.n, case when ok then case when status = 'raw' then 'tested' when status = 'tested' and good + 1 >= 5 and bad = 0 then 'stable' else status end when status = 'stable' and bad + 1 >= 2 then 'tested' when status = 'tested' and bad + 1 > good then 'raw' else status end, good + ok::int, bad + (not ok)::int from s join x on x.slug = s.slug and x.n = s.n + 1)
 select slug, status, good as success_count, bad as fail_count from s where n = (select max(n) from x where x.slug = s.slug)""")
def procedure_states(t: Tables) -> DataFrame:
    """Lifecycle state after all runs."""
    runs = t.table("events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("slug"), F.col("event_id").alias("seq"), F.col("event_type").isin("click", "view", "purchase").alias("ok"))
    return assemble.procedure_states(runs)
