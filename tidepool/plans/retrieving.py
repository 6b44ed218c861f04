"""Queries over the retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators import assemble, retrieval
from tidepool.plans.catalog import query
from tidepool.plans.views import Tables

_TOKENS = """q as (select item_id as query_id, term, count(*) as qtf from (select item_id, unnest(regexp_extract_all(lower(trim(text)), '[a-z0-9]+')) as term from benchmark where text is not null) group by 1, 2),
 d as (select 'doc-' || doc_id as page_slug, regexp_extract_all(lower(trim(text)), '[a-z0-9]+') as words from documents where text is not null),
 tf as (select page_slug, dl, term, count(*) as tf from (select page_slug, len(words) as dl, unnest(words) as term from d) where term in (select term from q) group by 1, 2, 3)"""
_BM25 = f"""{_TOKENS}, df as (select term, count(*) as df from tf group by 1), n as (select count(*) as n, avg(len(words)) as avgdl from d),
 s as (select query_id, page_slug, count(*) as coverage, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as score from q join tf using (term) join df using (term), n group by 1, 2),
 bm as (select *, row_number() over (partition by query_id order by coverage desc, score desc, page_slug) as rank from s where score > 0)"""


def _corpus(t: Tables) -> DataFrame:
    return t.table("documents").where("text is not null").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("page_slug"), "text")


@query(f"with {_BM25} select query_id, page_slug, coverage, round(score, 6) as score, rank from bm where rank <= 50")
def bm25_topk(t: Tables) -> DataFrame:
    """Top 50 documents of every benchmark item by term coverage, then BM25."""
    return retrieval.bm25(_corpus(t), t.questions(), 50).withColumn("score", F.round("score", 6))


_KEYWORD = f"""{_TOKENS}, k as (select query_id, page_slug, round(sum(1 + ln(tf)), 9) as score from q join tf using (term) group by 1, 2),
 w as (select doc_id, 'doc-' || doc_id as page_slug, case when doc_id % 7 <> 6 or doc_id % 3 = 2 then 1.0 when doc_id % 3 = 1 then 0.7 else 0.3 end as weight from documents)"""


@query(f"with {_KEYWORD} select * from (select query_id, page_slug, round(score * weight, 6) as score, row_number() over (partition by query_id order by round(score * weight, 9) desc, page_slug) as rank from k join w using (page_slug)) where rank <= 5")
def keyword_only_ask(t: Tables) -> DataFrame:
    """Default mode: sum of 1 + ln(tf), weighted by the state of procedures."""
    return retrieval.ask(t.pages(plain=True), t.questions(), top=5).select("query_id", "page_slug", F.round("score", 6).alias("score"), "rank")


@query("select query_id, vec_id, round(distance, 6) as distance, rank from (select q.vec_id as query_id, v.vec_id, list_distance(q.embedding::double[], v.embedding::double[]) as distance, row_number() over (partition by q.vec_id order by round(list_distance(q.embedding::double[], v.embedding::double[]), 9), v.vec_id) as rank from (select * from embeddings where vec_id % 20 = 0) q, embeddings v) where rank <= 10")
def knn_topk(t: Tables) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 20."""
    v = t.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.knn(v, asked, 10).withColumn("distance", F.round("distance", 6))


@query(f"""with {_BM25}, kw as (select query_id, page_slug, row_number() over (partition by query_id order by score desc, page_slug) as rank from (select query_id, page_slug, round(sum(1 + ln(tf)), 9) as score from q join tf using (term) group by 1, 2)),
 u as (select query_id, page_slug, rank from bm where rank <= 50 union all select * from kw where rank <= 50), f as (select query_id, page_slug, round(sum(1.0 / (60 + rank)), 9) as score, count(*) as hits from u group by 1, 2)
 select query_id, page_slug, round(score, 6) as score, hits, row_number() over (partition by query_id order by score desc, page_slug) as rank from f""")
def rrf_fusion(t: Tables) -> DataFrame:
    """BM25 and keyword paths fused by reciprocal rank."""
    corpus, asked = _corpus(t), t.questions()
    table = retrieval.term_table(corpus, asked)
    kw = retrieval.ranked(retrieval.keyword_top(corpus, asked, 50, table=table), "query_id", F.desc("score"), F.asc("page_slug"), top=50)
    paths = retrieval.bm25(corpus, asked, 50, table=table).select("query_id", "page_slug", "rank").unionByName(kw.select("query_id", "page_slug", "rank"))
    return retrieval.rrf(paths).withColumn("score", F.round("score", 6))


_MATCH = """terms as (select query_id, unnest(list_distinct(list_concat([lower(query)], regexp_extract_all(lower(trim(query)), '[a-z0-9]+')))) as term from kb_asked),
 names as (select id as entity_id, title as name from kb_entities union all select id, id from kb_entities union all select entity_id, alias from kb_aliases where entity_type in ('place', 'org')),
 m as (select distinct query_id, entity_id from terms join names on term = lower(name)), c as (select distinct query_id, entity_id from kb_asked join names on contains(lower(query), lower(name)))"""


def _names(t: Tables) -> DataFrame:
    return retrieval.names_of(t.entities(), t.aliases().where("entity_type in ('place', 'org')").select("alias", "entity_id"))


@query(f"select query_id, count(*) as entities, min(entity_id) as first_entity from (with {_MATCH} select * from c) group by 1")
def contained_names(t: Tables) -> DataFrame:
    """Entities whose name stands in a question."""
    return retrieval.contained_names(t.asked(), _names(t)).groupBy("query_id").agg(F.count("*").alias("entities"), F.min("entity_id").alias("first_entity"))


@query("""select query_id, to_entity as entity_id, from_page, links, rank from (select p.p_partkey as query_id, b.to_entity, b.from_page, count(*) as links, row_number() over (partition by p.p_partkey order by count(*) desc, b.from_page) as rank
 from part p join kb_backlinks b on b.to_entity = 'part-' || p.p_partkey group by 1, 2, 3) where rank <= 3""")
def backlink_sources(t: Tables) -> DataFrame:
    """Pages that link to each part, most links first."""
    m = t.table("part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("entity_id"))
    return retrieval.backlink_sources(m, t.backlinks(), 3).join(m, "query_id").select("query_id", "entity_id", "from_page", "links", "rank")


@query("""select * from (select q.query_id, m.page_slug, row_number() over (partition by q.query_id order by m.path, m.entity_id, m.links desc, m.page_slug) as rank, m.path, m.links from (select p_partkey as query_id, p_name as query from part) q join (
 select query_id, page_slug, 0 as path, min(entity_id) as entity_id, 0 as links from (select p.p_partkey as query_id, e.id as entity_id, e.id as page_slug from part p join kb_entities e on lower(e.title) = lower(p.p_name)) group by 1, 2
 union all select query_id, page_slug, 1, '', links from (select query_id, from_page as page_slug, links, row_number() over (partition by query_id order by links desc, from_page) as n from (select p.p_partkey as query_id, b.from_page, count(*) as links from part p join kb_entities e on lower(e.title) = lower(p.p_name) join kb_backlinks b on b.to_entity = e.id group by 1, 2)) where n <= 10) m using (query_id)) where rank <= 10""")
def registry_match(t: Tables) -> DataFrame:
    """Pages of the entities that a part's name stands for, then pages that link to them."""
    q = t.table("part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    e = t.entities()
    names = e.select(F.col("id").alias("entity_id"), F.col("title").alias("name"))
    return retrieval.registry_path(q, names, e.select(F.col("id").alias("entity_id"), F.col("id").alias("page_slug")), t.backlinks(), 10).select("query_id", "page_slug", "path", "links", "rank")


@query(f"""with {_MATCH}, a as (select query_id, regexp_extract(query, '(\\d{{4}})', 1) as date from kb_asked where regexp_matches(query, '(?i)\\b(who|when|list|which|what people|how many|show me)\\b')),
 r as (select query_id, id, subject, asserted_at, row_number() over (partition by query_id order by asserted_at desc, id desc) as nth from (select distinct a.query_id, f.id, f.subject, f.asserted_at from a join c using (query_id) join kb_facts f on f.superseded_by is null and (f.subject = c.entity_id or f.object = c.entity_id)
 and (a.date = '' or starts_with(f.valid_from, a.date) or starts_with(f.valid_to, a.date) or starts_with(f.asserted_at, a.date) or contains(f.object, a.date)))), s as (select query_id, subject as page_slug, round(sum(1.0 / nth), 9) as score, count(*) as facts from r where nth <= 500 group by 1, 2)
 select * from (select query_id, page_slug, round(score, 6) as score, facts, row_number() over (partition by query_id order by score desc, page_slug) as rank from s) where rank <= 50""")
def fact_shortcut(t: Tables) -> DataFrame:
    """Structured questions answered from the fact table."""
    q = t.asked()
    return retrieval.fact_path(q, t.facts(), retrieval.contained_names(q, _names(t)), 50).withColumn("score", F.round("score", 6))


@query("""select 'doc-' || doc_id as page_slug, regexp_matches(trim(text), '\\d{4}\\s*年|\\d{4}[-/]\\d{1,2}|Q[1-4]|(?i:\\b(who|when|list|which|what people|how many|show me)\\b)') as structured, replace(nullif(regexp_extract(text, '(\\d{4}(?:[-/]\\d{1,2}(?:[-/]\\d{1,2})?)?)', 1), ''), '/', '-') as date from documents where text is not null""")
def query_routing(t: Tables) -> DataFrame:
    """Every document's text as a question: structured or open, and its date."""
    return _corpus(t).select("page_slug", T.is_structured(F.col("text")).alias("structured"), T.date_fragment(F.col("text")).alias("date"))


@query("select 'doc-' || doc_id as page_slug, case when text = '' then 0 else greatest(1, ceil(length(text) / 3.5)::int) end as tokens from documents where text is not null")
def approx_tokens(t: Tables) -> DataFrame:
    return _corpus(t).select("page_slug", T.approximate_tokens(F.col("text")).alias("tokens"))


@query("select page_slug, entry_date, description, rank from (select page_slug, entry_date, description, row_number() over (partition by page_slug order by entry_date desc, pos desc) as rank from kb_timeline) where rank <= 3")
def recent_timeline(t: Tables) -> DataFrame:
    return retrieval.newest_lines(t.timeline()).select("page_slug", "entry_date", "description", "rank")


@query("""with m as (select event_id as query_id, 'user-' || user_id as page_slug, 1.0 / (1 + event_id % 7) as score, event_id % 4 as k from events)
 select query_id, page_slug, round(case when k > 0 then greatest(score, 1.0) * pow(1.5, k) else score end, 6) as score from m union all select event_id, 'own-' || event_id, 1.0 from events where event_id % 5 = 0""")
def boosts(t: Tables) -> DataFrame:
    """Scores of pages that k matched entities link from, and of matched entities' own pages."""
    e = t.table("events").select(F.col("event_id").alias("query_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("page_slug"), (F.col("event_id") % 4).cast("int").alias("k"))
    scores = e.select("query_id", "page_slug", (1.0 / (1 + F.col("query_id") % 7)).alias("score"))
    links = e.where("k > 0").select("query_id", "page_slug", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("n"))
    matches = links.select("query_id", F.concat_ws("/", "page_slug", "n").alias("entity_id"))
    back = links.select(F.concat_ws("/", "page_slug", "n").alias("to_entity"), F.col("page_slug").alias("from_page"))
    own = e.where("query_id % 5 = 0").select("query_id", F.concat(F.lit("self-"), F.col("query_id").cast("string")).alias("entity_id"))
    pages = own.select("entity_id", F.replace("entity_id", F.lit("self"), F.lit("own")).alias("page_slug"))
    return retrieval.boosted(scores, matches.unionByName(own), pages, back).withColumn("score", F.round("score", 6))


@query("select 'doc-' || doc_id as page_slug, regexp_matches(text, '(?i)(api[\\s_-]?key|access[\\s_-]?key([\\s_-]?id)?|access[\\s_-]?token|client[\\s_-]?secret|secret|password|passwd|authorization)[\"'']?\\s*(:|=|\\bis\\b|\\s)\\s*[\"'']?[^\\s,;\"'']{4,}') or regexp_matches(text, '\\bsk-[A-Za-z0-9_-]{10,}\\b|\\bgh[pousr]_[A-Za-z0-9_]{10,}\\b|\\bhf_[A-Za-z0-9]{10,}\\b|\\bAKIA[0-9A-Z]{12,20}\\b|\\bAIza[0-9A-Za-z_-]{20,}\\b|\\bxox[baprs]-[A-Za-z0-9-]{10,}\\b|\\beyJ[A-Za-z0-9_-]{20,}\\.[A-Za-z0-9_-]{10,}') as secret from documents where text is not null")
def secret_scan(t: Tables) -> DataFrame:
    return _corpus(t).select("page_slug", T.contains_secret(F.col("text")).alias("secret"))


@query()
def recall_probe(t: Tables) -> DataFrame:
    """Conversation turns that call for a look at what is known, with their minimal question (rows only: a fold in order)."""
    c = t.table("conversations").where("text is not null")
    return assemble.recall_probe(c.select(F.concat_ws("-", "conv_id", "turn").alias("prompt_id"), F.concat(F.lit("as before: "), "text").alias("prompt")))


@query()
def inject_context(t: Tables) -> DataFrame:
    """Contexts of 600 tokens for every benchmark item (rows only: greedy packing)."""
    corpus, q = _corpus(t), t.questions()
    pages = corpus.withColumn("title", F.col("page_slug"))
    out = assemble.inject(retrieval.bm25(corpus, q, 8), pages, q, 600)
    return out.select("query_id", F.length("context").alias("chars"), F.sha2("context", 256).alias("digest"))
