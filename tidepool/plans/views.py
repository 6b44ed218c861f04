"""Knowledge-base tables derived from the driver's tables, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators.maintain import PAGE_TYPES

MODEL, DIMENSION = "local", 64


class Tables:
    """The driver's tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def pages(self, plain: bool = False) -> DataFrame:
        """Documents as pages; plain: the text alone, without a title and a link."""
        d, k = self.table("documents").where("text is not null"), F.col("doc_id")
        kind = F.get(F.array(*map(F.lit, PAGE_TYPES)), (k % 7).cast("int"))
        slug = F.concat(F.lit("doc-"), k.cast("string"))
        status = F.get(F.array(F.lit("raw"), F.lit("tested"), F.lit("stable")), (k % 3).cast("int"))
        return d.select(
            k, slug.alias("page_slug"), kind.alias("page_type"), F.when(k % 7 == 0, (1 + k % 3).cast("int")).alias("tier"), F.when(k % 7 == 6, status).alias("status"),
            F.concat(F.lit("pages/"), kind, F.lit("/"), slug, F.lit(".md")).alias("relative_path"), (F.lit(None).cast("string") if plain else F.substring(F.substring_index("text", "\n", 1), 1, 60)).alias("title"),
            F.col("text") if plain else F.concat("text", F.lit(" [[doc-"), (k * 7 % 2000).cast("string"), F.lit("]]")).alias("text"),
        )

    def timeline(self) -> DataFrame:
        e, u = self.table("events"), F.col("user_id")
        said = F.concat("event_type", F.lit(" "), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" [[user-"), (u * 7 % 200).cast("string"), F.lit("]]"))
        return e.select(F.concat(F.lit("user-"), u.cast("string")).alias("page_slug"), F.col("event_id").alias("pos"), F.date_format("ts", "yyyy-MM-dd").alias("entry_date"), "event_id", said.alias("description"))

    def user_pages(self) -> DataFrame:
        return self.timeline().select("page_slug").distinct().select("page_slug", F.lit("entity").alias("page_type"), (F.hash("page_slug") * 0 + 1).alias("tier"), F.concat(F.lit("see [["), "page_slug", F.lit("]] and [[doc-1]]")).alias("text"), F.col("page_slug").alias("title"))

    def entities(self) -> DataFrame:
        def of(table, prefix, key, title, kind):
            k = F.col(key).cast("long")
            return self.table(table).select(F.concat(F.lit(prefix), k.cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(title).alias("title"), (1 + k % 3).cast("int").alias("tier"), (k % 11).alias("mention_count"))

        return of("customer", "customer-", "c_custkey", "c_name", "person").unionByName(of("supplier", "supplier-", "s_suppkey", "s_name", "org")).unionByName(of("nation", "nation-", "n_nationkey", "n_name", "place")).unionByName(of("part", "part-", "p_partkey", "p_name", "concept"))

    def aliases(self) -> DataFrame:
        words = self.table("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("alias")).where(F.length("alias") >= 7).distinct()
        named = self.entities().where("type in ('place', 'org')").select(F.lower("title").alias("alias"), F.col("id").alias("entity_id"), F.col("type").alias("entity_type"))
        return words.select("alias", F.concat(F.lit("word-"), "alias").alias("entity_id"), F.lit("concept").alias("entity_type")).unionByName(named)

    def facts(self) -> DataFrame:
        c, o, k = self.table("customer"), self.table("orders"), F.col("c_custkey")
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        who = F.concat(F.lit("customer-"), k.cast("string")).alias("subject")
        none = F.lit(None).cast("string")
        role = c.select((k * 2).alias("id"), who, F.lit("role").alias("predicate"), F.col("c_mktsegment").alias("object"), F.lit("literal").alias("object_type"), none.alias("valid_to"), F.lit("1995-01-01").alias("asserted_at"), F.lit(0.9).alias("confidence"))
        place = c.join(nation, "c_nationkey").select((k * 2 + 1).alias("id"), who, F.when(k % 2 == 0, "located-in").otherwise("location").alias("predicate"), F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("object"), F.lit("entity").alias("object_type"), none.alias("valid_to"), F.lit("1995-01-01").alias("asserted_at"), F.lit(0.8).alias("confidence"))
        n = F.col("o_orderkey")
        state = o.select((n + 10_000_000).alias("id"), F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("subject"), F.when(n % 4 == 0, "role").otherwise("current status").alias("predicate"), F.col("o_orderstatus").alias("object"), F.lit("literal").alias("object_type"), F.when(n % 11 == 0, "2001-01-01").alias("valid_to"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("asserted_at"), (n % 100 / 100.0).alias("confidence"))
        every = role.unionByName(place).unionByName(state)
        return every.withColumn("valid_from", F.col("asserted_at")).withColumn("superseded_by", F.when(F.col("id") % 13 == 0, F.col("id") + 1))

    def candidates(self) -> DataFrame:
        kind = F.col("event_type")
        predicate = F.when(kind == "signup", "Role").when(kind == "click", "uses tool").when(kind == "view", "passes").when(kind == "purchase", "decision").otherwise("located-in")
        return self.table("events").select(
            F.col("event_id").alias("ord"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("subject"), predicate.alias("predicate"),
            (F.get_json_object("props", "$.k").cast("int") % 5).cast("string").alias("object"), (F.col("event_id") % 100 / 100.0).alias("confidence"), F.when(F.col("event_id") % 11 == 0, "2024-06-01").alias("valid_to"),
        )

    def known(self) -> DataFrame:
        """Active facts that the candidates meet."""
        c = self.candidates().where("ord % 97 = 0")
        return c.select("subject", "predicate", "object").distinct()

    def backlinks(self) -> DataFrame:
        link = self.table("lineitem").select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("from_page"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("to_entity"), F.when(F.col("l_returnflag") == "A", "mentions").otherwise("involves").alias("relation"), "l_linenumber")
        return link.groupBy("from_page", "to_entity", "relation").agg(F.min("l_linenumber").alias("line_number"))

    def files(self) -> DataFrame:
        k = F.col("doc_id")
        pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (k % n).cast("int"))
        return self.table("documents").where("text is not null").select(
            k, F.concat("source", F.lit("/"), k.cast("string")).alias("file_path"), pick(("md", "txt", "pdf", "jsonl"), 4).alias("kind"), F.sha2("text", 256).alias("file_hash"), F.col("source").alias("job_id"),
            pick(("pending", "extracted", "ingested", "failed", "skipped"), 5).alias("status"), F.length("text").alias("size"), (k % 10 == 0).alias("aborted"), "text",
        )

    def marked(self) -> DataFrame:
        """Documents as Markdown: every fifth line is a heading."""
        line = F.transform(F.split("text", "\n"), lambda x, i: F.when((i % 5 == 4) & (x != ""), F.concat(F.lit("# "), x)).otherwise(x))
        return self.table("documents").where("text is not null").select("doc_id", F.array_join(line, "\n").alias("text"))

    def messages(self) -> DataFrame:
        return self.table("conversations").where("text is not null").select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"), F.when(F.col("conv_id") % 3 == 0, "m").alias("model"))

    def ledger(self) -> DataFrame:
        k = F.col("event_type")
        kind = F.when(k == "click", "human_chat").when(k == "view", "ai_chat").when(k == "purchase", "page_edited").when(k == "signup", "note_appended").otherwise("odd")
        return self.table("events").select(F.lpad(F.col("event_id").cast("string"), 26, "0").alias("id"), kind.alias("kind"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("page_slug"), (F.col("event_id") % 120 / 100.0).alias("confidence"), F.col("props"), F.lit(None).cast("string").alias("_corrupt"), "event_id", "event_type", "user_id")

    def questions(self) -> DataFrame:
        return self.table("benchmark").where("text is not null").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    def asked(self) -> DataFrame:
        """Questions made of names: one for every customer whose id is divisible by 20, with a year, and for every nation."""
        c = self.table("customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("list what "), F.upper("c_name"), F.lit(" did in "), (F.col("c_custkey") / 20 % 7 + 1995).cast("int").cast("string")).alias("query"))
        n = self.table("nation").select((F.col("n_nationkey") + 100_000_000).cast("long").alias("query_id"), F.concat(F.lit("who lives in "), "n_name").alias("query"))
        return c.unionByName(n)


#: The same views in DuckDB SQL; each may use those before it.
VIEWS = {
    "kb_pages": """select doc_id, 'doc-' || doc_id as page_slug, list_extract(['entity','project','concept','event','experience','conversation','procedure'], (doc_id % 7 + 1)::int) as page_type,
 case when doc_id % 7 = 0 then (1 + doc_id % 3)::int end as tier, case when doc_id % 7 = 6 then list_extract(['raw','tested','stable'], (doc_id % 3 + 1)::int) end as status,
 substr(split_part(text, chr(10), 1), 1, 60) as title, text || ' [[doc-' || (doc_id * 7 % 2000) || ']]' as text from documents where text is not null""",
    "kb_timeline": """select 'user-' || user_id as page_slug, event_id as pos, strftime(ts, '%Y-%m-%d') as entry_date, event_id, event_type || ' ' || value::decimal(18,2)::varchar || ' [[user-' || (user_id * 7 % 200) || ']]' as description, 'user-' || (user_id * 7 % 200) as target from events""",
    "kb_entities": """select 'customer-' || c_custkey as id, 'person' as type, c_name as title, (1 + c_custkey % 3)::int as tier, c_custkey % 11 as mention_count from customer
 union all select 'supplier-' || s_suppkey, 'org', s_name, (1 + s_suppkey % 3)::int, s_suppkey % 11 from supplier union all select 'nation-' || n_nationkey, 'place', n_name, (1 + n_nationkey % 3)::int, n_nationkey % 11 from nation
 union all select 'part-' || p_partkey, 'concept', p_name, (1 + p_partkey % 3)::int, p_partkey % 11 from part""",
    "kb_aliases": """select distinct w as alias, 'word-' || w as entity_id, 'concept' as entity_type from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from benchmark) where length(w) >= 7
 union all select lower(title), id, type from kb_entities where type in ('place', 'org')""",
    "predicates": "select * from (values ('has_current_commit','current_commit'),('has_production_commit','current_commit'),('has_status','status'),('current_status','status'),('employed_by','works_at'),('has_role','role'),('resides_in','lives_in'),('located_in','location'),('current_location','location'),('uses_tool','uses'),('use','uses'),('has_commit','committed'),('passed_test','passed'),('passes','passed'),('decision','decided'),('has_decision','decided'),('preference','prefers')) t(alias, canonical)",
    "kb_facts": """select *, asserted_at as valid_from, case when id % 13 = 0 then id + 1 end as superseded_by, coalesce(canonical, key) as norm_pred, coalesce(canonical, key) in ('role','location') as single from (
 select c_custkey * 2 as id, 'customer-' || c_custkey as subject, 'role' as predicate, c_mktsegment as object, 'literal' as object_type, null::varchar as valid_to, '1995-01-01' as asserted_at, 0.9::double as confidence from customer
 union all select c_custkey * 2 + 1, 'customer-' || c_custkey, case when c_custkey % 2 = 0 then 'located-in' else 'location' end, 'nation-' || c_nationkey, 'entity', null, '1995-01-01', 0.8 from customer join nation on c_nationkey = n_nationkey
 union all select o_orderkey + 10000000, 'customer-' || o_custkey, case when o_orderkey % 4 = 0 then 'role' else 'current status' end, o_orderstatus, 'literal', case when o_orderkey % 11 = 0 then '2001-01-01' end, strftime(o_orderdate, '%Y-%m-%d'), (o_orderkey % 100) / 100.0 from orders) f,
 lateral (select regexp_replace(lower(trim(f.predicate)), '[\\s-]+', '_', 'g') as key) x left join predicates on predicates.alias = x.key""",
    "kb_candidates": """select *, coalesce(canonical, key) as norm_pred, coalesce(canonical, key) in ('role','location') as single from (
 select event_id as ord, 'user-' || user_id as subject, case event_type when 'signup' then 'Role' when 'click' then 'uses tool' when 'view' then 'passes' when 'purchase' then 'decision' else 'located-in' end as predicate,
 ((json_extract_string(props, '$.k'))::int % 5)::varchar as object, (event_id % 100) / 100.0 as confidence, case when event_id % 11 = 0 then '2024-06-01' end as valid_to from events) c,
 lateral (select regexp_replace(lower(trim(c.predicate)), '[\\s-]+', '_', 'g') as key) x left join predicates on predicates.alias = x.key""",
    "kb_backlinks": """select 'order-' || l_orderkey as from_page, 'part-' || l_partkey as to_entity, case when l_returnflag = 'A' then 'mentions' else 'involves' end as relation, min(l_linenumber) as line_number from lineitem group by 1, 2, 3""",
    "kb_files": """select doc_id, source || '/' || doc_id as file_path, list_extract(['md','txt','pdf','jsonl'], (doc_id % 4 + 1)::int) as kind, sha256(text) as file_hash, source as job_id, list_extract(['pending','extracted','ingested','failed','skipped'], (doc_id % 5 + 1)::int) as status, length(text) as size, doc_id % 10 = 0 as aborted, text from documents where text is not null""",
    "kb_ledger": """select lpad(event_id::varchar, 26, '0') as id, case event_type when 'click' then 'human_chat' when 'view' then 'ai_chat' when 'purchase' then 'page_edited' when 'signup' then 'note_appended' else 'odd' end as kind, 'user-' || user_id as page_slug, (event_id % 120) / 100.0 as confidence, event_id, event_type, user_id from events""",
    "kb_asked": """select c_custkey as query_id, 'list what ' || upper(c_name) || ' did in ' || (c_custkey // 20 % 7 + 1995) as query from customer where c_custkey % 20 = 0 union all select n_nationkey + 100000000, 'who lives in ' || n_name from nation""",
    "kb_md": """select doc_id, (select string_agg(case when i % 5 = 0 and l <> '' then '# ' || l else l end, chr(10) order by i) from (select unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i)) as text from documents where text is not null""",
}


def sql(body: str, *names: str) -> str:
    """A statement with the views it names (and those that these use) before it."""
    need: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and other in VIEWS[name] and other not in need:
                add(other)
        if name not in need:
            need.append(name)

    for n in VIEWS:
        if n in body or n in names:
            add(n)
    body, views = body.strip(), ", ".join(f"{n} as ({VIEWS[n]})" for n in need)
    if not need:
        return body
    return f"with {views}, {body[5:]}" if body.startswith("with ") else f"with {views} {body}"
