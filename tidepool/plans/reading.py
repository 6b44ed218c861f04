"""Queries over the parsers, writers and text functions, on texts made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators import importing, ingest, registry, tables
from tidepool.plans.catalog import query
from tidepool.plans.views import Tables
from tidepool.sources import documents as sources
from tidepool.sources import sinks


def _docs(t: Tables) -> DataFrame:
    return t.table("documents").where("text is not null")


@query("select doc_id, source as title, coalesce(lang, 'none') as lang, sha256(text) as body from documents where text is not null")
def front_matter(t: Tables) -> DataFrame:
    """Texts behind front matter, taken apart again."""
    text = F.concat(F.lit("---\ntitle: '"), "source", F.lit("'\nlang: "), F.coalesce("lang", F.lit("none")), F.lit("\n---\n"), "text")
    meta, body = sources.split_front_matter(F.col("marked"))
    return _docs(t).withColumn("marked", text).select("doc_id", meta.alias("m"), F.sha2(body, 256).alias("body")).select("doc_id", F.col("m.title").alias("title"), F.col("m.lang").alias("lang"), "body")


@query("select conv_id::varchar as conversation_id, case when conv_id % 2 = 0 then 'talk ' || conv_id else conv_id::varchar end as title, case when max(conv_id % 3) = 0 then 'ai_chat' else 'human_chat' end as kind, sha256(string_agg('**' || trim(role) || '**: ' || trim(text), chr(10) || chr(10) order by turn)) as content from conversations where text is not null group by conv_id")
def nested_conversations(t: Tables) -> DataFrame:
    """One row for each conversation with its messages inside; titles where there is one."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "content", "model"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["model"].alias("model")))
    rows = t.messages().groupBy(F.col("conversation_id").alias("id")).agg(said.alias("messages"))
    rows = rows.select("id", F.when(F.col("id").cast("long") % 2 == 0, F.concat(F.lit("talk "), "id")).alias("title"), F.lit(None).cast("string").alias("model"), "messages", F.lit(0).alias("nth"))
    return sources.conversations_nested(rows).withColumn("content", F.sha2("content", 256))


@query("""select 'p/' || doc_id as path, 'about ' || source as compiled_truth, 2 as entries, 'event:' || doc_id as source_ref,
 concat_ws(',', case when doc_id % 5 = 0 then 'slug' end, case when doc_id % 7 = 0 and doc_id % 11 = 0 then 'tier' end, case when doc_id % 7 = 6 and doc_id % 4 <> 0 then 'procedure fields' when doc_id % 7 <> 6 and doc_id % 4 = 0 then 'procedure fields' end, case when doc_id % 6 = 0 then 'sections' end, case when doc_id % 13 = 0 then 'timeline' end) as errors from documents""")
def page_parse(t: Tables) -> DataFrame:
    """Wiki pages, some of them broken in their slug, tier, procedure fields, headings or timeline."""
    k, line = F.col("doc_id"), F.lit("\n")
    kind = F.get(F.array(*map(F.lit, ("entity", "project", "concept", "event", "experience", "conversation", "procedure"))), (k % 7).cast("int"))
    fields = F.array(F.concat(F.lit("type: "), kind), F.concat(F.lit("slug: "), F.when(k % 5 == 0, "Bad Slug").otherwise("good-slug")), F.concat(F.lit("title: "), "source"), F.when((k % 7 == 0) & (k % 11 != 0), "tier: 2"), F.when(k % 4 == 0, "status: raw\nsuccess_count: 0\nfail_count: 0"))
    entry = F.when(k % 13 == 0, "no entry").otherwise(F.concat(F.lit("- 2024-01-02 [event:"), k.cast("string"), F.lit("]: seen again")))
    body = F.concat(F.when(k % 6 == 0, "# Truth").otherwise("# Compiled truth"), F.lit("\n\nabout "), "source", F.lit("\n\n---\n# Timeline\n\n- 2024-01-01 [event:1]: seen\n"), entry, F.lit("\n\n---\n# Sources\n\n- event:"), k.cast("string"), line)
    text = F.concat(F.lit("---\n"), F.array_join(F.array_compact(fields), "\n"), F.lit("\n---\n"), body)
    out = sources.parse_pages(t.table("documents").select(F.concat(F.lit("p/"), k.cast("string")).alias("path"), text.alias("text")))
    return out.select("path", "compiled_truth", F.size("timeline").alias("entries"), F.get("sources", F.lit(0)).alias("source_ref"), F.array_join("errors", ",").alias("errors"))


@query("select page_slug, page_type, length(text) as chars from kb_pages where doc_id % 6 <> 0 union all select 'scratch/working', 'scratch', 5 union all select 'scratch/snapshot', 'scratch', 8")
def corpus_pages(t: Tables) -> DataFrame:
    """Valid pages and the two scratch texts."""
    pages = t.pages().withColumn("errors", F.when(F.col("doc_id") % 6 == 0, F.array(F.lit("slug"))).otherwise(F.array().cast("array<string>")))
    scratch = t.spark.createDataFrame([("scratch/working", "notes"), ("scratch/snapshot", "snapshot")], "marker string, text string")
    return registry.corpus(pages, scratch).select("page_slug", "page_type", F.length("text").alias("chars"))


@query("""select '2024-01-01_' || event_id || '_new_entity' as review_id, 'new_entity' as kind, case when event_id % 6 = 0 then 'done' else 'pending' end as status, case when event_id % 9 = 0 then 'none' else list_extract(['approve','reject','defer','none'], (event_id % 4 + 1)::int) end as action,
 case when event_id % 10 = 0 then null else event_id::varchar end as n, 'p' || event_id % 3 as priority, concat_ws(',', case when event_id % 9 = 0 then 'several decisions' end, case when event_id % 10 = 0 then 'payload' end) as errors from events""")
def review_items(t: Tables) -> DataFrame:
    """Review items: the first JSON with the field asked for, bullets, and one decision at most."""
    k = F.col("event_id")
    box = lambda name, on: F.concat(F.when(on, "- [x] ").otherwise("- [ ] "), F.lit(name), F.lit("\n"))
    boxes = F.concat(box("Approve it", (k % 4 == 0) | (k % 9 == 0)), box("Reject", (k % 4 == 1) | (k % 9 == 0)), box("Defer", (k % 4 == 2) & (k % 9 != 0)))
    other = F.when(k % 10 == 0, "").otherwise('```json\n{"other": 1}\n```\n')
    fence = F.when(k % 10 == 0, "```json\n{broken\n```\n").otherwise(F.concat(F.lit('```json\n{"n": "'), k.cast("string"), F.lit('"}\n```\n')))
    text = F.concat(F.lit("---\nstatus: "), F.when(k % 6 == 0, "Done").otherwise("pending"), F.lit("\n---\n- Priority: p"), (k % 3).cast("string"), F.lit("\n"), other, fence, boxes)
    raw = t.table("events").select(F.concat(F.lit("2024-01-01_"), k.cast("string"), F.lit("_new_entity")).alias("review_id"), text.alias("text"))
    out = sources.parse_reviews(raw, "n")
    return out.select("review_id", "kind", "status", "action", F.get_json_object("payload", "$.n").alias("n"), F.col("fields")["priority"].alias("priority"), F.array_join("errors", ",").alias("errors"))


@query("select 'in/' || doc_id as path, case when doc_id % 10 = 0 then 'not UTF-8' when doc_id % 7 = 0 then 'metadata' end as read_error, case when doc_id % 10 <> 0 then sha256(case when doc_id % 7 = 0 then '---' || chr(10) || 'a: b' || chr(10) || text else text end) end as text from documents where text is not null and doc_id % 3 <> 0 and doc_id % 4 <> 0")
def inbox_rows(t: Tables) -> DataFrame:
    """Unprocessed files; bytes that are no text and front matter without an end are errors of their own row."""
    k = F.col("doc_id")
    folder = F.when(k % 3 == 0, "processed/").otherwise("in/")
    text = F.concat(F.when(k % 7 == 0, "---\na: b\n").when(k % 2 == 0, "\ufeff").otherwise(""), "text")
    content = F.concat(F.encode(text, "UTF-8"), F.when(k % 10 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    files = _docs(t).where(~F.col("text").startswith("---")).select(F.concat(folder, k.cast("string")).alias("path"), content.alias("content"))
    done = t.table("documents").where(k % 4 == 0).select(F.concat(F.lit("in/"), k.cast("string")).alias("path"))
    return registry.inbox_metadata(registry.inbox(files, done)).select("path", F.sha2("text", 256).alias("text"), "read_error")


@query("select strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts, coalesce(nullif(case when event_id % 5 = 0 then ' ' else event_type end, ' '), 'manual') as source, 'note ' || props as text, count(*) as n from events where event_id % 7 <> 0 group by 1, 2, 3")
def scratch_notes(t: Tables) -> DataFrame:
    """Scratch entries written as sections and read again; blank ones are refused."""
    k = F.col("event_id")
    entries = t.table("events").select(k.alias("pos"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.when(k % 5 == 0, " ").otherwise(F.col("event_type")).alias("source"), F.when(k % 7 == 0, " \n").otherwise(F.concat(F.lit("\nnote "), "props", F.lit("\n"))).alias("text"))
    back = sources.scratch_entries(sinks.append_working(entries).select(F.col("rendered").alias("text")))
    return back.groupBy("ts", "source", "text").agg(F.count("*").alias("n"))


@query("select id, concat_ws(',', case when id like '%7' then 'tier in (1, 2, 3)' end, case when id like '%9' then 'unique (id)' end) as errors, case when id like '%9' then 2 else 1 end as n from kb_entities where id like '%7' or id like '%9'")
def broken_entities(t: Tables) -> DataFrame:
    """Rows of the entities table that break its checks, as the table's schema has them."""
    e = t.entities()
    rows = e.withColumn("tier", F.when(F.col("id").endswith("7"), 4).otherwise(F.col("tier"))).unionByName(e.where(F.col("id").endswith("9")))
    out = tables.broken_rows(tables.shaped(rows, "entities"), "entities")
    return out.groupBy("id", F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"))


@query("select page_slug, case when doc_id % 3 = 0 then 'from ' || doc_id end as sources from kb_pages")
def replaced_sections(t: Tables) -> DataFrame:
    """A section that pages lack is made for those that get one."""
    new = t.pages().where("doc_id % 3 = 0").select("page_slug", F.array(F.concat(F.lit("from "), F.col("doc_id").cast("string"))).alias("sources"))
    return sinks.replace_section(t.pages(), new, "sources").select("page_slug", F.array_join("sources", ",").alias("sources"))


@query("select event_id as run_id, 'run ' || event_type as message from events")
def run_log(t: Tables) -> DataFrame:
    """A line for each run, once."""
    e = t.table("events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("at"), F.concat(F.lit("run "), "event_type").alias("message"))
    new = e.withColumn("message", F.concat("message", F.lit("\r\n\n")))
    return sinks.append_log(e.where("run_id % 10 = 0"), new.unionByName(new)).select("run_id", "message")


@query("select case when n = 1 then slug else slug || '_' || (n - 1) end || '.md' as name, sha256('---' || chr(10) || 'import_job: job' || chr(10) || 'import_source: ' || lpad(doc_id::varchar, 9, '0') || chr(10) || 'import_hash: ' || sha256(text) || chr(10) || 'import_sequence: 1' || chr(10) || '---' || chr(10) || text) as text from (select doc_id, text, source as slug, row_number() over (partition by source order by doc_id) as n from documents where text is not null)")
def extracted_names(t: Tables) -> DataFrame:
    """Documents as they go to the inbox, with where they come from and a name of their own."""
    d = _docs(t).select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("source_path"), F.sha2("text", 256).alias("file_hash"), F.lit(1).alias("sequence"), F.col("source").alias("title"), F.col("text").alias("content"))
    return sinks.extracted_documents(d, "job").select("name", F.sha2("text", 256).alias("text"))


@query("select strftime(ts, '%Y-%m-%d') || '_' || printf('%03d', row_number() over (partition by strftime(ts, '%Y-%m-%d') order by event_id) + case when strftime(ts, '%Y-%m-%d') = '2024-01-05' then 7 else 0 end) || '_' || event_type as review_id, event_type as kind, event_id::varchar as n from events")
def review_ids(t: Tables) -> DataFrame:
    """Review items with date, number and kind in their id."""
    rows = t.table("events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_id").alias("key"), F.col("event_type").alias("kind"), F.to_json(F.struct(F.col("event_id").alias("n"))).alias("payload"))
    old = t.spark.createDataFrame([("2024-01-05", 7)], "date string, seq int")
    return sinks.review_rows(rows, old).select("review_id", "kind", F.get_json_object("payload", "$.n").alias("n"))


@query("select key, value from (select event_type as key, count(*)::varchar as value from events group by 1 union all select 'operation', 'merge')")
def audit_row(t: Tables) -> DataFrame:
    """The metadata of an operation's ledger row."""
    counts = t.table("events").groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("value"))
    return sinks.audit_event(counts, "merge", "1", "2024-01-01").select(F.explode("metadata").alias("key", "value"))


@query(r"""select doc_id, regexp_matches(source || '/v' || doc_id || '.' || doc_id % 3, '(?:[a-zA-Z]:[\\/]|https?://|[/\\][\w.-]+|\.(?:md|txt)\b|\bv?\d+(?:\.\d+)+\b|[a-zA-Z]\d+\.\d+)') as incidental, doc_id % 2 = 0 as artifact from documents""")
def value_shapes(t: Tables) -> DataFrame:
    """Names that are only paths, versions or addresses."""
    k = F.col("doc_id")
    name = F.concat("source", F.lit("/v"), k.cast("string"), F.lit("."), (k % 3).cast("string"))
    ref = F.concat(F.when(k % 4 == 0, " https://x/").when(k % 4 == 2, "C:\\").otherwise("x "), "source")
    return t.table("documents").select("doc_id", T.incidental_value(name).alias("incidental"), T.artifact_value(ref).alias("artifact"))


@query("""select doc_id, case when doc_id % 5 = 0 then null else sha256(trim(text)) end as body, case when doc_id % 3 = 0 then 'local-only' when doc_id % 3 = 1 then 'provider-allowed' end as mark from documents where text is not null and trim(text) <> '' and not regexp_matches(text, '^\\s*(---|source_agent|source_context|source_channel|source_ref|privacy)') and not regexp_matches(text, '\\A\\s|\\s\\z')""")
def provenance_marks(t: Tables) -> DataFrame:
    """Texts in six layers of headers and front matter: the strictest mark wins, whatever layer it stands in. Every fifth body is not compared."""
    k, body = F.col("doc_id"), F.col("text")
    inner = F.concat(F.when(k % 3 == 0, "privacy: local-only\n\n").otherwise(""), "text")
    for layer in range(6):
        head = F.concat(F.lit(f"source_agent: a{layer}\n"), F.when(k % 3 != 2, "privacy: provider-allowed\n").otherwise(""))
        inner = F.concat(F.lit("---\n"), head, F.lit("---\n"), inner) if layer % 2 else F.concat(head, F.lit("\n"), inner)
    plain = _docs(t).where((F.trim("text") != "") & ~body.rlike(r"^\s*(?:---|source_agent|source_context|source_channel|source_ref|privacy)") & ~body.rlike(r"\A\s|\s\z"))
    rest, mark = registry.provenance(F.col("marked"))
    return plain.withColumn("marked", inner).select("doc_id", F.when(k % 5 != 0, F.sha2(rest, 256)).alias("body"), mark.alias("mark"))


@query("""select event_id, case event_id % 8 when 0 then 'content' when 1 then 'transient' when 2 then 'infrastructure' when 3 then 'content' when 4 then 'transient' when 5 then 'content' when 6 then 'transient' else 'infrastructure' end as kind from events""")
def failure_kinds(t: Tables) -> DataFrame:
    """Failures by class, message, chain and status code."""
    cases = (("ValidationError", "", None, False), ("TimeoutError", "", None, False), ("RuntimeError,OSError", "", None, False), ("KeyError", "", None, False), ("RateLimitError", "slow down", None, True), ("LLMError", "Response was not valid JSON at all", None, True), ("LLMError", "busy", 503, True), ("LLMError", "no key", 401, True))
    pick = lambda i, kind: F.get(F.array(*(F.lit(c[i]).cast(kind) for c in cases)), (F.col("event_id") % 8).cast("int"))
    return t.table("events").select("event_id", T.failure_kind(pick(0, "string"), pick(1, "string"), pick(2, "int"), pick(3, "boolean")).alias("kind"))


@query("select doc_id, sha256(case when doc_id % 3 = 0 then 'source_agent: a' || chr(10) || 'source_context: b' || chr(10) || chr(10) || text else 'source_agent: me' || chr(10) || 'source_context: ' || source || chr(10) || 'source_channel: mail' || case when doc_id % 2 = 0 then chr(10) || 'source_ref: r' || doc_id else '' end || chr(10) || chr(10) || text end) as text from documents where text is not null")
def source_headers(t: Tables) -> DataFrame:
    """Four header lines in front of texts that say not yet where they come from."""
    k = F.col("doc_id")
    text = F.concat(F.when(k % 3 == 0, "source_agent: a\nsource_context: b\n\n").otherwise(""), "text")
    return _docs(t).select("doc_id", F.sha2(sinks.with_context(text, F.lit("me"), F.col("source"), F.lit("mail"), F.when(k % 2 == 0, F.concat(F.lit("r"), k.cast("string")))), 256).alias("text"))


@query("""with recursive p as (select doc_id as item_id, 0 as part, text as rest from documents where text <> ''), s as (select item_id, part, rest, case when length(rest) <= 300 then length(rest) else (case when 300 - strpos(reverse(substr(rest, 1, 300)), chr(10)) < 300 and strpos(reverse(substr(rest, 1, 300)), chr(10)) > 0 and 300 - strpos(reverse(substr(rest, 1, 300)), chr(10)) > 150 then 300 - strpos(reverse(substr(rest, 1, 300)), chr(10)) else 300 end) end as cut from p
 union all select item_id, part + 1, substr(rest, cut + 1), case when length(rest) - cut <= 300 then length(rest) - cut else (case when strpos(reverse(substr(rest, cut + 1, 300)), chr(10)) > 0 and 300 - strpos(reverse(substr(rest, cut + 1, 300)), chr(10)) > 150 then 300 - strpos(reverse(substr(rest, cut + 1, 300)), chr(10)) else 300 end) end from s where length(rest) > cut)
 select item_id, part, sha256(substr(rest, 1, cut)) as text from s""")
def text_parts(t: Tables) -> DataFrame:
    """Texts cut at the last line end in the second half of 300 characters, else after 300."""
    return ingest.parts(_docs(t).select(F.col("doc_id").alias("item_id"), "text"), 300).withColumn("text", F.sha2("text", 256))


@query("select doc_id, greatest(1, case when kind = 'pdf' then size // 4 else (size + 3) // 4 end) as tokens, case when kind in ('pdf', 'jsonl') or size <= 8000 then 1 else greatest(1, len(regexp_extract_all(text, '(?m)^#{1,6}\\s+.+$'))) end as documents from kb_files")
def file_estimates(t: Tables) -> DataFrame:
    """Tokens and documents that a file will give."""
    f = t.files()
    return f.select("doc_id", T.file_tokens(F.col("size"), F.col("kind")).cast("long").alias("tokens"), importing.estimated_documents(f).cast("long").alias("documents"))


@query("select event_id, case event_type when 'click' then 'entity' when 'view' then 'literal' when 'purchase' then 'date' when 'signup' then 'number' else 'other' end as kind, strftime(ts, '%Y-%m-%d %H:%M:%S') as at, event_type || chr(10) || chr(10) || '1. one' || chr(10) || '2. ' || user_id as steps from events")
def small_functions(t: Tables) -> DataFrame:
    """Object types, times and numbered steps."""
    kind = F.when(F.col("event_type") == "click", " Person").when(F.col("event_type") == "view", "Bool").when(F.col("event_type") == "purchase", "datetime").when(F.col("event_type") == "signup", "INTEGER").otherwise("Other")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+00:00"))
    return t.table("events").select("event_id", T.object_type(kind).alias("kind"), F.date_format(T.parse_timestamp(iso), "yyyy-MM-dd HH:mm:ss").alias("at"), T.numbered_steps(F.col("event_type"), F.array(F.lit("one"), F.col("user_id").cast("string"))).alias("steps"))


@query("select doc_id, case when doc_id % 5 = 0 then 'org' when page_type in ('project','concept','event','experience','conversation') then page_type when doc_id % 3 = 0 then 'place' else 'person' end as type from kb_pages")
def entity_types(t: Tables) -> DataFrame:
    """A page's entity type: stated, by page type, by tag, or as the registry has it."""
    k = F.col("doc_id")
    tags = F.when(k % 3 == 0, F.array(F.lit("blue"), F.lit("place"))).otherwise(F.array(F.lit("blue")))
    return t.pages().select("doc_id", registry.entity_type(F.when(k % 5 == 0, "org"), F.col("page_type"), tags, F.lit("person")).alias("type"))


@query("""select case event_id % 4 when 0 then 'strasse ' || event_id % 50 when 1 then 'full width ' || event_id % 50 when 2 then 'office ' || event_id % 50 else 'plain name ' || event_id % 50 end as norm_title, count(distinct event_id) as ids, min('e' || event_id) as first_id, max('e' || event_id) as last_id from events group by 1 having count(distinct event_id) > 1""")
def name_forms(t: Tables) -> DataFrame:
    """Titles that are one name in NFKC and folded case: sharp s, full width, ligatures, wide spaces."""
    k = F.col("event_id")
    title = F.when(k % 4 == 0, F.when(k % 8 == 0, "Stra\u00dfe ").otherwise("STRASSE ")).when(k % 4 == 1, F.when(k % 8 == 1, "\uff26\uff55\uff4c\uff4c\u3000\uff37\uff49\uff44\uff54\uff48 ").otherwise("full  width ")).when(k % 4 == 2, F.when(k % 8 == 2, "o\ufb03ce ").otherwise("Office ")).otherwise(" Plain\tName ")
    from tidepool.operators.maintain import title_collisions

    return title_collisions(t.table("events").select(F.concat(F.lit("e"), k.cast("string")).alias("id"), F.concat(title, (k % 50).cast("string")).alias("title")))
