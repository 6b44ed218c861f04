"""Sinks: ledger rows, rendered pages, timelines, sections, captures, audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T


def append_ledger(events: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    events.write.mode("append").json(path)


def rendered(pages: DataFrame) -> DataFrame:
    """path, text of pages(page_type, slug, title, tier, curated, compiled_truth, timeline, sources): front matter and three sections."""
    head = F.array_compact(F.array(F.concat(F.lit("type: "), "page_type"), F.concat(F.lit("slug: "), "slug"), F.concat(F.lit("title: "), "title"), F.concat(F.lit("tier: "), F.col("tier").cast("string")), F.when(F.col("curated"), F.lit("curated: true"))))
    items = lambda c, mark="": F.array_join(F.transform(c, lambda x: F.concat(F.lit(mark), x)), "\n")
    text = F.concat(F.lit("---\n"), F.array_join(head, "\n"), F.lit("\n---\n# Compiled truth\n\n"), "compiled_truth", F.lit("\n\n---\n# Timeline\n\n"), items("timeline"), F.lit("\n\n---\n# Sources\n\n"), items("sources", "- "), F.lit("\n"))
    return pages.select(page_path(F.col("page_type"), F.col("slug")).alias("path"), text.alias("text"))


def page_path(page_type: Column, slug: Column) -> Column:
    return F.concat(F.lit("pages/"), page_type, F.lit("/"), slug, F.lit(".md"))


def append_timeline(timeline: DataFrame, new: DataFrame) -> DataFrame:
    """New entries after the old ones, unless the page has their event."""
    fresh = new.dropDuplicates(["page_slug", "event_id"]).join(timeline.select("page_slug", "event_id"), ["page_slug", "event_id"], "left_anti")
    last = timeline.groupBy("page_slug").agg(F.max("pos").alias("_last"))
    return timeline.unionByName(fresh.join(last, "page_slug", "left").withColumn("pos", F.coalesce("_last", F.lit(-1)) + 1 + F.col("pos")).select(*timeline.columns))


def replace_section(pages: DataFrame, updates: DataFrame, section: str) -> DataFrame:
    """Pages with the given section replaced where updates(page_slug, <section>) has one; a section that pages lack is made, null
    elsewhere."""
    u = updates.select("page_slug", F.col(section).alias("_new"))
    if section not in pages.columns:
        pages = pages.withColumn(section, F.lit(None).cast(dict(updates.dtypes)[section]))
    return pages.join(u, "page_slug", "left").withColumn(section, F.coalesce("_new", section)).select(*pages.columns)


def page_index(pages: DataFrame) -> DataFrame:
    """title, relative_path of all pages, by path."""
    return pages.select("title", "relative_path").orderBy("relative_path")


def captures(notes: DataFrame) -> DataFrame:
    """notes(note_id, kind, source, text) -> inbox rows: file name from the first words, refused where a secret stands in them."""
    clean = notes.where(~T.contains_secret(F.col("text")) & F.col("kind").isin("note", "chat", "clip") & (F.trim("text") != ""))
    return clean.select("note_id", F.coalesce(F.nullif(T.capture_slug(F.col("text")), F.lit("")), F.lit("note")).alias("name"), with_context(F.col("text"), F.col("source")).alias("text"))


def with_context(text: Column, agent: Column, context: Column | None = None, channel: Column | None = None, ref: Column | None = None) -> Column:
    """The header lines of a source (agent, context, channel, ref; those that are given) and the text, unless its first paragraph names
    agent and context already; without a context to add, an agent is enough."""
    head = F.substring_index(text, "\n\n", 1)
    has = lambda k: head.rlike(rf"(?m)^[ \t]*{k}:[ \t]*\S")
    own = has(T.SOURCE_HEADER[0]) & has(T.SOURCE_HEADER[1]) if context is not None else T.any_of([has(k) for k in T.SOURCE_HEADER])
    values = [agent, context, channel, ref]
    lines = [F.when(F.trim(v) != "", F.concat(F.lit(f"{k}: "), F.trim(v))) for k, v in zip(T.SOURCE_HEADER, values, strict=True) if v is not None]
    return F.when(own, text).otherwise(F.concat(F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n" if context is None else "\n\n"), text))


def append_log(log: DataFrame, messages: DataFrame) -> DataFrame:
    """log(run_id, at, message) with one line for each run of messages(run_id, at, message), line ends at the end cut off; a run that is
    logged already is not logged again."""
    new = messages.select("run_id", "at", F.regexp_replace(F.regexp_replace("message", r"\r\n?", "\n"), r"\n+\z", "").alias("message"))
    return log.unionByName(new.dropDuplicates(["run_id"]).join(log.select("run_id"), "run_id", "left_anti"))


def append_working(entries: DataFrame) -> DataFrame:
    """pos, chars, rendered of scratch entries(pos, ts, source, text): sections as scratch_entries reads them; blank texts are refused."""
    body = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"\A\s+|\s+\z", "")
    source = F.coalesce(F.nullif(F.regexp_replace(F.trim("source"), r"\s+", " "), F.lit("")), F.lit("manual"))
    rows = entries.select("pos", "ts", source.alias("source"), body.alias("text")).where("text <> ''")
    return rows.select("pos", F.length("text").alias("chars"), F.concat(F.lit("\n## "), "ts", F.lit(" - source: "), "source", F.lit("\n\n"), "text", F.lit("\n")).alias("rendered"))


def extracted_documents(documents: DataFrame, job_id: str) -> DataFrame:
    """name, text, job_id, source_path, file_hash of documents(source_path, file_hash, sequence, title, content) as they go to the inbox:
    where they come from stands in front of the text, names are safe and unique."""
    from tidepool.operators.assemble import unique_names

    head = [("import_job", F.lit(job_id)), ("import_source", F.col("source_path")), ("import_hash", F.col("file_hash")), ("import_sequence", F.col("sequence").cast("string"))]
    text = F.concat(F.lit("---\n"), F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), v) for k, v in head)), F.lit("\n---\n"), F.col("content"))
    rows = documents.select(F.struct("source_path", "sequence").alias("key"), T.safe_filename(F.col("title")).alias("name"), text.alias("text"), F.lit(job_id).alias("job_id"), "source_path", "file_hash")
    none = rows.limit(0).select("name")
    return unique_names(rows, none).select(F.concat("unique_name", F.lit(".md")).alias("name"), "text", "job_id", "source_path", "file_hash")


def audit_event(counts: DataFrame, operation: str, event_id: str, at: str) -> DataFrame:
    """One ledger row with an operation's counts(metric, value) as metadata; there are a few metrics only."""
    meta = F.map_from_entries(F.collect_list(F.struct("metric", F.col("value").cast("string"))))
    return counts.agg(F.map_concat(F.create_map(F.lit("operation"), F.lit(operation)), meta).alias("metadata")).select(F.lit(event_id).alias("id"), F.lit(at).alias("timestamp"), F.lit("page_edited").alias("kind"), "metadata")


def review_rows(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """review_id, kind, payload of rows(date, key, kind, payload): ids are date_number_kind, numbered after existing(date, seq)."""
    from tidepool.operators.assemble import numbered

    n = numbered(rows, existing)
    return n.select(F.concat_ws("_", "date", F.format_string("%03d", F.col("seq").cast("long")), "kind").alias("review_id"), "kind", "payload")
