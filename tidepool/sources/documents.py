"""Sources: files, Markdown and text documents, conversations, page texts, ledgers, pages, reviews, scratch notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tidepool.functions import text as T

WHOLE, PART = 8000, 8000
KINDS = {"md": "md", "txt": "txt", "pdf": "pdf", "jsonl": "jsonl"}
#: The kinds of ledger events.
EVENT_KINDS = ("raw_imported", "bulk_imported", "laundry_ingested", "note_appended", "ai_chat", "human_chat", "review_decided", "page_edited", "rebuild", "reindexed")
EVENT = t.StructType(
    [
        t.StructField("id", t.StringType()),
        t.StructField("timestamp", t.StringType()),
        t.StructField("kind", t.StringType()),
        t.StructField("source_ref", t.StringType()),
        t.StructField("raw_payload", t.StringType()),
        t.StructField("raw_payload_path", t.StringType()),
        t.StructField("extracted_facts", t.ArrayType(t.StringType())),
        t.StructField("affected_pages", t.ArrayType(t.StringType())),
        t.StructField("confidence", t.DoubleType()),
        t.StructField("metadata", t.MapType(t.StringType(), t.StringType())),
        t.StructField("_corrupt", t.StringType()),
    ]
)
ULID = "^[0-9A-HJKMNP-TV-Z]{26}$"


def file_kind(path: Column) -> Column:
    """Kind of a file by its suffix; null for unsupported files."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(suffix.isin(*KINDS), suffix)


def normalized_kinds(kinds: list[str]) -> list[str]:
    """`.MD` and `md` are one kind; others are errors."""
    out = sorted({k.strip().lower().lstrip(".") for k in kinds})
    if bad := [k for k in out if k not in KINDS]:
        raise ValueError(f"unsupported kinds: {', '.join(bad)}")
    return out


def discover(spark: SparkSession, root: str, kinds: list[str] | None = None) -> DataFrame:
    """relative_path, kind, file_hash, size of the files under root, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.sha2("content", 256).alias("file_hash"), F.col("length").alias("size"))
    files = files.withColumn("kind", file_kind(F.col("path"))).where("kind is not null")
    files = files.where(F.col("kind").isin(normalized_kinds(kinds))) if kinds else files
    base = root.rstrip("/") + "/"
    return files.select(F.element_at(F.split("path", base.replace(".", r"\.")), -1).alias("relative_path"), "kind", "file_hash", "size").orderBy("relative_path")


def split_front_matter(text: Column) -> tuple[Column, Column]:
    """(map of `key: value` lines between the first two lines of ---, rest of the text)."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    entries = F.transform(F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, "^[^:]*:", "")), "^[\"']|[\"']$", "").alias("v")))
    return F.map_from_entries(F.array_distinct(entries)), F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")


def section_parts(text: Column, pattern: str = r"#\s+", least: int = WHOLE) -> Column:
    """Array of the sections of a text: a long one at its top headings, others whole, blank ones too.

    What stands before the first heading goes to the first section. A line ends at a line feed, as it does for the reference and in
    SQL, not at the other characters that Java takes for the end of one.
    """
    parts = F.split(text, rf"(?md)(?=^{pattern})")
    lead = (F.size(parts) > 1) & ~F.element_at(parts, 1).rlike(rf"\A{pattern}")
    joined = F.when(lead, F.concat(F.array(F.concat(F.element_at(parts, 1), F.get(parts, F.lit(1)))), F.slice(parts, F.lit(3), F.size(parts)))).otherwise(parts)
    return F.when(F.length(text) > least, joined).otherwise(F.array(text))


def split_sections(docs: DataFrame, pattern: str = r"#\s+", least: int = WHOLE) -> DataFrame:
    """doc_id, section_index, title, content: the sections of section_parts."""
    out = docs.select("doc_id", F.posexplode(section_parts(F.col("text"), pattern, least)).alias("i", "content"))
    return out.select("doc_id", (F.col("i") + 1).alias("section_index"), F.trim(F.regexp_extract("content", r"(?md)^#{1,6}\s+(.+)$", 1)).alias("title"), "content")


def split_any_heading(docs: DataFrame, width: int = PART) -> DataFrame:
    """doc_id, part, content: at headings of any level, or every `width` characters where there is at most one."""
    count = F.regexp_count("text", F.lit(r"(?m)^#{1,6}\s+.+$"))
    at_heads = F.filter(F.split("text", r"(?m)(?=^#{1,6}\s+)"), lambda x: F.trim(x) != "")
    slices = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1), F.lit(width)), lambda i: F.substring("text", i + 1, F.lit(width)))
    return docs.where(F.length("text") > 0).select("doc_id", F.posexplode(F.when(count <= 1, slices).otherwise(at_heads)).alias("i", "content")).select("doc_id", (F.col("i") + 1).alias("part"), "content")


def read_jsonl(spark: SparkSession, path: str, schema: t.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows with their file and line order, files that hold a broken line); schema needs a `_corrupt` string field."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("file", F.input_file_name()).withColumn("pos", F.monotonically_increasing_id())
    bad = rows.where("_corrupt is not null").select("file").distinct()
    return rows.join(bad, "file", "left_anti"), bad


CONVERSATION = "id string, conversation_id string, title string, model string, messages array<struct<role: string, content: string, model: string>>"
MESSAGE = "conversation_id string, role string, content string, model string"


def conversation_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, messages, refused files) of JSON-lines files: each file holds one form, or it is refused with its error.

    conversations: file, nth, id, title, model, messages (as conversations_nested takes them); messages: file, pos,
    conversation_id, role, content, model (as conversations_flat takes them); refused: file, error. A file's lines are in
    order of the byte where their block starts and of their place in the block, however the file is split; nth counts a file's
    rows from 1. Blank lines are no rows; a file without rows is not read.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"))
    keys = F.json_object_keys("value")
    flat = F.array_contains(keys, "conversation_id") & F.array_contains(keys, "role") & F.array_contains(keys, "content")
    form = F.when(keys.isNull(), "broken").when(F.ltrim(F.get_json_object("value", "$.messages")).startswith("["), "A").when(flat, "B").otherwise("other")
    rows = lines.withColumn("form", form)
    of_file = rows.groupBy("file").agg(F.bool_and(F.col("form") == "A").alias("a"), F.bool_and(F.col("form") == "B").alias("b"), F.bool_or(F.col("form") == "broken").alias("broken"))
    error = F.when(F.col("broken"), "a line is no JSON object").when(~F.col("a") & ~F.col("b"), "rows must all be conversations with messages or all be messages with conversation_id")
    kind = of_file.select("file", error.alias("error"), F.when(F.col("a"), "A").otherwise("B").alias("kind"))
    good = rows.join(kind.where("error is null").drop("error"), "file")
    # one row for each block of a file; a block's rows are numbered by themselves
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = good.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("file", "block").orderBy("line"))
    good = good.withColumn("_nth", nth).join(blocks, ["file", "block"]).withColumn("nth", F.col("before") + F.col("_nth"))
    one = good.where("kind = 'A'").select("file", "nth", F.from_json("value", CONVERSATION).alias("r"))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    one = one.select("file", "nth", F.coalesce(some("r.id"), some("r.conversation_id")).alias("id"), some("r.title").alias("title"), "r.model", "r.messages")
    many = good.where("kind = 'B'").select("file", F.col("nth").alias("pos"), F.from_json("value", MESSAGE).alias("r")).select("file", "pos", "r.*")
    return one, many, kind.where("error is not null").select("file", "error")


def conversations_nested(rows: DataFrame) -> DataFrame:
    """Format A: rows(id, title, model, messages array<struct<role, content, model>>) -> one document each."""
    text = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("**"), F.trim(m["role"]), F.lit("**: "), F.trim(m["content"]))), "\n\n")
    ai = F.col("model").isNotNull() | F.exists("messages", lambda m: m["model"].isNotNull())
    name = F.concat(F.lit("conversation-"), F.col("nth").cast("string"))
    return rows.select(F.coalesce("id", name).alias("conversation_id"), F.coalesce("title", "id", name).alias("title"), text.alias("content"), F.when(ai, "ai_chat").otherwise("human_chat").alias("kind"))


def conversations_flat(rows: DataFrame) -> DataFrame:
    """Format B: rows(conversation_id, pos, role, content, model) -> one document for each conversation, in order."""
    said = F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("**"), F.trim("role"), F.lit("**: "), F.trim("content")).alias("text"))))
    return rows.groupBy("conversation_id").agg(F.min("pos").alias("first_pos"), F.array_join(F.transform(said, lambda m: m["text"]), "\n\n").alias("content"), F.when(F.bool_or(F.col("model").isNotNull()), "ai_chat").otherwise("human_chat").alias("kind"))


def page_groups(pages: DataFrame, size: int = 5) -> DataFrame:
    """(file, page_no, text) -> one document for each `size` pages, titled by the file's stem and its pages (the last group of a file may
    have fewer); empty pages are skipped, and files without text give none: see textless_files."""
    group = F.floor((F.col("page_no") - 1) / size)
    held = F.filter(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: F.trim(p["text"]) != "")
    full = pages.groupBy("file", group.alias("g")).agg(held.alias("held"), F.max("page_no").alias("last_page")).where(F.size("held") > 0)
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(?<=.)\.[^.]*$", "")
    out = full.select("file", (F.col("g") * size + 1).alias("first_page"), "last_page", F.size("held").cast("long").alias("pages"), F.array_join(F.transform("held", lambda p: p["text"]), "\n\n").alias("content"), stem.alias("stem"))
    return out.withColumn("title", F.concat("stem", F.lit(" pp."), "first_page", F.lit("-"), "last_page")).drop("stem")


def textless_files(pages: DataFrame) -> DataFrame:
    """file, error of files all of whose pages are empty: they fail, as there is nothing to import."""
    return pages.groupBy("file").agg(F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("n")).where("n = 0").select("file", F.lit("no text").alias("error"))


def extra_keys(line: Column) -> Column:
    """Top-level keys of a JSON text that a ledger row does not have; an empty array where there are none or it is no object."""
    return F.coalesce(F.array_except(F.json_object_keys(line), F.array(*(F.lit(f.name) for f in EVENT if f.name != "_corrupt"))), F.array().cast("array<string>"))


def event_errors(timestamp: str | None = None, extra: str | None = None) -> Column:
    """What is wrong with a ledger row: its JSON, id, kind, confidence and, where their columns are named, its time (ISO text) and
    keys that it should not have."""
    more = [F.when(F.try_to_timestamp(F.col(timestamp)).isNull(), "timestamp")] if timestamp else []
    more += [F.when(F.size(F.col(extra)) > 0, "extra keys")] if extra else []
    return F.array_compact(F.array(*more, F.when(F.col("_corrupt").isNotNull(), "broken"), F.when(~F.coalesce(F.col("id").rlike(ULID), F.lit(False)), "id"), F.when(~F.coalesce(F.col("kind").isin(*EVENT_KINDS), F.lit(False)), "kind"), F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)), "confidence")))


def ledger_rows(lines: DataFrame) -> DataFrame:
    """Rows of JSON lines (value), whether they come from a file or a stream, with errors: what is wrong with each. Blank lines
    are no rows."""
    row = F.from_json("value", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.where(F.trim("value") != "").select(row.alias("r"), extra_keys(F.col("value")).alias("_extra")).select("r.*", "_extra")
    return rows.withColumn("errors", event_errors("timestamp", "_extra")).drop("_extra")


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid events, rows set aside with their errors) of an append-only JSON lines ledger; blank lines are no rows."""
    rows = ledger_rows(spark.read.text(path))
    return rows.where(F.size("errors") == 0).drop("errors", "_corrupt"), rows.where(F.size("errors") > 0)


def after(ledger: DataFrame, cursor: str) -> DataFrame:
    """Events with larger ids; the comparison reaches the Parquet scan."""
    return ledger.where(F.col("id") > F.lit(cursor))


def by_prefix(prefixes: DataFrame, ledger: DataFrame) -> DataFrame:
    """prefix, id, matches: what each id prefix stands for; null where it is not unique. Ids are cut to the lengths that prefixes have,
    so both sides meet on equal text whatever the ids have in common."""
    asked = prefixes.select("prefix", F.length("prefix").alias("n"))
    # as many lengths as an id has characters, at most
    cut = ledger.select("id").join(F.broadcast(asked.select("n").distinct()), F.length("id") >= F.col("n")).select("id", F.substring("id", F.lit(1), F.col("n")).alias("prefix"))
    n = cut.join(asked.select("prefix").distinct(), "prefix", "left_semi").groupBy("prefix").agg(F.count("*").alias("matches"), F.min("id").alias("id"))
    return prefixes.join(n, "prefix", "left").select("prefix", F.when(F.col("matches") == 1, F.col("id")).alias("id"), F.coalesce("matches", F.lit(0)).alias("matches"))


#: The headings of a page's sections, and the fields that procedure pages have and others have not.
HEADINGS = ("# Compiled truth", "# Timeline", "# Sources")
PROCEDURE_FIELDS = ("status", "success_count", "fail_count")


def front_matter_errors(meta: Column) -> Column:
    """What is wrong with a page's front matter: slug, a missing type or title, an entity without a tier, procedure fields that are
    missing, negative, or on another page."""
    get = lambda k: F.nullif(F.try_element_at(meta, F.lit(k)), F.lit(""))
    procedure = F.coalesce(get("type") == "procedure", F.lit(False))
    counts = [get(k).try_cast("long") for k in PROCEDURE_FIELDS[1:]]
    checks = {
        "slug": ~F.coalesce(T.valid_slug(get("slug")), F.lit(False)),
        "type": get("type").isNull(),
        "title": get("title").isNull(),
        "tier": F.coalesce(get("type") == "entity", F.lit(False)) & ~F.coalesce(get("tier").isin("1", "2", "3"), F.lit(False)),
        "procedure fields": F.when(procedure, get("status").isNull() | T.any_of([F.coalesce(c < 0, F.lit(True)) for c in counts])).otherwise(T.any_of([get(k).isNotNull() for k in (*PROCEDURE_FIELDS, "last_run")])),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())))


def parse_pages(raw: DataFrame) -> DataFrame:
    """raw(path, text) -> front matter, compiled text, timeline and sources of wiki pages, with errors: those of the front matter,
    sections (two or three, under their headings), timeline lines that do not fit."""
    meta, body = split_front_matter(F.col("text"))
    groups = F.transform(F.split(body, r"\n---\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    inner = lambda i: F.regexp_replace(F.regexp_replace(F.coalesce(F.get("groups", F.lit(i)), F.lit("")), r"\A#[^\n]*(?:\n|\z)", ""), r"^\s+|\s+$", "")
    lines = lambda c: F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    out = raw.select("path", meta.alias("frontmatter"), groups.alias("groups"))
    out = out.select("path", "frontmatter", "groups", inner(0).alias("compiled_truth"), lines(inner(1)).alias("timeline"), F.transform(lines(inner(2)), lambda x: F.regexp_replace(x, r"^- ", "")).alias("sources"))
    headed = F.forall(F.transform("groups", lambda g, i: F.coalesce(F.trim(F.substring_index(g, "\n", 1)) == F.get(F.array(*map(F.lit, HEADINGS)), i), F.lit(False))), lambda ok: ok)
    bad_line = ~F.forall("timeline", lambda x: x.rlike(T.TIMELINE_ENTRY))
    more = F.array_compact(F.array(F.when(~F.size("groups").between(2, 3) | ~headed, "sections"), F.when(bad_line, "timeline")))
    return out.withColumn("errors", F.concat(front_matter_errors(F.col("frontmatter")), more)).drop("groups")


def parse_reviews(raw: DataFrame, shape: str | None = None) -> DataFrame:
    """raw(review_id, text) -> kind, status, action, payload, fields and errors of review items.

    payload: the first JSON fence that holds an object, or with `shape` (a field name) the first object that has that field;
    fields: the `- key: value` lines.
    """
    meta, _ = split_front_matter(F.col("text"))
    checked = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:[-*]\s*)?\[[xX]\]\s*(.+?)\s*$"), F.lit(1)), review_action))
    fence = F.regexp_extract_all("text", F.lit(r"(?s)```json\n(.*?)\n```"), F.lit(1))
    fits = F.filter(fence, lambda x: F.array_contains(F.json_object_keys(x), shape) if shape else F.json_object_keys(x).isNotNull())
    bullets = F.filter(F.regexp_extract_all("text", F.lit(r"(?m)^\s*[-*]\s+([A-Za-z_][\w ]*:[ \t]*\S.*?)\s*$"), F.lit(1)), lambda x: ~x.startswith("["))
    fields = F.map_from_entries(F.transform(F.array_distinct(F.transform(bullets, lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))))), lambda k: F.struct(k.alias("k"), F.trim(F.regexp_replace(F.get(F.filter(bullets, lambda b: F.lower(F.trim(F.substring_index(b, ":", 1))) == k), F.lit(0)), "^[^:]*:", "")).alias("v"))))
    out = raw.select("review_id", F.regexp_extract("review_id", r"^\d{4}-\d{2}-\d{2}_\d+_(.+)$", 1).alias("kind"), F.coalesce(F.lower(F.try_element_at(meta, F.lit("status"))), F.lit("pending")).alias("status"), F.when(F.size(checked) == 1, F.get(checked, F.lit(0))).otherwise("none").alias("action"), F.coalesce(F.get(fits, F.lit(0)), F.get(fence, F.lit(0))).alias("payload"), fields.alias("fields"), F.size(checked).alias("_n"))
    broken = F.col("payload").isNotNull() & F.try_parse_json("payload").isNull()
    return out.withColumn("errors", F.array_compact(F.array(F.when(F.col("_n") > 1, "several decisions"), F.when(broken, "payload")))).drop("_n")


def review_action(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.startswith("approve"), "approve").when(low.startswith("reject"), "reject").when(low.startswith("defer"), "defer").otherwise("unknown")


def scratch_entries(raw: DataFrame) -> DataFrame:
    """raw(text) of `## ts - source: x` sections -> pos, ts, source, text; sections without text go."""
    head = r"^## (\S+) - source: ([^\n]*)\n?"
    parts = raw.select(F.posexplode(F.split("text", r"(?m)(?=^## \S+ - source: )")).alias("pos", "part")).where(F.col("part").rlike(r"\A## \S+ - source: "))
    out = parts.select("pos", F.regexp_extract("part", head, 1).alias("ts"), F.trim(F.regexp_extract("part", head, 2)).alias("source"), F.regexp_replace(F.regexp_replace("part", r"\A[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("text"))
    return out.where("text <> ''")
