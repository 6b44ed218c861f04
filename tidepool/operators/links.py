"""Links between pages and entities: extraction from text, orphans, citations, rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators import names

def page_lines(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """page_slug, page_type, line_number (from 1), line."""
    return pages.select("page_slug", "page_type", F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).select("page_slug", "page_type", (F.col("pos") + 1).alias("line_number"), "line")


def contained_aliases(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """page_slug, page_type, line_number, entity_id, entity_type of aliases that stand in lines(..., bare) as they are written."""
    where = ["page_slug", "page_type", "line_number"]
    known = aliases.select(F.col("alias").alias("name"), "entity_id", "entity_type").distinct()
    return names.contained(lines.select(*where, "bare"), known, "bare", None).join(known, "name").select(*where, "entity_id", "entity_type").distinct()


def alias_links(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """from_page, to_entity, relation, line_number: the first line of each link that a page's text makes.

    aliases: alias, entity_id, entity_type. One-word ASCII aliases match whole words whatever the case: both sides are words,
    so this is an equi-join. Others, of any length but none, match as they are written: see contained_aliases. Links and
    e-mail addresses hide what they hold, but [[id]] links count by themselves.
    """
    bare = F.regexp_replace(F.regexp_replace("line", T.WIKILINK, " "), T.EMAIL, " ")
    seen = lines.select("page_slug", "page_type", "line_number", bare.alias("bare"))
    words = aliases.where(F.col("alias").rlike("^[A-Za-z0-9]+$"))
    tokens = seen.select("page_slug", "page_type", "line_number", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("bare"), F.lit("([a-z0-9_]+)"), F.lit(1)))).alias("word"))
    # the first line of a page's word is enough, and is found before the shuffle
    tokens = tokens.groupBy("page_slug", "page_type", "word").agg(F.min("line_number").alias("line_number"))
    hits = tokens.join(words.select(F.lower("alias").alias("word"), "entity_id", "entity_type").distinct(), "word").drop("word")
    held = contained_aliases(seen, aliases.where(~F.col("alias").rlike("^[A-Za-z0-9]+$") & (F.length("alias") >= 1)))
    links = lines.select("page_slug", "page_type", "line_number", F.explode(T.wikilinks(F.col("line"), strip_anchor=False)).alias("entity_id")).withColumn("entity_type", F.lit(None).cast("string"))
    found = hits.select("page_slug", "page_type", "line_number", "entity_id", "entity_type").unionByName(held).withColumn("relation", T.relation(F.col("page_type"), F.coalesce("entity_type", F.lit(""))))
    found = found.unionByName(links.withColumn("relation", F.lit("mentions")))
    return found.groupBy(F.col("page_slug").alias("from_page"), F.col("entity_id").alias("to_entity"), "relation").agg(F.min("line_number").alias("line_number"))


def replace_backlinks(backlinks: DataFrame, pages: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Links of the given pages are replaced by new ones whose target exists."""
    kept = backlinks.join(pages.select(F.col("page_slug").alias("from_page")), "from_page", "left_anti")
    return kept.unionByName(links.join(entities.select(F.col("id").alias("to_entity")), "to_entity", "left_semi").select(*kept.columns))


def orphan_links(timeline: DataFrame, entities: DataFrame, pages: DataFrame) -> DataFrame:
    """page_slug, target, reason, line: timeline links to no entity, or to an entity without a page; the first line of each."""
    links = timeline.select("page_slug", "pos", F.explode(T.wikilinks(F.col("description"))).alias("target"))
    first = links.groupBy("page_slug", "target").agg(F.min("pos").alias("line"))
    known = entities.select(F.col("id").alias("target"), F.lit(True).alias("known"))
    paged = pages.select(F.col("page_slug").alias("target"), F.lit(True).alias("paged"))
    reason = F.when(F.col("known").isNull(), "missing entity").when(F.col("paged").isNull(), "missing page")
    return first.join(known, "target", "left").join(paged, "target", "left").select("page_slug", "target", reason.alias("reason"), "line").where("reason is not null")


def citation_gaps(pages: DataFrame, timeline: DataFrame) -> DataFrame:
    """page_slug, missing: links of the compiled text that no timeline line of the page has."""
    said = pages.select("page_slug", F.explode(F.array_distinct(T.wikilinks(F.col("text")))).alias("target"))
    cited = timeline.select("page_slug", F.explode(T.wikilinks(F.col("description"))).alias("target")).distinct()
    return said.join(cited, ["page_slug", "target"], "left_anti").groupBy("page_slug").agg(F.array_sort(F.collect_list("target")).alias("missing"))


def backlinks_to(backlinks: DataFrame, entity_id: str) -> DataFrame:
    """Links to one entity by page and relation."""
    return backlinks.where(F.col("to_entity") == entity_id).orderBy("from_page", "relation")


def pages_linking(pages: DataFrame, targets: DataFrame) -> DataFrame:
    links = pages.select("page_slug", F.explode(T.wikilinks(F.col("text"))).alias("target"))
    return links.join(targets, "target", "left_semi").select("page_slug").distinct()


def rewrite_links(texts: DataFrame, renamed: DataFrame) -> DataFrame:
    """Links to old ids point to new ones and keep what they show; a null new id leaves only the shown text.

    texts: key, text; renamed: old_id, new_id. Texts are cut at their links, so any number of renames is one join.
    """
    cut = texts.select("key", F.posexplode(F.split("text", r"(?=\[\[)|(?<=\]\])")).alias("pos", "part"))
    target, shown = F.trim(F.regexp_extract("part", T.WIKILINK, 1)), F.regexp_extract("part", T.WIKILINK, 2)
    r = renamed.select(F.col("old_id").alias("target"), F.coalesce("new_id", F.lit("")).alias("new_id"))
    named = cut.withColumn("target", target).withColumn("shown", F.when(shown == "", F.col("target")).otherwise(shown)).join(r, "target", "left")
    new = F.when(F.col("new_id").isNull() | (F.col("target") == ""), F.col("part")).when(F.col("new_id") == "", F.col("shown")).otherwise(F.concat(F.lit("[["), "new_id", F.lit("|"), "shown", F.lit("]]")))
    return named.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", new.alias("part")))), lambda x: x["part"]), "").alias("text"))
