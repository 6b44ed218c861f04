"""Registry upkeep: merges, pruning, literals, drift, collisions, privacy, lint, status."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators import facts as facts_ops
from tidepool.operators import links as links_ops
from tidepool.operators import registry
from tidepool.operators.tables import cut

PAGE_TYPES = ("entity", "project", "concept", "event", "experience", "conversation", "procedure")


def closed_pairs(pairs: DataFrame, rounds: int = 30) -> DataFrame:
    """loser -> canonical with chains followed to their end; losers in a cycle have a null canonical.

    Each round doubles the length of the chains followed, so 30 rounds are enough for a billion links; it stops when
    nothing moves. Rounds are checkpoints.
    """
    now = pairs.select("loser", "canonical", F.lit(False).alias("cycle"))
    for _ in range(rounds):
        step = now.alias("a").join(now.alias("b"), F.col("a.canonical") == F.col("b.loser"), "left")
        seen = F.coalesce("b.canonical", "a.canonical")
        now = step.select("a.loser", seen.alias("canonical"), (F.col("a.cycle") | F.coalesce(F.col("b.cycle"), F.lit(False)) | (seen == F.col("a.loser"))).alias("cycle"), F.col("b.loser").isNotNull().alias("moved"))
        now = cut(now)
        if now.where("moved and not cycle").isEmpty():
            break
        now = now.drop("moved")
    # whoever still points at a loser leads into a cycle
    losers = pairs.select(F.col("loser").alias("canonical"), F.lit(True).alias("inside")).distinct()
    out = now.select("loser", "canonical", "cycle").join(losers, "canonical", "left")
    return out.select("loser", F.when(~F.col("cycle") & F.col("inside").isNull(), F.col("canonical")).alias("canonical"))


def _remap(df: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    p = pairs.where("canonical is not null").select(F.col("loser").alias(column), F.col("canonical").alias("_to"))
    return df.join(p, column, "left").withColumn(column, F.coalesce("_to", column)).select(*df.columns)


def merge_entities(pairs: DataFrame, entities: DataFrame, aliases: DataFrame, facts: DataFrame, backlinks: DataFrame) -> dict[str, DataFrame]:
    """Merge losers into their canonical entities in all tables; the losers' ids and titles become aliases.

    entities: id, type, title, tier, mention_count, first_seen, last_seen. Mention counts become the number of backlinks.
    """
    closed = closed_pairs(pairs)
    losers = closed.where("canonical is not null")
    ids = entities.select("id", F.col("id").alias("old")).transform(lambda d: _remap(d, "id", closed))
    grouped = ids.join(entities.withColumnRenamed("id", "old"), "old").withColumn("keeps", F.col("id") == F.col("old"))
    merged = grouped.groupBy("id").agg(F.max_by("type", "keeps").alias("type"), F.max_by("title", "keeps").alias("title"), F.min("tier").alias("tier"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    own = entities.join(losers.withColumnRenamed("loser", "id"), "id").select(F.explode(F.array("id", "title")).alias("alias"), F.col("canonical").alias("entity_id"))
    new_aliases = _remap(aliases.select("alias", "entity_id"), "entity_id", closed).unionByName(own).groupBy("alias").agg(F.min("entity_id").alias("entity_id"))
    new_facts = _remap(_remap(facts, "subject", closed), "object", closed)
    new_links = _remap(backlinks, "to_entity", closed).groupBy("from_page", "to_entity", "relation").agg(F.min("line_number").alias("line_number"))
    counted = merged.join(facts_ops.mention_counts(merged, new_links), "id")
    return {"entities": counted, "aliases": new_aliases, "facts": new_facts, "backlinks": new_links, "cycles": closed.where("canonical is null").select("loser")}


def merge_sources(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """page_slug, sources, aliases, tags of pages(page_slug, sources, aliases, tags) after a merge: unions that keep the first place, the
    canonical page's values first, then those of the others by slug."""
    lists = ["sources", "aliases", "tags"]
    p = pages.select(F.col("page_slug").alias("old"), "page_slug", *lists).transform(lambda d: _remap(d, "page_slug", pairs))
    order = F.struct((F.col("old") != F.col("page_slug")).alias("late"), "old", *lists)
    own = p.groupBy("page_slug").agg(F.array_sort(F.collect_list(order)).alias("all"))  # the pages of one merge
    return own.select("page_slug", *(F.array_distinct(F.flatten(F.filter(F.transform("all", lambda x: x[c]), lambda y: y.isNotNull()))).alias(c) for c in lists))  # noqa: B023


def merge_timelines(timeline: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entries of merged pages, one for each (page, date, event), canonical ones first, in order of date and event."""
    t = timeline.withColumn("prio", F.lit(0)).withColumn("old", F.col("page_slug")).transform(lambda d: _remap(d, "page_slug", pairs))
    first = t.groupBy("page_slug", "entry_date", "event_id").agg(F.min(F.struct((F.col("old") != F.col("page_slug")).alias("late"), "pos", "description")).alias("m"))
    return first.select("page_slug", "entry_date", "event_id", F.col("m.description").alias("description"))


def prunable(pages: DataFrame, facts: DataFrame, delete_facts: bool = False) -> DataFrame:
    """Stub pages of entities and concepts that stand alone for their slug and that no fact mentions."""
    one = pages.groupBy("page_slug").agg(F.count("*").alias("n")).where("n = 1").select("page_slug")
    stubs = pages.where(F.col("page_type").isin("entity", "concept") & (F.trim("text") == T.STUB)).join(one, "page_slug", "left_semi")
    if delete_facts:
        return stubs.select("page_slug")
    used = facts.select(F.explode(F.array("subject", "object")).alias("page_slug"))
    return stubs.select("page_slug").join(used, "page_slug", "left_anti")


def prune(slugs: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Rows of slugs removed from entities (id), pages (page_slug), aliases (entity_id), backlinks (both ends), facts (subject)."""
    keys = {"entities": ["id"], "pages": ["page_slug"], "aliases": ["entity_id"], "backlinks": ["from_page", "to_entity"], "facts": ["subject"], "chunks": ["page_slug"]}
    out = {}
    for name, df in tables.items():
        for key in keys[name]:
            df = df.join(slugs.select(F.col("page_slug").alias(key)), key, "left_anti")
        out[name] = df
    return out


def dangling_references(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts whose object is an entity that does not exist."""
    return facts.where("object_type = 'entity'").join(entities.select(F.col("id").alias("object")), "object", "left_anti")


def chosen_facts(facts: DataFrame, ids: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts of the given ids and those whose object does not exist, each once."""
    return facts.join(ids.select("id"), "id", "left_semi").unionByName(dangling_references(facts, entities).select(*facts.columns)).dropDuplicates(["id"])


def literalize(facts: DataFrame, ids: DataFrame, fold_into: str | None = None) -> DataFrame:
    """id, old_object, new_object, new_type of facts whose object is one of ids: their title as a literal, or another entity."""
    f = facts.join(ids.select(F.col("id").alias("object"), F.col("title").alias("_title")), "object")
    new = F.lit(fold_into) if fold_into else F.coalesce("_title", "object")
    return f.select("id", F.col("object").alias("old_object"), new.alias("new_object"), F.lit("entity" if fold_into else "literal").alias("new_type"))


def apply_literals(facts: DataFrame, changes: DataFrame) -> DataFrame:
    c = changes.select("id", "new_object", "new_type")
    return facts.join(c, "id", "left").withColumn("object", F.coalesce("new_object", "object")).withColumn("object_type", F.coalesce("new_type", "object_type")).select(*facts.columns)


def missing_pages(entities: DataFrame, pages: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities without a page and how many facts mention them."""
    ends = facts.select(F.explode(F.array_distinct(F.array("subject", F.when(F.col("object_type") == "entity", F.col("object"))))).alias("id"))
    n = ends.groupBy("id").agg(F.count("*").alias("facts"))
    return entities.select("id", "title").join(pages.select(F.col("page_slug").alias("id")), "id", "left_anti").join(n, "id", "left").select("id", "title", F.coalesce("facts", F.lit(0)).alias("facts"))


def title_collisions(entities: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Normalised titles that several ids have, of entities and of pages(page_slug, title): how many, and the smallest and largest id
    (members by joining back)."""
    entities = entities.select("id", "title")
    if pages is not None:
        entities = entities.unionByName(pages.select(F.col("page_slug").alias("id"), "title"))
    return entities.groupBy(T.normalize_name(F.col("title")).alias("norm_title")).agg(F.count_distinct("id").alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("ids > 1")


def alias_conflicts(claims: DataFrame) -> DataFrame:
    """Normalised aliases that several entities claim. claims: alias, entity_id."""
    n = claims.groupBy(T.normalize_name(F.col("alias")).alias("norm_alias")).agg(F.count_distinct("entity_id").alias("owners"), F.min("entity_id").alias("first_owner"))
    return n.where("owners > 1")


def source_repairs(missing: DataFrame, archived: DataFrame) -> DataFrame:
    """path, repair, candidates: archived names that a missing source may have, `x` or `x_N`; a repair if there is one only."""
    base = lambda c: F.regexp_replace(c, r"_\d+(\.[^.]+)$", "$1")
    a = archived.select(F.col("path").alias("found"), base(F.col("path")).alias("base"))
    n = missing.select("path", base(F.col("path")).alias("base")).join(a, "base", "left").groupBy("path").agg(F.count("found").alias("candidates"), F.min("found").alias("found"))
    return n.select("path", F.when(F.col("candidates") == 1, F.col("found")).alias("repair"), "candidates")


def drift(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """id, state of registry rows against pages: missing row, missing page, changed or same. pages: id, title, tier."""
    both = pages.select("id", F.struct("title", "tier").alias("p")).join(entities.select("id", F.struct("title", "tier").alias("e")), "id", "full_outer")
    return both.select("id", F.when(F.col("e").isNull(), "missing row").when(F.col("p").isNull(), "missing page").when(F.col("p").eqNullSafe(F.col("e")), "same").otherwise("changed").alias("state"))


def rebuilt_entities(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """Registry rows from pages; counts and dates of known rows stay. pages: id, type, title, tier, created."""
    old = entities.select("id", "mention_count", "first_seen", "last_seen")
    return pages.join(old, "id", "left").select("id", "type", "title", "tier", F.coalesce("mention_count", F.lit(0)).alias("mention_count"), F.coalesce("first_seen", "created").alias("first_seen"), F.coalesce("last_seen", "created").alias("last_seen"))


def locally_blocked(path: Column, text: Column, label: Column, local_only: bool = False, globs: tuple[str, ...] = ()) -> Column:
    """Whether a text itself may not be shared: the default forbids it, it holds a secret, its mark or that of its headers is not
    the sharing one, or its path fits a glob, whatever the case."""
    _, mark = registry.provenance(text)
    marks = F.array_compact(F.array(label, mark))
    fits = T.any_of([F.lower(path).rlike(re.sub(r"\(\?s:(.*)\)\\[zZ]", r"^(?s:\1)$", fnmatch.translate(g.lower()))) for g in globs]) if globs else F.lit(False)
    return F.lit(local_only) | F.coalesce(T.contains_secret(text), F.lit(False)) | F.exists(marks, lambda m: m != registry.SHARED) | F.coalesce(fits, F.lit(False))


def _ids(df: DataFrame, name: str) -> DataFrame:
    # a column of its own: the constraints that a checkpoint keeps of its plan can name columns that a union does not know
    return df.select(F.explode(F.array("id")).alias(name))


def external_allowed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, allowed: whether a node and all that it cites, at any distance, may be shared; unknown sources may not.

    nodes: id, blocked (see locally_blocked); edges: id, source. Rounds of pointer doubling: what cites a blocked node is
    blocked and leaves; what cites only nodes that are free of sources is free itself; and where a source cites a single
    node, whoever cites it cites that node instead. So a chain takes as many rounds as its length has binary digits. When
    nothing open cites a blocked node, the rest, cycles included, is allowed. Each round writes the open citations and the
    newly blocked nodes only. Nodes that cite several open sources each take a round a step.
    """
    known = nodes.groupBy("id").agg(F.max(F.coalesce("blocked", F.lit(False))).alias("blocked"))
    edges = edges.select("id", "source").distinct()
    unknown = edges.join(known.select(F.col("id").alias("source")), "source", "left_anti").select("id").distinct()
    front = cut(known.where("blocked").select("id").unionByName(unknown).distinct())
    fronts = [front]
    # sources that are not known have blocked their citers
    open_ = cut(edges.join(front, "id", "left_anti").join(known.select("id"), "id", "left_semi").where("id <> source"))
    while True:
        front = cut(open_.join(front.select(F.col("id").alias("source")), "source", "left_semi").select("id").distinct())
        if front.isEmpty():
            break
        fronts.append(front)
        left = open_.join(front, "id", "left_anti")
        # a source with no citation of its own that is not blocked can block nobody
        live = _ids(left, "source").unionByName(_ids(front, "source")).distinct()
        left = left.join(live, "source", "left_semi")
        single = left.groupBy(F.col("id").alias("source")).agg(F.count("*").alias("n"), F.min("source").alias("next")).where("n = 1").drop("n")
        open_ = cut(left.join(single, "source", "left").select("id", F.coalesce("next", "source").alias("source")).where("id <> source").distinct())
    blocked = reduce(DataFrame.unionByName, (_ids(f, "id") for f in fronts)).distinct()
    return known.select("id").join(blocked.withColumn("hit", F.lit(True)), "id", "left").select("id", F.col("hit").isNull().alias("allowed"))


def stale_pages(pages: DataFrame, timeline: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """Tier-1 pages whose newest dated entry is older than `days`, or that have none."""
    newest = timeline.groupBy("page_slug").agg(F.max(F.try_to_date(F.col("entry_date").cast("string"))).alias("newest"))
    return pages.where("tier = 1").select("page_slug").join(newest, "page_slug", "left").where(F.col("newest").isNull() | (F.col("newest") < F.date_sub(F.to_date(F.lit(as_of)), days)))


def lint(pages: DataFrame, timeline: DataFrame, entities: DataFrame, facts: DataFrame, as_of: str, days: int = 180, page_entities: DataFrame | None = None) -> DataFrame:
    """kind, subject, detail of all issues: contradictions, stale pages, orphan links, citations and, where page_entities (id, title, tier
    as the pages say) are given, registry rows that differ from them."""
    contra = facts_ops.contradictions(facts).select(F.lit("contradictions").alias("kind"), "subject", F.concat("norm_pred", F.lit(": "), F.array_join("objects", ", ")).alias("detail"))
    stale = stale_pages(pages, timeline, as_of, days).select(F.lit("stale").alias("kind"), F.col("page_slug").alias("subject"), F.coalesce(F.col("newest").cast("string"), F.lit("no date")).alias("detail"))
    orphans = links_ops.orphan_links(timeline, entities, pages).select(F.lit("orphans").alias("kind"), F.col("page_slug").alias("subject"), F.concat("reason", F.lit(": "), "target").alias("detail"))
    cited = links_ops.citation_gaps(pages, timeline).select(F.lit("citations").alias("kind"), F.col("page_slug").alias("subject"), F.array_join("missing", ", ").alias("detail"))
    out = contra.unionByName(stale).unionByName(orphans).unionByName(cited)
    if page_entities is None:
        return out
    return out.unionByName(drift(page_entities, entities).where("state <> 'same'").select(F.lit("registry").alias("kind"), F.col("id").alias("subject"), F.col("state").alias("detail")))


def plan_counts(**plan: DataFrame) -> DataFrame:
    """metric, value: how many rows each table of a plan has."""
    counts = [df.agg(F.lit(name).alias("metric"), F.count("*").alias("value")) for name, df in plan.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


def metadata_leaks(pages: DataFrame) -> DataFrame:
    """Pages whose compiled text still holds the header lines of a source."""
    return pages.where(F.col("text").rlike(r"(?m)^source_(?:agent|context):")).select("page_slug")


def reconcile_plan(pages: DataFrame, entities: DataFrame, facts: DataFrame, aliases: DataFrame, missing_sources: DataFrame, archived: DataFrame) -> dict[str, DataFrame]:
    """What differs between pages and registry: registry, aliases, sources, missing_pages, collisions, leaks, stubs, predicates.

    pages: page_slug, title, tier, text, aliases; aliases: alias, entity_id; missing_sources and archived: path.
    """
    claims = pages.select(F.explode("aliases").alias("alias"), F.col("page_slug").alias("entity_id"))
    return {
        "registry": drift(pages.select(F.col("page_slug").alias("id"), "title", "tier"), entities).where("state <> 'same'"),
        "aliases": claims.join(aliases.select("alias", "entity_id"), ["alias", "entity_id"], "left_anti"),
        "sources": source_repairs(missing_sources, archived),
        "missing_pages": missing_pages(entities, pages, facts),
        "collisions": title_collisions(entities, pages),
        "leaks": metadata_leaks(pages),
        "stubs": pages.where(F.trim("text") == T.STUB).select("page_slug"),
        "predicates": facts_ops.predicate_census(facts),
    }


def apply_reconcile(plan: dict[str, DataFrame], pages: DataFrame, entities: DataFrame, facts: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """entities, aliases and facts after a plan: registry rows as the pages say, aliases of pages that one entity claims, canonical
    predicates. Rows without a page stay."""
    rows = pages.join(plan["registry"].where("state in ('missing row', 'changed')").select(F.col("id").alias("page_slug")), "page_slug", "left_semi")
    old = entities.drop("title", "tier")
    new = rows.select(F.col("page_slug").alias("id"), "title", "tier").join(old, "id", "left").select(*entities.columns)
    both, _ = facts_ops.add_aliases(aliases, plan["aliases"].join(plan["aliases"].groupBy("alias").agg(F.count_distinct("entity_id").alias("n")).where("n = 1").select("alias"), "alias").select(*[F.col(c) if c in ("alias", "entity_id") else F.lit(None).alias(c) for c in aliases.columns]))
    named = facts.withColumn("predicate", T.normalize_predicate(F.col("predicate")))
    return {"entities": facts_ops.upsert(entities, new, ["id"]), "aliases": both, "facts": named}


def rebuilt(pages: DataFrame, entities: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """backlinks, registry and index from the pages alone. pages: page_slug, page_type, type, title, tier, created, relative_path, text."""
    from tidepool.sources.sinks import page_index

    links = links_ops.alias_links(links_ops.page_lines(pages), aliases)
    known = rebuilt_entities(pages.withColumn("id", F.col("page_slug")), entities)
    return {"backlinks": links.join(known.select(F.col("id").alias("to_entity")), "to_entity", "left_semi"), "entities": known, "index": page_index(pages)}


def by_type(pages: DataFrame) -> DataFrame:
    """page_type, pages for all seven types."""
    types = pages.sparkSession.createDataFrame([(x,) for x in PAGE_TYPES], "page_type string")
    return types.join(pages.groupBy("page_type").agg(F.count("*").alias("pages")), "page_type", "left").select("page_type", F.coalesce("pages", F.lit(0)).alias("pages"))


def by_tier(entities: DataFrame) -> DataFrame:
    tiers = entities.sparkSession.range(1, 4).select(F.col("id").cast("int").alias("tier"))
    return tiers.join(entities.groupBy("tier").agg(F.count("*").alias("entities")), "tier", "left").select("tier", F.coalesce("entities", F.lit(0)).alias("entities"))


def status(pages: DataFrame, entities: DataFrame, facts: DataFrame, ledger: DataFrame, diff: DataFrame) -> DataFrame:
    """metric, value: one row for each count of the status report."""
    from tidepool.operators.chunks import coverage

    one = lambda df, **cols: df.agg(*(c.cast("double").alias(k) for k, c in cols.items())).unpivot([], [f"`{c}`" for c in cols], "metric", "value")
    rows = by_type(pages).select(F.concat(F.lit("pages."), "page_type").alias("metric"), F.col("pages").cast("double").alias("value"))
    rows = rows.unionByName(by_tier(entities).select(F.concat(F.lit("entities.tier"), F.col("tier").cast("string")).alias("metric"), F.col("entities").cast("double").alias("value")))
    rows = rows.unionByName(one(facts, **{"facts.active": F.count_if(facts_ops.is_active()), "facts.superseded": F.count_if(~facts_ops.is_active())}))
    rows = rows.unionByName(one(ledger, **{"events": F.count("*")}))
    cover = coverage(diff)
    return rows.unionByName(cover.select(*(F.col(c).cast("double").alias(f"index.{c}") for c in cover.columns)).unpivot([], [f"`index.{c}`" for c in cover.columns], "metric", "value"))


def refreshable(pages: DataFrame) -> DataFrame:
    """Pages whose text the engine owns: not curated, and a stub or unchanged since it was written."""
    return pages.where(~F.col("curated") & ((F.col("text") == T.STUB) | (F.col("summary_hash") == F.sha2("text", 256))))


def refreshed(pages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Pages with the summaries(page_slug, summary) of those whose text the engine owns, and the hash of what is written."""
    new = refreshable(pages).select("page_slug").join(summaries.select("page_slug", "summary"), "page_slug")
    out = pages.join(new, "page_slug", "left").withColumn("summary_hash", F.coalesce(F.sha2("summary", 256), "summary_hash")).withColumn("text", F.coalesce("summary", "text"))
    return out.select(*pages.columns)


def line_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, removed, added lines of two versions of texts(key, text)."""
    both = old.select("key", F.split("text", "\n").alias("a")).join(new.select("key", F.split("text", "\n").alias("b")), "key")
    return both.select("key", F.array_except("a", "b").alias("removed"), F.array_except("b", "a").alias("added"))
