"""Facts: activity, decisions on new candidates, superseding, contradictions, name resolution, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators.tables import counted

REJECT, ACCEPT, CREATE = 0.50, 0.80, 0.85
TIER2_AT, TIER1_AT = 3, 8


def is_active():
    return F.col("superseded_by").isNull() & F.col("valid_to").isNull()


def active_facts(facts: DataFrame) -> DataFrame:
    return facts.where(is_active())


def find_active(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Active facts of (subject, predicate) pairs, predicates compared in canonical form."""
    keys = wanted.select("subject", T.normalize_predicate(F.col("predicate")).alias("norm_pred")).distinct()
    return active_facts(facts).withColumn("norm_pred", T.normalize_predicate(F.col("predicate"))).join(keys, ["subject", "norm_pred"], "left_semi")


def band(confidence, reject: float = REJECT, accept: float = ACCEPT):
    return F.when(confidence < reject, "drop").when(confidence < accept, "review").otherwise("accept")


def decide(candidates: DataFrame, existing: DataFrame, reject: float = REJECT, accept: float = ACCEPT) -> DataFrame:
    """decision (NOOP, ADD, CONFLICT) and outcome of candidates that see each other in order of `ord`.

    candidates: ord, subject, predicate, object, confidence, valid_to; existing: active facts (subject, predicate, object).
    Only accepted candidates without an end become active for later ones. The sequence is resolved with grouped minima:
    what a key holds at any time is the existing facts and the first accepted candidates.
    """
    key, full = ["subject", "norm_pred"], ["subject", "norm_pred", "object"]
    c = candidates.withColumn("norm_pred", T.normalize_predicate(F.col("predicate")))
    held = active_facts(existing).withColumn("norm_pred", T.normalize_predicate(F.col("predicate"))) if "superseded_by" in existing.columns else existing.withColumn("norm_pred", T.normalize_predicate(F.col("predicate")))
    first = c.where((F.col("confidence") >= accept) & F.col("valid_to").isNull())
    c = c.join(held.select(*full).distinct().withColumn("match_e", F.lit(True)), full, "left")
    c = c.join(held.select(*key).distinct().withColumn("has_e", F.lit(True)), key, "left")
    c = c.join(first.groupBy(*full).agg(F.min("ord").alias("f_obj")), full, "left")
    c = c.join(first.groupBy(*key).agg(F.min("ord").alias("f_key"), F.min_by("object", "ord").alias("first_obj")), key, "left")
    one, has, later = T.single_valued(F.col("norm_pred")), F.coalesce("has_e", F.lit(False)), F.coalesce(F.col("ord") > F.col("f_key"), F.lit(False))
    noop = F.coalesce("match_e", F.lit(False)) | (~one & F.coalesce(F.col("ord") > F.col("f_obj"), F.lit(False))) | (one & ~has & later & (F.col("object") == F.col("first_obj")))
    decision = F.when(noop, "NOOP").when(one & (has | later), "CONFLICT").otherwise("ADD")
    c = c.withColumn("decision", decision)
    outcome = F.when(F.col("decision") == "NOOP", "noop").when(F.col("confidence") < reject, "dropped").when(F.col("confidence") < accept, "low-confidence review").when(F.col("decision") == "ADD", "added").otherwise("conflict review")
    return c.withColumn("outcome", outcome).drop("match_e", "has_e", "f_obj", "f_key", "first_obj")


def new_facts(decided: DataFrame, facts: DataFrame) -> DataFrame:
    """Added candidates with ids that continue those of facts, in order of ord, which may be a number or a struct."""
    start = facts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("start"))
    return counted(decided.where("outcome = 'added'"), "ord").join(F.broadcast(start)).withColumn("id", F.col("start") + F.col("nth")).drop("nth", "start")


def supersede(facts: DataFrame, replaced: DataFrame) -> DataFrame:
    """Close facts: replaced(old_id, new_id, valid_to) sets superseded_by, and valid_to where it was open."""
    r = replaced.select(F.col("old_id").alias("id"), "new_id", F.col("valid_to").alias("_to"))
    out = facts.join(r, "id", "left").withColumn("superseded_by", F.coalesce("new_id", "superseded_by")).withColumn("valid_to", F.coalesce("valid_to", F.when(F.col("new_id").isNotNull(), F.col("_to"))))
    return out.select(*facts.columns)


def supersede_chain(facts: DataFrame) -> DataFrame:
    """Each fact of a single-valued predicate is superseded by the next newer one of its subject: id -> superseded_by, valid_to."""
    w = Window.partitionBy("subject", "norm_pred").orderBy("asserted_at", "id")
    f = facts.withColumn("norm_pred", T.normalize_predicate(F.col("predicate"))).where(T.single_valued(F.col("norm_pred")))
    return f.select("id", "subject", "norm_pred", "object", F.lead("id").over(w).alias("superseded_by"), F.lead("asserted_at").over(w).alias("valid_to"))


def contradictions(facts: DataFrame) -> DataFrame:
    """Keys of single-valued predicates that hold several active objects."""
    f = active_facts(facts).withColumn("norm_pred", T.normalize_predicate(F.col("predicate"))).where(T.single_valued(F.col("norm_pred")))
    return f.groupBy("subject", "norm_pred").agg(F.array_sort(F.collect_set("object")).alias("objects"), F.count("*").alias("facts")).where(F.size("objects") > 1)


def predicate_census(facts: DataFrame) -> DataFrame:
    """Spellings that are not canonical, with their canonical form and count."""
    return facts.groupBy("predicate").agg(F.count("*").alias("facts")).withColumn("canonical", T.normalize_predicate(F.col("predicate"))).where("predicate <> canonical")


def alias_map(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """name -> entity_id: aliases first, then titles, then ids; the smallest id keeps a name that several own."""
    rows = aliases.select(F.lit(0).alias("prio"), F.col("alias").alias("name"), "entity_id").unionByName(entities.select(F.lit(1).alias("prio"), F.col("title").alias("name"), F.col("id").alias("entity_id"))).unionByName(entities.select(F.lit(2).alias("prio"), F.col("id").alias("name"), F.col("id").alias("entity_id")))
    # the smallest (prio, id) is combined before the shuffle, however many own a name
    return rows.groupBy("name").agg(F.min(F.struct("prio", "entity_id")).alias("m")).select("name", F.col("m.entity_id").alias("entity_id"))


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, create_at: float = CREATE) -> DataFrame:
    """mentions(mention_id, name, hint_type, confidence) -> entity_id and how: matched, ambiguous, created or unresolved.

    A normalised name that one entity owns is a match, one that several own is not decided. Otherwise the slug, then the
    slug without hyphens decide. What is left is created if it has a type and enough confidence.
    """
    names = entities.select(F.col("id").alias("entity_id"), F.explode(F.array("id", "title")).alias("name")).unionByName(aliases.select("entity_id", F.col("alias").alias("name")))

    def keyed(expr, name):
        k = names.select("entity_id", expr(F.col("name")).alias(name)).where(F.col(name).isNotNull())
        return k.groupBy(name).agg(F.count_distinct("entity_id").alias(f"{name}_n"), F.min("entity_id").alias(f"{name}_id"))

    compact = lambda c: F.replace(T.slug(c), F.lit("-"), F.lit(""))
    m = mentions.withColumn("norm", T.normalize_name(F.col("name"))).withColumn("slug", T.slug(F.col("name"))).withColumn("compact", compact(F.col("name")))
    m = m.join(keyed(T.normalize_name, "norm"), "norm", "left").join(entities.select(F.col("id").alias("slug"), F.col("id").alias("slug_id")), "slug", "left").join(keyed(compact, "compact"), "compact", "left")
    known = F.when(F.col("norm_n") == 1, F.col("norm_id")).when(F.col("norm_n") > 1, None).otherwise(F.coalesce("slug_id", F.when(F.col("compact_n") == 1, F.col("compact_id"))))
    made = F.col("norm_n").isNull() & known.isNull() & F.col("hint_type").isNotNull() & (F.col("confidence") >= create_at) & F.col("slug").isNotNull()
    how = F.when(F.col("norm_n") > 1, "ambiguous").when(known.isNotNull(), "matched").when(made, "created").otherwise("unresolved")
    return m.select("mention_id", "name", F.coalesce(known, F.when(made, F.col("slug"))).alias("entity_id"), how.alias("how"))


def mention_counts(entities: DataFrame, backlinks: DataFrame) -> DataFrame:
    """Backlinks of each entity, 0 where there is none."""
    n = backlinks.groupBy(F.col("to_entity").alias("id")).agg(F.count("*").alias("mention_count"))
    return entities.select("id").join(n, "id", "left").select("id", F.coalesce("mention_count", F.lit(0)).alias("mention_count"))


def tier_proposals(entities: DataFrame, decisions: DataFrame, tier2: int = TIER2_AT, tier1: int = TIER1_AT) -> DataFrame:
    """entity_id, current_tier, proposed_tier, reason. entities: id, tier, mention_count, pinned; decisions: id, entity_id,
    proposed_tier, reason, decision (null while pending).

    After a rejection at n mentions a proposal waits for n + max(10, half of n) mentions; a pending one is not repeated.
    """
    last = decisions.where("decision = 'rejected'").groupBy("entity_id").agg(F.max_by("reason", "id").alias("reason"))
    rejected = last.select(F.col("entity_id").alias("id"), F.try_to_number(F.nullif(F.regexp_extract("reason", r"mention_count (\d+)", 1), F.lit("")), F.lit("9999999999")).cast("long").alias("rejected_at"))
    e = entities.where("not pinned").join(rejected, "id", "left")
    e = e.where(F.col("rejected_at").isNull() | (F.col("mention_count") >= F.col("rejected_at") + F.greatest(F.lit(10), F.floor((F.col("rejected_at") + 1) / 2))))
    proposed = F.when((F.col("tier") == 3) & (F.col("mention_count") >= tier2), 2).when((F.col("tier") == 2) & (F.col("mention_count") >= tier1), 1)
    out = e.select(F.col("id").alias("entity_id"), F.col("tier").alias("current_tier"), proposed.alias("proposed_tier"), F.concat(F.lit("mention_count "), F.col("mention_count").cast("string")).alias("reason")).where("proposed_tier is not null")
    pending = decisions.where("decision is null").select("entity_id", "proposed_tier")
    return out.join(pending, ["entity_id", "proposed_tier"], "left_anti")


def upsert(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows replace those of target with the same key."""
    return target.join(rows.select(*key), key, "left_anti").unionByName(rows)


def add_aliases(aliases: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases with the new ones, conflicts): an alias has one owner; repeating it for its owner does nothing."""
    claims = new.select("alias", "entity_id").unionByName(aliases.select("alias", "entity_id")).groupBy("alias").agg(F.array_sort(F.collect_set("entity_id")).alias("owners"))
    clash = claims.where(F.size("owners") > 1)
    fresh = new.dropDuplicates(["alias"]).join(aliases.select("alias"), "alias", "left_anti").join(clash.select("alias"), "alias", "left_anti")
    return aliases.unionByName(fresh.select(*aliases.columns)), clash


def first_kept(*lists):
    """The union of array columns with each value once, where it stands first; nulls are empty."""
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))


def known_suppression(rows: DataFrame, pending: DataFrame, key: list[str], null_safe: list[str]) -> DataFrame:
    """Rows without a pending twin on a key of which some parts may be null; also unique among themselves."""
    p = pending.select(*(F.col(c).alias(f"_{c}") for c in [*key, *null_safe])).distinct()
    on = [F.col(c) == F.col(f"_{c}") for c in key] + [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in null_safe]
    return rows.dropDuplicates([*key, *null_safe]).join(p, on, "left_anti")


def summary_paragraphs(facts: DataFrame, titles: DataFrame, labels: set[str] | None = None, language: str = "source", context: DataFrame | None = None) -> DataFrame:
    """subject, summary: up to three newest distinct phrases of each topic, topics in a fixed order, and how many facts are left out.

    titles: id, title of entities that objects of type entity may name; labels: predicates that can be phrased (None: those with
    a label). language: zh..., en..., or as the objects and context(subject, text) are. Subjects with facts that cannot be
    phrased only get a sentence that says so.
    """
    known = {k: v[2] for k, v in T.PREDICATES.items()} | T.SUMMARY_LABELS
    f = active_facts(facts).withColumn("p", T.normalize_predicate(F.col("predicate"))).join(titles.select(F.col("id").alias("object"), F.col("title").alias("_title")), "object", "left")
    f = f.withColumn("value", F.when(F.col("object_type") == "entity", F.coalesce("_title", "object")).otherwise(F.col("object")))
    if language.strip().lower().startswith(("zh", "en")):
        f = f.withColumn("zh", T.uses_chinese(F.col("object"), language))
    else:
        said = f.select("subject", F.col("object").alias("text"))
        said = said if context is None else said.unionByName(context.select("subject", "text"))
        f = f.join(said.groupBy("subject").agg(F.bool_or(T.uses_chinese(F.col("text"))).alias("zh")), "subject")
    label, value, p = T.lookup(F.col("p"), known, F.col("p")), F.col("value"), F.col("p")
    chinese = F.when(p == "decided", T.spaced(F.lit("已决定"), value)).when(p.isin(*T.JOINED_LABELS), T.spaced(label, value)).when(p.isin(*T.FRAMEWORKS), T.spaced(F.concat(label, F.lit("使用")), value)).when(p == "released_on", F.concat(F.lit("于 "), value, F.lit(" 发布"))).otherwise(F.concat(label, F.lit("为 "), value))
    phrase = F.rtrim(F.when(p == "status", value).when(F.col("zh"), chinese).otherwise(F.concat(F.replace("p", F.lit("_"), F.lit(" ")), F.lit(": "), value)), F.lit("。."))
    f = f.select("subject", "zh", "id", "asserted_at", F.when(p.isin(*(labels if labels is not None else known)), T.topic(p)).alias("g"), phrase.alias("phrase"))
    newest = f.where("g is not null").groupBy("subject", "zh", "g", "phrase").agg(F.max(F.struct("asserted_at", "id")).alias("at"))
    nth = newest.withColumn("nth", F.row_number().over(Window.partitionBy("subject", "g").orderBy(F.desc("at.asserted_at"), F.desc("at.id"))))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("nth", "phrase"))), lambda x: x["phrase"])
    lines = nth.where("nth <= 3").groupBy("subject", "zh", "g").agg(F.array_join(shown, "; ").alias("en"), F.array_join(shown, "；").alias("cn"))
    heading = lambda k: T.lookup(F.col("g").cast("string"), {str(i): x[k] for i, x in enumerate(T.TOPICS)}, F.lit(""))
    line = F.when(F.col("zh"), F.concat(heading(1), F.lit("："), "cn", F.lit("。"))).otherwise(F.concat(heading(0), F.lit(": "), "en", F.lit(".")))
    body = lines.groupBy("subject").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("body"))
    # a fact beyond the third counts as left out unless its phrase is shown
    kept = nth.where("nth <= 3").select("subject", "g", "phrase", F.lit(1).alias("shown"))
    left = f.join(kept, ["subject", "g", "phrase"], "left").groupBy("subject", "zh").agg(F.count_if(F.col("shown").isNull()).alias("omitted"), F.count("*").alias("facts"))
    say = lambda texts, n: F.when(F.col("zh"), F.replace(F.lit(texts[1]), F.lit("{}"), n.cast("string"))).otherwise(F.replace(F.lit(texts[0]), F.lit("{}"), n.cast("string")))
    more = F.when(F.col("omitted") > 0, F.concat(F.lit("\n\n"), say(T.OMITTED, F.col("omitted")))).otherwise("")
    return left.join(body, "subject", "left").select("subject", F.when(F.col("body").isNull(), say(T.UNSUPPORTED, F.col("facts"))).otherwise(F.concat("body", more)).alias("summary"))


def recent_said(timeline: DataFrame, n: int = 5) -> DataFrame:
    """page_slug, summary: the last n distinct texts of a page's timeline, newest first, for pages without facts."""
    last = timeline.groupBy("page_slug", "description").agg(F.max("pos").alias("pos")).where(F.trim("description") != "")
    nth = last.withColumn("nth", F.row_number().over(Window.partitionBy("page_slug").orderBy(F.desc("pos")))).where(F.col("nth") <= n)
    return nth.groupBy("page_slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "description"))), lambda x: x["description"]), "\n").alias("summary"))
