"""Queries over facts, entities and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators import assemble, facts, links, maintain
from tidepool.plans.catalog import query
from tidepool.plans.views import Tables

_ENTITY_IDS = "(select id from kb_entities)"


@query("select subject, norm_pred, count(*) as facts, max(asserted_at) as newest from kb_facts where superseded_by is null and valid_to is null group by 1, 2")
def active_facts(t: Tables) -> DataFrame:
    f = facts.active_facts(t.facts()).withColumn("norm_pred", T.normalize_predicate(F.col("predicate")))
    return f.groupBy("subject", "norm_pred").agg(F.count("*").alias("facts"), F.max("asserted_at").alias("newest"))


@query("""with e as (select distinct subject, norm_pred, object from kb_candidates where ord % 97 = 0), g as (select * from kb_candidates where confidence >= 0.8 and valid_to is null),
 x as (select c.*, exists(select 1 from e where e.subject = c.subject and e.norm_pred = c.norm_pred and e.object = c.object) as match_e, exists(select 1 from e where e.subject = c.subject and e.norm_pred = c.norm_pred) as has_e, o.f_obj, k.f_key, k.first_obj from kb_candidates c
 left join (select subject, norm_pred, object, min(ord) as f_obj from g group by 1, 2, 3) o using (subject, norm_pred, object) left join (select subject, norm_pred, min(ord) as f_key, arg_min(object, ord) as first_obj from g group by 1, 2) k using (subject, norm_pred)),
 y as (select *, case when match_e or (not single and coalesce(ord > f_obj, false)) or (single and not has_e and coalesce(ord > f_key, false) and object = first_obj) then 'NOOP' when single and (has_e or coalesce(ord > f_key, false)) then 'CONFLICT' else 'ADD' end as decision from x)
 select ord, norm_pred, decision, case when decision = 'NOOP' then 'noop' when confidence < 0.5 then 'dropped' when confidence < 0.8 then 'low-confidence review' when decision = 'ADD' then 'added' else 'conflict review' end as outcome from y""")
def fact_decisions(t: Tables) -> DataFrame:
    return facts.decide(t.candidates(), t.known()).select("ord", "norm_pred", "decision", "outcome")


@query("select id, subject, norm_pred, object, lead(id) over w as superseded_by, lead(asserted_at) over w as valid_to from kb_facts where single window w as (partition by subject, norm_pred order by asserted_at, id)")
def supersede_chain(t: Tables) -> DataFrame:
    return facts.supersede_chain(t.facts())


@query("select subject, norm_pred, array_to_string(list_sort(list(distinct object)), '|') as objects, count(*) as facts from kb_facts where single and superseded_by is null and valid_to is null group by 1, 2 having count(distinct object) > 1")
def contradictions(t: Tables) -> DataFrame:
    return facts.contradictions(t.facts()).withColumn("objects", F.array_join("objects", "|"))


@query("select predicate, count(*) as facts, max(norm_pred) as canonical from kb_facts where predicate <> norm_pred group by 1")
def predicate_census(t: Tables) -> DataFrame:
    return facts.predicate_census(t.facts())


@query("select name, arg_min(entity_id, prio || entity_id) as entity_id from (select '0' as prio, alias as name, entity_id from kb_aliases union all select '1', title, id from kb_entities union all select '2', id, id from kb_entities) group by 1")
def alias_map(t: Tables) -> DataFrame:
    return facts.alias_map(t.entities(), t.aliases())


@query("""with n as (select id as entity_id, lower(trim(id)) as norm from kb_entities union all select id, lower(trim(title)) from kb_entities union all select entity_id, lower(trim(alias)) from kb_aliases), k as (select norm, count(distinct entity_id) as n, min(entity_id) as id from n group by 1),
 m as (select event_id as mention_id, case when event_id % 3 = 0 then 'NATION_' || (event_id % 30) when event_id % 3 = 1 then 'Customer-' || (event_id % 2000) else 'New Thing ' || (event_id % 500) end as name, event_id % 2 = 0 as typed, (event_id % 100) / 100.0 as confidence from events),
 s as (select *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as slug from m), c as (select replace(trim(regexp_replace(norm, '[^a-z0-9]+', '-', 'g'), '-'), '-', '') as compact, count(distinct entity_id) as n, min(entity_id) as id from n where norm <> '' group by 1)
 select mention_id, name, case when k.n = 1 then k.id when k.n > 1 then null else coalesce(e.id, case when c.n = 1 then c.id end, case when typed and confidence >= 0.85 then slug end) end as entity_id,
 case when k.n > 1 then 'ambiguous' when k.n = 1 or e.id is not null or c.n = 1 then 'matched' when typed and confidence >= 0.85 then 'created' else 'unresolved' end as how from s left join k on k.norm = lower(trim(name)) left join kb_entities e on e.id = slug left join c on c.compact = replace(slug, '-', '')""")
def resolve_names(t: Tables) -> DataFrame:
    """Names made from events resolved against ids, titles and aliases."""
    n, s = F.col("event_id"), lambda k: (F.col("event_id") % k).cast("string")
    name = F.when(n % 3 == 0, F.concat(F.lit("NATION_"), s(30))).when(n % 3 == 1, F.concat(F.lit("Customer-"), s(2000))).otherwise(F.concat(F.lit("New Thing "), s(500)))
    mentions = t.table("events").select(n.alias("mention_id"), name.alias("name"), F.when(n % 2 == 0, "concept").alias("hint_type"), (n % 100 / 100.0).alias("confidence"))
    return facts.resolve(mentions, t.entities(), t.aliases().select("alias", "entity_id"))


@query("select id, coalesce(n, 0) as mention_count from kb_entities left join (select to_entity, count(*) as n from kb_backlinks group by 1) on to_entity = id")
def mention_counts(t: Tables) -> DataFrame:
    return facts.mention_counts(t.entities(), t.backlinks())


@query("""with e as (select * from kb_entities where id not like '%7'), r as (select 'customer-' || o_custkey as id, max(o_orderkey) as last, arg_max(o_orderkey % 3, o_orderkey) as rejected_at from orders where o_orderstatus = 'F' group by 1),
 p as (select distinct 'customer-' || o_custkey as entity_id, (1 + o_orderkey % 2)::int as proposed_tier from orders where o_orderstatus = 'P' and o_orderkey % 50 = 0), x as (select e.id as entity_id, tier as current_tier, case when tier = 3 and mention_count >= 3 then 2 when tier = 2 and mention_count >= 8 then 1 end as proposed_tier, 'mention_count ' || mention_count as reason
 from e left join r using (id) where rejected_at is null or mention_count >= rejected_at + greatest(10, (rejected_at + 1) // 2)) select * from x where proposed_tier is not null and not exists (select 1 from p where p.entity_id = x.entity_id and p.proposed_tier = x.proposed_tier)""")
def tier_proposals(t: Tables) -> DataFrame:
    o, n = t.table("orders"), F.col("o_orderkey")
    who = F.concat(F.lit("customer-"), F.col("o_custkey").cast("string"))
    rejected = o.where("o_orderstatus = 'F'").select(n.alias("id"), who.alias("entity_id"), F.lit(2).alias("proposed_tier"), F.concat(F.lit("mention_count "), (n % 3).cast("string")).alias("reason"), F.lit("rejected").alias("decision"))
    pending = o.where("o_orderstatus = 'P' and o_orderkey % 50 = 0").select(n.alias("id"), who.alias("entity_id"), (1 + n % 2).cast("int").alias("proposed_tier"), F.lit("").alias("reason"), F.lit(None).cast("string").alias("decision"))
    return facts.tier_proposals(t.entities().withColumn("pinned", F.col("id").endswith("7")), rejected.unionByName(pending))


@query("""with l as (select page_slug, page_type, i as line_number, lower(x) as line from (select page_slug, page_type, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from kb_pages)),
 b as (select page_slug, page_type, line_number, regexp_replace(regexp_replace(line, '\\[\\[([^\\]|]+)(\\|([^\\]]+))?\\]\\]', ' ', 'g'), '[\\w.+-]+@[\\w.-]+\\.[a-z]{2,}', ' ', 'g') as line from l),
 h as (select page_slug, page_type, line_number, a.entity_id, a.entity_type from (select page_slug, page_type, line_number, unnest(regexp_extract_all(line, '[a-z0-9_]+')) as word from b) w join kb_aliases a on a.alias = w.word where regexp_matches(a.alias, '^[a-z0-9]+$'))
 select page_slug as from_page, entity_id as to_entity, case when page_type = 'project' and entity_type = 'concept' then 'involves' else 'mentions' end as relation, min(line_number) as line_number from h group by 1, 2, 3
 union all select page_slug, 'doc-' || (doc_id * 7 % 2000), 'mentions', len(string_split(text, chr(10))) from kb_pages""")
def alias_links(t: Tables) -> DataFrame:
    """Links that documents make by naming benchmark words and by [[id]]."""
    return links.alias_links(links.page_lines(t.pages()), t.aliases().where("alias rlike '^[a-z0-9]+$'"))


@query(f"select page_slug, target, 'missing entity' as reason, min(pos) as line from kb_timeline where target not in (select page_slug from kb_timeline) group by 1, 2")
def orphan_links(t: Tables) -> DataFrame:
    users = t.user_pages()
    return links.orphan_links(t.timeline(), users.select(F.col("page_slug").alias("id")), users)


@query("select page_slug, case when 'doc-1' < page_slug then case when page_slug in (select target from kb_timeline y where y.page_slug = x.page_slug) then 'doc-1' else 'doc-1|' || page_slug end end as missing from (select distinct page_slug from kb_timeline) x")
def citation_gaps(t: Tables) -> DataFrame:
    return links.citation_gaps(t.user_pages(), t.timeline()).withColumn("missing", F.array_join("missing", "|"))


@query("select id, subject, object from kb_facts where object_type = 'entity' and object not in (select id from kb_entities where id not like '%3')")
def dangling_refs(t: Tables) -> DataFrame:
    return maintain.dangling_references(t.facts(), t.entities().where("id not like '%3'")).select("id", "subject", "object")


@query("select id, title, coalesce(n, 0) as facts from kb_entities left join (select x, count(*) as n from (select id, subject as x from kb_facts union select id, object from kb_facts where object_type = 'entity') group by 1) on x = id where id not like '%5'")
def missing_pages(t: Tables) -> DataFrame:
    pages = t.entities().where("id like '%5'").select(F.col("id").alias("page_slug"))
    return maintain.missing_pages(t.entities(), pages, t.facts())


@query("select lower(trim(title)) as norm_title, count(distinct id) as ids, min(id) as first_id, max(id) as last_id from kb_entities group by 1 having count(distinct id) > 1")
def title_collisions(t: Tables) -> DataFrame:
    return maintain.title_collisions(t.entities())


@query("select lower(trim(p_name)) as norm_alias, count(distinct p_brand) as owners, min(p_brand) as first_owner from part group by 1 having count(distinct p_brand) > 1")
def alias_conflicts(t: Tables) -> DataFrame:
    return maintain.alias_conflicts(t.table("part").select(F.col("p_name").alias("alias"), F.col("p_brand").alias("entity_id")))


@query("""with m as (select distinct regexp_replace(source || doc_id % 50 || '.md', '_\\d+(\\.[^.]+)$', '\\1') as base, source || doc_id % 50 || '.md' as path from documents), a as (select source || doc_id % 70 || '_' || doc_id % 2 || '.md' as found, source || doc_id % 70 || '.md' as base from documents where doc_id % 3 = 0)
 select path, case when count(found) = 1 then min(found) end as repair, count(found) as candidates from m left join a using (base) group by 1""")
def source_repairs(t: Tables) -> DataFrame:
    d, k = t.table("documents"), F.col("doc_id")
    missing = d.select(F.concat("source", (k % 50).cast("string"), F.lit(".md")).alias("path")).distinct()
    archived = d.where(k % 3 == 0).select(F.concat("source", (k % 70).cast("string"), F.lit("_"), (k % 2).cast("string"), F.lit(".md")).alias("path"))
    return maintain.source_repairs(missing, archived)


@query("""with p as (select 'customer-' || c_custkey as loser, 'customer-' || (c_custkey - c_custkey % 10) as canonical from customer where c_custkey % 10 <> 0), e as (select e.*, coalesce(p.canonical, id) as to_id from kb_entities e left join p on loser = id), f as (select coalesce(p.canonical, subject) as subject from kb_facts left join p on loser = subject)
 select to_id as id, min(tier) as tier, count(*) as members, any_value(n) as facts, max(case when id = to_id then title end) as title from e left join (select subject, count(*) as n from f group by 1) x on x.subject = to_id group by 1""")
def entity_merge(t: Tables) -> DataFrame:
    """Every ten customers merged through a chain of pairs."""
    k = F.col("c_custkey")
    pair = t.table("customer").where(k % 10 != 0).select(F.concat(F.lit("customer-"), k.cast("string")).alias("loser"), F.concat(F.lit("customer-"), (k - 1).cast("string")).alias("canonical"))
    e = t.entities().withColumn("first_seen", F.lit(0)).withColumn("last_seen", F.lit(0))
    out = maintain.merge_entities(pair, e, t.aliases().select("alias", "entity_id"), t.facts(), t.backlinks())
    n = out["facts"].groupBy(F.col("subject").alias("id")).agg(F.count("*").alias("facts"))
    closed = maintain.closed_pairs(pair).groupBy(F.col("canonical").alias("id")).agg((F.count("*") + 1).alias("members"))
    return out["entities"].join(closed, "id", "left").join(n, "id", "left").select("id", "tier", F.coalesce("members", F.lit(1)).alias("members"), "facts", "title")


@query("select 'doc-' || doc_id as page_slug from documents where text is not null and doc_id % 7 in (0, 2) and doc_id % 4 = 0 and 'doc-' || doc_id not in (select subject from kb_facts union select object from kb_facts)")
def prune_stubs(t: Tables) -> DataFrame:
    pages = t.pages().withColumn("text", F.when(F.col("doc_id") % 4 == 0, T.STUB).otherwise(F.col("text")))
    return maintain.prunable(pages, t.facts())


@query("""with recursive n as (select doc_id as id, coalesce(max(toxic) = 1, false) as blocked from documents left join labels using (doc_id) group by 1), e as (select id, id - 1 as source from n where id % 5 <> 0), w as (select id, id as at from n union select w.id, e.source from w join e on e.id = w.at)
 select w.id, not bool_or(coalesce(n.blocked, true)) as allowed from w left join n on n.id = w.at group by 1""")
def privacy_closure(t: Tables) -> DataFrame:
    """Documents that cite the one before, in chains of five; a toxic source blocks what cites it."""
    toxic = t.table("labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("hit")).distinct()
    n = t.table("documents").select(F.col("doc_id").alias("id")).distinct().join(toxic, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("blocked"))
    return maintain.external_allowed(n, n.where("id % 5 <> 0").select("id", (F.col("id") - 1).alias("source")))


@query("""with n as (select doc_id as id, coalesce(max(toxic) = 1, false) as blocked from documents left join labels using (doc_id) group by 1), m as (select min(case when blocked then id end) as first from n)
 select id, not coalesce(id >= first, false) as allowed from n, m""")
def privacy_chain(t: Tables) -> DataFrame:
    """All documents in one chain, each citing the one with the id before: what comes after a toxic one is not shared."""
    toxic = t.table("labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("hit")).distinct()
    n = t.table("documents").select(F.col("doc_id").alias("id")).distinct().join(toxic, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("blocked"))
    before = n.select((F.col("id") + 1).alias("id"), F.col("id").alias("source")).join(n.select("id"), "id", "left_semi")
    return maintain.external_allowed(n, before)


@query("select id, case when r.title is null then 'missing row' when p.title is null then 'missing page' when p.title = r.title and p.tier = r.tier then 'same' else 'changed' end as state from (select id, title, case when id like '%9' then 1 else tier end as tier from kb_entities where id not like '%2') p full join (select id, title, tier from kb_entities where id not like '%4') r using (id)")
def registry_drift(t: Tables) -> DataFrame:
    e = t.entities().select("id", "title", "tier")
    pages = e.where("id not like '%2'").withColumn("tier", F.when(F.col("id").endswith("9"), 1).otherwise(F.col("tier")))
    return maintain.drift(pages, e.where("id not like '%4'"))


_LABELS = "('status','decided','uses','passed','role','location')"


@query(f"""with f as (select subject, id, asserted_at, case when norm_pred in ('role') then 0 when norm_pred = 'status' then 1 else 2 end as g, norm_pred, rtrim(case when norm_pred = 'status' then object else norm_pred || ': ' || coalesce(title, object) end, '。.') as phrase
 from (select f.*, case when object_type = 'entity' then e.title end as title from kb_facts f left join kb_entities e on e.id = f.object) where superseded_by is null and valid_to is null),
 p as (select subject, g, phrase, max(asserted_at || lpad(id::varchar, 12, '0')) as newest from f group by 1, 2, 3), n as (select *, row_number() over (partition by subject, g order by newest desc) as nth from p),
 l as (select subject, g, string_agg(phrase, '; ' order by nth) as text from n where nth <= 3 group by 1, 2), b as (select subject, string_agg(case g when 0 then 'Direction and decisions' when 1 then 'Progress' else 'Implementation' end || ': ' || text || '.', chr(10) || chr(10) order by g) as body from l group by 1),
 o as (select f.subject, count(*) filter (n.nth > 3) as omitted from f join n using (subject, g, phrase) group by 1)
 select subject, sha256(body || case when omitted > 0 then chr(10) || chr(10) || omitted || ' more facts are not listed in this local summary; see the timeline or request a provider draft.' else '' end) as summary from b join o using (subject)""")
def summary_text(t: Tables) -> DataFrame:
    out = facts.summary_paragraphs(t.facts(), t.entities().select("id", "title"), set(T.PREDICATES))
    return out.select("subject", F.sha2("summary", 256).alias("summary"))


@query("""with p as (select page_slug, max(entry_date) as newest from kb_timeline group by 1) select * from (
 select 'contradictions' as kind, count(*) as issues from (select 1 from kb_facts where single and superseded_by is null and valid_to is null group by subject, norm_pred having count(distinct object) > 1)
 union all select 'stale', count(*) from p where newest < '2024-01-30' union all select 'orphans', count(*) from (select distinct page_slug, target from kb_timeline where target not in (select page_slug from kb_timeline)) union all select 'citations', count(*) from p) where issues > 0""")
def lint_counts(t: Tables) -> DataFrame:
    """Issues by kind of all five checks over user pages."""
    users = t.user_pages()
    return maintain.lint(users, t.timeline(), users.select(F.col("page_slug").alias("id")), t.facts(), "2024-02-09", 10).groupBy("kind").agg(F.count("*").alias("issues"))


@query("select page_slug, cast(max(entry_date) as date) as newest from kb_timeline group by 1 having max(entry_date) < '2024-01-30'")
def stale_pages(t: Tables) -> DataFrame:
    return maintain.stale_pages(t.user_pages(), t.timeline(), "2024-02-09", 10)


@query("select 'text-' || doc_id as key, sha256(replace(text, '[[doc-' || (doc_id * 7 % 2000) || ']]', case when (doc_id * 7 % 2000) % 3 = 0 then '[[page-' || (doc_id * 7 % 2000) || '|doc-' || (doc_id * 7 % 2000) || ']]' when (doc_id * 7 % 2000) % 3 = 1 then 'doc-' || (doc_id * 7 % 2000) else '[[doc-' || (doc_id * 7 % 2000) || ']]' end)) as text from kb_pages")
def link_rewrite(t: Tables) -> DataFrame:
    """Links to a third of the documents renamed and to another third made plain text."""
    k = F.col("id")
    ids = t.spark.range(2000)
    renamed = ids.where("id % 3 < 2").select(F.concat(F.lit("doc-"), k.cast("string")).alias("old_id"), F.when(k % 3 == 0, F.concat(F.lit("page-"), k.cast("string"))).alias("new_id"))
    texts = t.pages().select(F.concat(F.lit("text-"), F.col("doc_id").cast("string")).alias("key"), "text")
    return links.rewrite_links(texts, renamed).withColumn("text", F.sha2("text", 256))


@query("select ord, subject || ': ' || replace(norm_pred, '_', ' ') || ' ' || object || '.' as sentence from kb_candidates")
def fact_sentences(t: Tables) -> DataFrame:
    return t.candidates().select("ord", T.fact_sentence(F.col("subject"), F.col("predicate"), F.col("object"), F.lit(False)).alias("sentence"))


@query("""with x as (select 'p' || user_id as slug, event_id as seq, event_type in ('click', 'view', 'purchase') as ok, value from events), c as (select slug, count(*) filter (ok) as success_count, count(*) filter (not ok) as fail_count from x group by 1) select slug, success_count, fail_count from c""")
def procedure_counts(t: Tables) -> DataFrame:
    """Runs of each procedure; the state itself is a fold, tested against a loop."""
    runs = t.table("events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("slug"), F.col("event_id").alias("seq"), F.col("event_type").isin("click", "view", "purchase").alias("ok"))
    return assemble.procedure_states(runs).select("slug", "success_count", "fail_count")
