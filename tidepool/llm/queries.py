"""The registered queries of this subpackage, thin over its operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out():
    """Rows kept from training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.line_dedup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents"), exact_chars=1)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm import quality
    from tidepool.llm._shared import written

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    stats = written(quality.document_statistics(docs), "statistics")
    model = quality.train(stats, labels.where(~_held_out()).select("doc_id", F.col("quality").alias("label")))
    return quality.score(stats, model).select("doc_id", _held_out().alias("held_out"), "score", "predicted")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm import language_id

    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~_held_out()))
    return language_id.identify(docs, model, carry=()).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.decontamination import benchmark_overlaps

    return benchmark_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), any_length=True)


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.pseudonyms import pseudonymise_documents

    # a key for this test; production passes its own
    out = pseudonymise_documents(_table(spark, sf_dir, "documents"), b"key of the registered test query")
    return out.select("doc_id", "text", F.size("found").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["kind"]))), ",").alias("kinds"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.substring_dedup import dedup_substrings

    out = dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.embedding_dedup import dedup_embeddings

    return dedup_embeddings(_table(spark, sf_dir, "embeddings"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidepool.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidepool.llm.token_files import token_files

    return token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.spelling import spelling_variants

    # every 199th word of a document loses a letter, so that there are variants to find
    return spelling_variants(_table(spark, sf_dir, "documents"), noise=199)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_classifier, op3_license_scan, op4_substring_dedup, op5_language_id, op6_decontamination, op7_embedding_dedup, op8_pseudonyms, op9_best_fit_packing, op10_ngram_jaccard_join, op11_token_files, op12_spelling_variants, op13_collocations)}
#: SQL can express three of them on small tables; the others have models, tokenizers, edit distances or templates.
_COMPONENTS = """r as (select a as node, b as seen from bi union select r.node, bi.b from r join bi on bi.a = r.seen), c as (select node, min(seen) as least from r group by 1)"""
_CAPITALS = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES: dict[str, str] = {
    "op4_substring_dedup": r"""with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words from documents),
 p as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from w),
 x as (select doc_id, i, md5(array_to_string(list_slice(words, i, i + 19), ' ')) as h from (select doc_id, words, unnest(range(1, len(words) - 18)) as i from w)),
 f as (select h, min(doc_id * 10000000 + i) as first from x group by h), d as (select x.doc_id, x.i from x join f using (h) where x.doc_id * 10000000 + x.i > f.first),
 g as (select distinct doc_id, i + j as i from d, (select unnest(range(20)) as j)), k as (select p.doc_id, count(g.i) as n_removed, coalesce(string_agg(word, ' ' order by p.i) filter (g.i is null), '') as kept from p left join g using (doc_id, i) group by 1)
 select doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (doc_id)""",
    "op7_embedding_dedup": f"""with recursive e as (select vec_id, label, embedding::double[] as v, label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as sound from embeddings),
 l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id < b.vec_id and len(a.v) = len(b.v) where a.sound and b.sound and list_cosine_similarity(a.v, b.v) >= 0.98), bi as (select a, b from l union all select b, a from l), {_COMPONENTS},
 n as (select a as vec_id, count(*) as n from bi group by 1) select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(least, vec_id)) as component_id, vec_id <= coalesce(least, vec_id) as kept from e left join n using (vec_id) left join c on node = vec_id""",
    "op12_spelling_variants": rf"""with recursive t as (select list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
 r as (select doc_id, unnest(regexp_extract_all({_CAPITALS}, '[a-zÀ-ÿ]+')) as run from documents), d as (select doc_id, run, count(*) as n from r where length(run) >= 6 group by 1, 2),
 h as (select run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda ch: case when unicode(ch) < 128 then [unicode(ch)::bigint] else [195::bigint, 128 + (unicode(ch) & 63)] end))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) as h from d, t),
 w as (select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(n)::bigint as n from h group by 1 having sum(n) >= 5 and length(word) >= 6),
 i as (select word, n, unnest(range(length(word)))::int as i from w), k as (select word, n, i, left(word, i) || '*' || substr(word, i + 2) as k, left(word, i) || substr(word, i + 2) as s from i),
 e as (select a.word as a, b.word as b from k a join k b on a.k = b.k and a.word <> b.word union select k.word, w.word from k join w on w.word = k.s union select w.word, k.word from k join w on w.word = k.s),
 b as (select a, count(*) as n_near, max_by(w.word, [w.n, -rank]) as best from e join (select word, n, row_number() over (order by word) as rank from w) w on w.word = e.b group by 1),
 f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when v.n >= 5 * w.n then v.word end as form, case when v.n >= 5 * w.n then v.n end as form_n from w left join b on b.a = w.word left join w v on v.word = b.best),
 u as (select word, word as root, 0 as steps from f union all select u.word, f.form, steps + 1 from u join f on f.word = u.root where f.form is not null)
 select f.word, form, max_by(root, steps) as root, n, n_near, form_n from f join u using (word) group by all""",
    "op13_collocations": rf"""with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({_CAPITALS}, '[.,;:!?\x0A-\x0D]')) as piece from documents), w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
 s as (select lang, words, unnest(range(1, len(words) + 1))::int as i from w), g as (select lang, words[i : i + m - 1] as p, m from s, (select unnest(range(1, 5))::int as m) where i + m - 1 <= len(words)),
 f as (select lang, p, m, count(*) as a from g group by all), n as (select lang, sum(a)::bigint as n from f where m = 1 group by 1), c as (select * from f where m > 1 and a >= 30),
 k as (select c.lang, c.p, c.a, x.a as l, y.a as r, k, (2000000::hugeint * c.a) // (x.a + y.a) as score from (select *, unnest(range(1, m))::int as k from c) c join f x on x.lang = c.lang and x.p = c.p[1 : k] join f y on y.lang = c.lang and y.p = c.p[k + 1 : c.m]),
 b as (select *, row_number() over (partition by lang, p order by score, k) as nth from k),
 d as (select distinct c.lang, c.p from (select lang, p[i : i + j - 1] as p, a from (select lang, p, a, m, j, unnest(range(1, m - j + 2))::int as i from (select *, unnest(range(2, m))::int as j from c))) q join c on c.lang = q.lang and c.p = q.p where 100 * q.a >= 80 * c.a),
 o as (select b.lang, array_to_string(b.p, ' ') as phrase, a, l, r, score from b left join d on d.lang = b.lang and d.p = b.p where nth = 1 and d.p is null)
 select lang, rank, phrase, a, l, r, n, score::bigint as score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from o) join n using (lang) where rank <= 2000""",
    "op10_ngram_jaccard_join": rf"""with recursive w as (select doc_id, coalesce(regexp_extract_all({_CAPITALS}, '[^\x20\x09-\x0D]+'), []) as words from documents),
 s as (select distinct doc_id, md5(array_to_string(list_slice(words, i, i + 2), ' ')) as g from (select doc_id, words, unnest(range(1, greatest(2, len(words) - 1))) as i from w where len(words) > 0)), z as (select doc_id, count(*) as n from s group by 1),
 m as (select a.doc_id as a, b.doc_id as b, count(*) as n from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2), l as (select m.a, m.b from m join z x on x.doc_id = m.a join z y on y.doc_id = m.b where 100 * m.n >= 90 * (x.n + y.n - m.n)),
 bi as (select a, b from l union all select b, a from l), {_COMPONENTS} select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(least, doc_id)) as component_id from w left join z using (doc_id) left join c on node = doc_id""",
}
