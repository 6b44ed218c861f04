"""Chunks of pages and the upkeep of their index."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T

KEY = ["page_slug", "chunk_kind", "chunk_id"]


def chunks(pages: DataFrame, timeline: DataFrame, max_chars: int = 1500, model: str = "local", dimension: int = 64) -> DataFrame:
    """One chunk of each page's text (none for stubs and empty texts) and one of each timeline entry, with content hashes."""
    body = F.substring(F.trim("text"), 1, max_chars)
    main = pages.where((F.trim("text") != "") & (F.trim("text") != T.STUB)).select("page_slug", F.lit("compiled_truth").alias("chunk_kind"), F.lit("main").alias("chunk_id"), F.concat("title", F.lit("\n\n"), body).alias("text"), F.substring(body, 1, 200).alias("preview"))
    said = F.substring("description", 1, max_chars)
    entries = timeline.join(pages.select("page_slug", "title"), "page_slug").select("page_slug", F.lit("timeline_entry").alias("chunk_kind"), F.col("event_id").cast("string").alias("chunk_id"), F.concat("entry_date", F.lit(" - "), "title", F.lit(": "), said).alias("text"), F.substring(said, 1, 200).alias("preview"))
    return main.unionByName(entries).withColumn("content_hash", T.content_hash(F.col("text"), model, dimension))


def index_diff(new: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """action of every chunk key: added, updated, unchanged or orphan. Both sides hold the key and content_hash."""
    both = new.select(*KEY, F.col("content_hash").alias("new_hash")).join(index.select(*KEY, F.col("content_hash").alias("old_hash")), KEY, "full_outer")
    same = F.lit(False) if force else F.col("new_hash") == F.col("old_hash")
    return both.withColumn("action", F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "orphan").when(same, "unchanged").otherwise("updated"))


def coverage(diff: DataFrame) -> DataFrame:
    """current, stale, missing, orphaned and the ratio of current to expected chunks (1 when none is expected)."""
    n = {a: F.count_if(F.col("action") == a) for a in ("unchanged", "updated", "added", "orphan")}
    expected = n["unchanged"] + n["updated"] + n["added"]
    return diff.agg(n["unchanged"].alias("current"), n["updated"].alias("stale"), n["added"].alias("missing"), n["orphan"].alias("orphaned"), F.when(expected == 0, 1.0).otherwise(F.round(n["unchanged"] / expected, 6)).alias("ratio"))


def reindex_report(diff: DataFrame, new: DataFrame, private: DataFrame | None = None, usd: float = 0.02) -> DataFrame:
    """scanned, added, updated, removed, unchanged, private, tokens, usd of a run in one row: tokens of what is embedded.

    new: key and text of all chunks; private: page_slug of pages that were left out.
    """
    n = lambda a: F.count_if(F.col("action") == a)
    todo = new.join(diff.where("action in ('added', 'updated')").select(*KEY), KEY, "left_semi").agg(F.coalesce(F.sum(T.approximate_tokens(F.col("text"))), F.lit(0)).alias("tokens"))
    counts = diff.agg(F.count_if(F.col("action") != "orphan").alias("scanned"), n("added").alias("added"), n("updated").alias("updated"), n("orphan").alias("removed"), n("unchanged").alias("unchanged"))
    held = diff.sparkSession.range(1).select(F.lit(0).cast("long").alias("private")) if private is None else private.agg(F.count("*").alias("private"))
    return counts.join(F.broadcast(held)).join(F.broadcast(todo)).withColumn("usd", F.round(F.col("tokens") / 1e6 * usd, 6))


def filtered(new: DataFrame, index: DataFrame, slugs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and index rows of the given pages only; a run over them leaves all others as they are."""
    return new.join(slugs.select("page_slug"), "page_slug", "left_semi"), index.join(slugs.select("page_slug"), "page_slug", "left_semi")


def index_rows(index: DataFrame, page_slug: str) -> DataFrame:
    """A page's chunks by kind and id."""
    return index.where(F.col("page_slug") == page_slug).orderBy("chunk_kind", "chunk_id")


def missing_pages(index: DataFrame, pages: DataFrame) -> DataFrame:
    return index.select("page_slug").distinct().join(pages.select("page_slug"), "page_slug", "left_anti")


def reindexed(index: DataFrame, new: DataFrame, diff: DataFrame, embed: Callable[[pd.Series], pd.Series] | None = None, dimension: int | None = None) -> DataFrame:
    """The index after a run: unchanged rows stay, added and updated chunks are embedded, orphans go; a chunk that could not be embedded
    is not in the index, so the next run adds it.

    index: key, content_hash, embedding; embed takes a series of texts and returns a series of float lists. Only chunks whose
    text changed reach it.
    """
    kept = index.join(diff.where("action = 'unchanged'").select(*KEY), KEY, "left_semi").select(*KEY, "content_hash", "embedding")
    todo = new.join(diff.where("action in ('added', 'updated')").select(*KEY), KEY, "left_semi")
    made = todo.select(*KEY, "content_hash", embedding(F.col("text"), embed, dimension).alias("embedding"))
    return kept.unionByName(made.where("embedding is not null"))


def hashed_embedding(text, dimension: int = 64):
    """A deterministic feature-hash embedding of a text's tokens in expressions alone, for tests and as a default."""
    signs = F.transform(T.tokenize(text), lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dimension)).cast("int").alias("k"), F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("v")))
    zero = F.array_repeat(F.lit(0.0), dimension)
    return F.aggregate(signs, zero, lambda acc, s: F.transform(acc, lambda x, i: x + F.when(i == s["k"], s["v"]).otherwise(0.0))).cast("array<float>")


def embedding(text, embed: Callable[[pd.Series], pd.Series] | None = None, dimension: int | None = None, batch: int = 100, tries: int = 3):
    """The caller's embedding function as an Arrow UDF, or the hashed one.

    Texts go to the function in batches; a batch that fails is tried text by text, each up to `tries` times, and a text that
    still fails, or whose vector has not `dimension` parts, has no embedding: a null, which the next run takes up again.
    """
    return hashed_embedding(text) if embed is None else F.pandas_udf(_in_batches(embed, dimension, batch, tries), "array<float>")(text)


def _in_batches(embed: Callable[[pd.Series], pd.Series], dimension: int | None, batch: int, tries: int) -> Callable[[pd.Series], pd.Series]:
    def fits(v):
        return v if v is not None and (dimension is None or len(v) == dimension) else None

    def one(text):
        for _ in range(tries):
            try:
                return embed(pd.Series([text])).iloc[0]
            except Exception:  # noqa: BLE001, S112 - whatever the caller's function raises counts as this text's failure
                continue
        return None

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for s in range(0, len(texts), batch):
            part = texts.iloc[s : s + batch]
            try:
                got = list(embed(part))
                if len(got) != len(part):
                    raise ValueError("as many vectors as texts")
            except Exception:  # noqa: BLE001
                got = [one(x) for x in part]
            out += [fits(v) for v in got]
        return pd.Series(out, index=texts.index, dtype=object)

    return run


def wrong_dimension(index: DataFrame, dimension: int) -> DataFrame:
    return index.where(F.size("embedding") != dimension)
