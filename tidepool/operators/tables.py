"""Tables of the knowledge base: their schemas, reading and writing, checkpoints, and ranks over a whole table."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

_PROCEDURE = "status string, success_count int, fail_count int, last_run timestamp"
#: Table -> (schema, key, checks). Ends of validity stay text, as they may be partial dates.
TABLES: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "entities": ("id string, type string, title string, page_path string, tier int, mention_count int, first_seen timestamp, last_seen timestamp, metadata map<string,string>", ("id",), ("tier in (1, 2, 3)",)),
    "entity_aliases": ("alias string, entity_id string, source string", ("alias",), ("entity_id is not null",)),
    "facts": ("id bigint, subject string, predicate string, object string, object_type string, valid_from string, valid_to string, asserted_at timestamp, source_event string, source_ref string, confidence double, superseded_by bigint", ("id",), ("confidence between 0 and 1",)),
    "backlinks": ("from_page string, to_entity string, relation string, line_number int, extracted_at timestamp", ("from_page", "to_entity", "relation"), ()),
    "tier_proposals": ("id bigint, entity_id string, proposed_tier int, current_tier int, reason string, proposed_at timestamp, decided_at timestamp, decision string, review_file string", ("id",), ("proposed_tier in (1, 2, 3)", "current_tier in (1, 2, 3)")),
    "ingest_cursor": ("source string, last_processed string, last_run_at timestamp", ("source",), ()),
    "lint_results": ("id bigint, run_at timestamp, kind string, issue_count int, report_file string", ("id",), ()),
    "chunks": ("page_slug string, chunk_kind string, chunk_id string, content_hash string, model string, text_preview string, embedding array<float>, created_at timestamp", ("page_slug", "chunk_kind", "chunk_id"), ()),
    "import_jobs": ("id string, source_path string, started_at timestamp, finished_at timestamp, status string, total int, processed int, failed int, estimated_tokens int, estimated_usd double, actual_tokens int, metadata map<string,string>", ("id",), ("status in ('running', 'paused', 'completed', 'failed')",)),
    "import_files": ("job_id string, file_path string, file_hash string, kind string, status string, laundry_path string, error string, processed_at timestamp", ("job_id", "file_path"), ("status in ('pending', 'extracted', 'ingested', 'failed', 'skipped')",)),
    "stats": ("key string, value string, updated_at timestamp", ("key",), ()),
    "pages": (f"type string, slug string, title string, tier int, created timestamp, updated timestamp, tags array<string>, aliases array<string>, external_ids map<string,string>, {_PROCEDURE}, privacy string, curated boolean, summary_hash string, entity_type string, compiled_truth string, timeline array<string>, sources array<string>", ("slug",), ("slug rlike '^[a-z0-9]+(-[a-z0-9]+)*$'",)),
}


def schema(name: str) -> t.StructType:
    return t.StructType.fromDDL(TABLES[name][0])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(schema(name)).parquet(f"{root.rstrip('/')}/{name}")


def shaped(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table in its types; those that df lacks are null, those that the table lacks go."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    shaped(df, name).write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def broken_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows that break a table's checks, with the names of the checks, and keys that stand twice."""
    _, key, checks = TABLES[name]
    twice = df.groupBy(*key).count().where("count > 1").select(*key, F.lit(True).alias("_twice"))
    out = df.join(twice, list(key), "left")
    errors = [F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(c)) for c in checks] + [F.when(F.col("_twice"), F.lit(f"unique ({', '.join(key)})"))]
    return out.withColumn("errors", F.array_compact(F.array(*errors))).where(F.size("errors") > 0).drop("_twice")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that driver and executors share; on one machine without the setting a temporary one is set."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def counted(df: DataFrame, *order: str | Column, name: str = "nth") -> DataFrame:
    """1..n over the whole table in an order, without a task that holds it: ranges are numbered by themselves, after the counts of
    the ranges before. Orders may be structs; ties are numbered as they fall."""
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    # one row for each range
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_nth", nth).join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + F.col("_nth")).drop("_range", "_nth", "_before")
