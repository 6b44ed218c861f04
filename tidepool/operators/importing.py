"""Bulk import: duplicates by content, cost, job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: US dollars for a million tokens of extraction and of embedding.
EXTRACT_USD, EMBED_USD = 3.00, 0.02
FINAL = ("extracted", "ingested", "failed", "skipped")


def is_known(status: Column, aborted: Column) -> Column:
    """Whether an earlier file counts as imported: finished ones always, others unless their job was aborted."""
    return status.isin("extracted", "ingested") | ~F.coalesce(aborted, F.lit(False))


def new_files(files: DataFrame, earlier: DataFrame) -> DataFrame:
    """Files whose content no earlier job holds. earlier: file_hash, status, aborted."""
    return files.join(earlier.where(is_known(F.col("status"), F.col("aborted"))).select("file_hash"), "file_hash", "left_anti")


def duplicate_report(files: DataFrame) -> DataFrame:
    """file_hash, copies, first_path of contents that stand in several files."""
    return files.groupBy("file_hash").agg(F.count("*").alias("copies"), F.min("file_path").alias("first_path")).where("copies > 1")


def cost_estimate(files: DataFrame) -> DataFrame:
    """kind, files, extract_tokens, embed_tokens, usd. files: kind, size in bytes."""
    tokens = F.sum(F.greatest(F.lit(1), F.ceil(F.col("size") / 4))) + 500 * F.count("*")
    cost = files.groupBy("kind").agg(F.count("*").alias("files"), tokens.cast("long").alias("extract_tokens"), (1000 * F.count("*")).alias("embed_tokens"))
    return cost.withColumn("usd", F.round(F.col("extract_tokens") / 1e6 * EXTRACT_USD + F.col("embed_tokens") / 1e6 * EMBED_USD, 6))


def estimated_documents(files: DataFrame) -> Column:
    """Documents that a file will give: 1 for pdf and jsonl and for short texts, else one for each heading."""
    heads = F.regexp_count("text", F.lit(r"(?m)^#{1,6}\s+.+$"))
    return F.when(F.col("kind").isin("pdf", "jsonl") | (F.length("text") <= 8000), 1).otherwise(F.greatest(F.lit(1), heads))


def current_states(log: DataFrame) -> DataFrame:
    """Latest status of each (job_id, file_path) of an append-only log(job_id, file_path, seq, status, error)."""
    return log.groupBy("job_id", "file_path").agg(F.max_by("status", "seq").alias("status"), F.max_by("error", "seq").alias("error"))


def job_counters(states: DataFrame) -> DataFrame:
    """job_id, total, processed, failed, status of each job."""
    n = states.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(*FINAL)).alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return n.withColumn("status", F.when(F.col("processed") < F.col("total"), "running").when(F.col("failed") == 0, "completed").otherwise("failed"))


def failures(states: DataFrame, n: int = 20) -> DataFrame:
    """The first n failed files of each job by path, for its report."""
    from tidepool.operators.retrieval import ranked

    return ranked(states.where("status = 'failed'"), "job_id", F.asc("file_path"), top=n).select("job_id", "file_path", "error", "rank")


def registered(files: DataFrame, job_id: str, seq: int = 0) -> DataFrame:
    """Log rows of a job's files when it begins: all pending."""
    return _logged(files.select("file_path"), job_id, seq, F.lit("pending"))


def marked(outcomes: DataFrame, job_id: str, seq: int) -> DataFrame:
    """Log rows of what became of files: outcomes(file_path, status, error)."""
    return _logged(outcomes.select("file_path", "status", "error"), job_id, seq, F.col("status"), F.col("error"))


def _logged(rows: DataFrame, job_id: str, seq: int, status: Column, error: Column | None = None) -> DataFrame:
    return rows.select(F.lit(job_id).alias("job_id"), "file_path", F.lit(seq).cast("long").alias("seq"), status.alias("status"), (F.lit(None) if error is None else error).cast("string").alias("error"))


def new_job(files: DataFrame, job_id: str, source_path: str, at: str) -> DataFrame:
    """The row of a job over files(kind, size): running, with its totals and estimates."""
    cost = cost_estimate(files).agg(F.coalesce(F.sum("files"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("extract_tokens") + F.col("embed_tokens")), F.lit(0)).alias("estimated_tokens"), F.coalesce(F.round(F.sum("usd"), 6), F.lit(0.0)).alias("estimated_usd"))
    return cost.select(F.lit(job_id).alias("job_id"), F.lit(source_path).alias("source_path"), F.lit(at).alias("started_at"), F.lit("running").alias("status"), "total", "estimated_tokens", "estimated_usd")


def finished(jobs: DataFrame, log: DataFrame, at: str) -> DataFrame:
    """Jobs with the counters and status that their log gives; those without an open file are finished at `at`."""
    now = job_counters(current_states(log)).select("job_id", "processed", "failed", F.col("status").alias("_s"))
    out = jobs.join(now, "job_id", "left").withColumn("status", F.coalesce("_s", "status"))
    return out.withColumn("finished_at", F.when(F.col("status").isin("completed", "failed"), F.lit(at))).drop("_s")


def resumed(files: DataFrame, log: DataFrame, job_id: str) -> DataFrame:
    """Files of a job that are still to be done: pending ones, and those that failed."""
    open_ = current_states(log).where((F.col("job_id") == job_id) & F.col("status").isin("pending", "failed"))
    return files.join(open_.select("file_path"), "file_path", "left_semi")


def job_files(log: DataFrame, job_id: str, statuses: list[str] | None = None) -> DataFrame:
    """Files of a job and their states, by path."""
    out = current_states(log).where(F.col("job_id") == job_id)
    return (out.where(F.col("status").isin(statuses)) if statuses else out).orderBy("file_path")


def dry_counts(files: DataFrame, earlier: DataFrame) -> DataFrame:
    """files, documents, tokens, usd of what an import would do."""
    fresh = new_files(files, earlier)
    cost = cost_estimate(fresh).agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum(F.col("extract_tokens") + F.col("embed_tokens")), F.lit(0)).alias("tokens"), F.coalesce(F.round(F.sum("usd"), 6), F.lit(0.0)).alias("usd"))
    return cost.join(F.broadcast(fresh.agg(F.coalesce(F.sum(estimated_documents(fresh)), F.lit(0)).alias("documents"))))


def latest_unfinished(jobs: DataFrame) -> DataFrame:
    """The newest job that can be taken up again. jobs: job_id, seq, started_at, status, aborted."""
    return jobs.where(F.col("status").isin("running", "paused", "failed") & ~F.coalesce("aborted", F.lit(False))).orderBy(F.desc("started_at"), F.desc("seq")).limit(1)


def aborted(log: DataFrame, job_id: str, seq: int) -> DataFrame:
    """Log rows that skip every unfinished file of a job."""
    open_ = current_states(log).where((F.col("job_id") == job_id) & ~F.col("status").isin(*FINAL))
    return open_.select("job_id", "file_path", F.lit(seq).cast("long").alias("seq"), F.lit("skipped").alias("status"), F.lit("aborted").alias("error"))


def import_files(files: DataFrame, earlier: DataFrame, max_usd: float | None = None) -> DataFrame:
    """New files with their document estimate; an estimate above max_usd is an error before any work."""
    fresh = new_files(files, earlier)
    if max_usd is not None:
        total = cost_estimate(fresh).agg(F.coalesce(F.sum("usd"), F.lit(0.0))).first()[0]
        if total > max_usd:
            raise ValueError(f"estimated cost {total:.2f} USD is above {max_usd:.2f}")
    return fresh.withColumn("documents", estimated_documents(fresh))
