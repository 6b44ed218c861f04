"""Streams over the append-only ledger: tail, exactly-once apply, counting, lifecycle, dedup, bad rows, index upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidepool.sources.documents import ledger_rows


def tail(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """The ledger as a stream, each row with its errors; the checkpoint of the query that reads it is the cursor."""
    return ledger_rows(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))


def split_bad(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, rows with errors) of a tail, for two sinks; the same rows as read_ledger gives."""
    return events.where(F.size("errors") == 0).drop("errors", "_corrupt"), events.where(F.size("errors") > 0)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
    return True


def apply_once(stream: DataFrame, key: list[str], out: str, checkpoint: str, apply: Callable[[DataFrame], DataFrame] = lambda df: df, available_now: bool = True, newest: str | None = None) -> StreamingQuery:
    """Append apply(rows) to the table `out`, each key once over all batches and restarts.

    Rows of a batch whose key the table holds are left out, and a batch is its own partition, so a batch that is run again
    overwrites itself. With `newest` (a column that grows with time, as ids do, and is part of the key), only the part of the
    table that can hold a key of the batch is read: batches whose smallest and largest value reach into it.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        new = df.dropDuplicates(key)
        if _exists(spark, out):
            done = spark.read.parquet(out).where(F.col("batch_id") != batch_id)
            if newest:
                low, high = new.agg(F.min(newest), F.max(newest)).first()
                done = done.where(F.col(newest).between(low, high))  # reaches the scan as a pushed filter
            done = done.select(*key)
            new = new.join(done, key, "left_anti")
        apply(new).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def mention_counts(mentions: DataFrame) -> DataFrame:
    """entity_id, mentions as a running count (update mode)."""
    return mentions.groupBy("entity_id").agg(F.count("*").alias("mentions"))


def typed_state(spark: SparkSession) -> None:
    """State of processors is kept in RocksDB with a log of changes. A query that restarts keeps the store its checkpoint names."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class _TierAlerts(StatefulProcessor):
    """Counts of an entity, the counts at which each tier is due, and the last mention in milliseconds."""

    def __init__(self, tier2: int, tier1: int, idle_ms: int | None):
        self.start, self.idle_ms = (0, tier2, tier1, 0), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, at2 long, at1 long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        n, at2, at1, last = self.seen.get() if self.seen.exists() else self.start
        if self.idle_ms and last and last + self.idle_ms <= timerValues.getCurrentWatermarkInMs():
            n, at2, at1, last = self.start  # its timer is due in this batch
        before, turned_down = n, set()
        for r in rows:
            if r.rejected is None:
                n += r.n
            else:
                turned_down.add(r.rejected)
            last = max(last, r.last)
        due = [(key[0], tier, at) for tier, at in ((2, at2), (1, at1)) if before < at <= n]
        again = n + max(10, (n + 1) // 2)
        at2, at1 = (again if tier in turned_down else at for tier, at in ((2, at2), (1, at1)))
        self.seen.update((n, at2, at1, last))
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last + self.idle_ms)
        for entity, tier, at in due:
            yield Row(entity_id=entity, proposed_tier=tier, mentions=at)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.seen.clear()
        return iter(())


def _mentions_of_batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in parts:
        out = b.groupby(["entity_id", "rejected"], dropna=False, as_index=False).agg(n=("entity_id", "size"), at=("at", "max"))
        yield out.assign(rejected=out.rejected.astype("Int32"))


def tier_alerts(mentions: DataFrame, tier2: int = 3, tier1: int = 8, time: str | None = None, idle: timedelta | None = None, late: str = "1 hour") -> DataFrame:
    """entity_id, proposed_tier, mentions: each proposal once, when its count is reached.

    mentions: entity_id of each mention and, where the column is there, rejected: the tier of a proposal that was turned
    down, in a row that counts as no mention. After a rejection at n mentions the tier is proposed again at
    n + max(10, half of n).

    With `time` (a timestamp column) and `idle`, an entity whose last mention lies so long before the watermark (the latest time
    less `late`) is forgotten: a timer clears its state, and it starts anew. Without them state is kept for ever. Mentions are
    counted in each batch of rows before the shuffle, so a hot entity sends a few rows a task. Sets the session's state store.
    """
    if (time is None) != (idle is None):
        raise ValueError("time and idle go together")
    typed_state(mentions.sparkSession)
    rejected = F.col("rejected").cast("int") if "rejected" in mentions.columns else F.lit(None).cast("int")
    at = F.col(time) if time else F.timestamp_seconds(F.lit(0))
    rows = mentions.select("entity_id", rejected.alias("rejected"), at.cast("timestamp").alias("at")).where("entity_id is not null")
    entity = dict(rows.dtypes)["entity_id"]
    counted = rows.mapInPandas(_mentions_of_batches, f"entity_id {entity}, rejected int, n long, at timestamp")
    if time:
        counted = counted.withWatermark("at", late)
    counted = counted.withColumn("last", F.coalesce(F.unix_millis("at"), F.lit(0)))
    processor = _TierAlerts(tier2, tier1, idle and idle // timedelta(milliseconds=1))
    return counted.groupBy("entity_id").transformWithState(processor, f"entity_id {entity}, proposed_tier int, mentions long", "append", "EventTime" if time else "None")


class _Lifecycle(StatefulProcessor):
    """Status and counts of a procedure."""

    def __init__(self, stable_at: int, unstable_at: int):
        self.stable_at, self.unstable_at = stable_at, unstable_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, good long, bad long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        status, good, bad = self.state.get() if self.state.exists() else ("raw", 0, 0)
        for _, ok in sorted((r.seq, r.ok) for r in rows):  # two numbers a run of this batch
            good, bad = good + bool(ok), bad + (not ok)
            if ok:
                status = "tested" if status == "raw" else "stable" if status == "tested" and good >= self.stable_at and not bad else status
            else:
                status = "tested" if status == "stable" and bad >= self.unstable_at else "raw" if status == "tested" and bad > good else status
        self.state.update((status, good, bad))
        yield Row(slug=key[0], status=status, success_count=good, fail_count=bad)


def procedure_states(runs: DataFrame, stable_at: int = 5, unstable_at: int = 2) -> DataFrame:
    """slug, status, success_count, fail_count after the runs(slug, seq, ok) so far; runs of a batch go in order of seq. Sets the
    session's state store."""
    typed_state(runs.sparkSession)
    rows = runs.select("slug", "seq", F.coalesce("ok", F.lit(False)).alias("ok")).where("slug is not null and seq is not null")
    return rows.groupBy("slug").transformWithState(_Lifecycle(stable_at, unstable_at), "slug string, status string, success_count long, fail_count long", "update", "None")


def without_repeats(rows: DataFrame, key: list[str], time: str | None = None, within: str = "7 days") -> DataFrame:
    """Rows whose key was not seen; with a time column only keys of that span are remembered."""
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark(key) if time else rows.dropDuplicates(key)


def maintain_index(touched: DataFrame, checkpoint: str, rebuild: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Call rebuild(distinct touched page slugs, batch id) for every batch."""

    def batch(df: DataFrame, batch_id: int) -> None:
        rebuild(df.select("page_slug").distinct(), batch_id)

    return touched.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
