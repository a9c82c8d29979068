"""Streams of pages and task events.

Sinks are directories with one ``batch=<id>`` folder per micro-batch. A batch
that is run again overwrites its own folder, and reads only folders of earlier
batches, so every job is idempotent and survives a lost driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import chunks, cleaning, docstore as ds, queues
from ..sources import tables
from .log_table import LogTable


def file_stream(
    spark: SparkSession, path: str, schema, max_files: int | None = None, max_bytes: str | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Parquet files as a stream; the two limits are the back-pressure."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def run_available(stream: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, then stop."""
    (
        stream.writeStream.outputMode(mode).foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )


def batch_sink(root: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return write


def read_log(spark: SparkSession, root: str, schema: str, before: int | None = None) -> DataFrame:
    """All batches of a sink, with their number; none yet gives no rows."""
    fs, path = tables._fs(spark, root)
    if not fs.exists(path):
        return spark.createDataFrame([], f"{schema}, batch int")
    log = spark.read.schema(f"{schema}, batch int").option("basePath", root).parquet(root)
    return log if before is None else log.filter(F.col("batch") < before)


def latest(log: DataFrame, key: list[str]) -> DataFrame:
    """Per key the rows of its last batch. Only key and batch are grouped."""
    last = log.groupBy(*key).agg(F.max("batch").alias("batch"))
    return log.join(last, [*key, "batch"], "left_semi")


# ---- records to store and index ---------------------------------------------

STORED = (
    "document_id bigint, url string, content_hash string, title string, content string, "
    "clean_content string, mimetype string, version int, created_at timestamp, updated_at timestamp"
)
MEMBERS = "site_id string, document_id bigint, created_at timestamp"
CHANGED = "document_id bigint, url string, site_id string, content_hash string, prev_content_hash string, operation string, version int, ts timestamp"
NODES = "node_id string, doc_id string, site_id string, content_hash string, chunk_no int, text string"
LOOKUP = "key string, document_id bigint"
REJECTED = "url string, site_id string, mimetype string, ts timestamp"
DEAD = "url string, site_id string, reason string, content string, ts timestamp, stage string, retry_count int"


@dataclass(frozen=True)
class Site:
    """Where the tables of an ingest live."""

    root: str
    buckets: int = 16
    fan: int = 4

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _log(self, name: str, schema: str, key: tuple[str, ...], bucket: str) -> LogTable:
        return LogTable(self.at(name), schema, key, bucket, self.buckets, self.fan)

    @property
    def documents(self) -> LogTable:
        return self._log("documents", STORED, ("document_id",), "document_id")

    @property
    def members(self) -> LogTable:
        return self._log("members", MEMBERS, ("site_id", "document_id"), "document_id")

    @property
    def nodes(self) -> LogTable:
        return self._log("nodes", NODES, ("doc_id",), "doc_id")

    @property
    def lookup(self) -> LogTable:
        """Documents by ``u:`` and URL, and by ``h:`` and content hash."""
        return self._log("lookup", LOOKUP, ("key", "document_id"), "key")

    def hold(self, df: DataFrame, step: str) -> DataFrame:
        """``df``, written over what the batch before held for ``step``, and read back.

        A cached table would carry its whole plan into every plan above it, and
        the plans of a batch, which the driver keeps, would double with each step.
        """
        path = self.at(f"held/{step}")
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def tables(self) -> list[LogTable]:
        return [self.documents, self.members, self.nodes, self.lookup]


def current_documents(spark: SparkSession, site: Site, before: int | None = None) -> DataFrame:
    return site.documents.current(spark, before)


def current_members(spark: SparkSession, site: Site, before: int | None = None) -> DataFrame:
    return site.members.current(spark, before)


def current_nodes(spark: SparkSession, site: Site) -> DataFrame:
    return site.nodes.current(spark)


def _keys(rows: DataFrame, *columns: str) -> DataFrame:
    """Keys of the look-up table for URLs and content hashes of ``rows``."""
    marks = {"url": "u:", "content_hash": "h:", "prev_content_hash": "h:"}
    keys = F.array(*[F.when(F.col(c) != "", F.concat(F.lit(marks[c]), F.col(c))) for c in columns])
    return rows.select("*", F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))


def _by_keys(site: Site, rows: DataFrame, before: int, step: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(documents, memberships) that rows meet by URL or hash, in narrow columns."""
    ids = site.hold(site.lookup.find(_keys(rows, *columns).select("key"), before).select("document_id").distinct(), f"{step}-ids")
    known = site.documents.find(ids, before, ["document_id", "url", "content_hash", "created_at", "version"])
    return known, site.members.find(ids, before, ["site_id", "document_id", "created_at"])


def unheld(candidates: DataFrame, known: DataFrame, members: DataFrame) -> DataFrame:
    """The (site_id, content_hash) pairs of ``candidates`` that no living member of the site holds."""
    holders = members.join(known.select("document_id", "content_hash"), "document_id").select("site_id", "content_hash").distinct()
    return candidates.join(holders, ["site_id", "content_hash"], "left_anti")


def ingest_batch(site: Site, strategies=cleaning.STRATEGIES) -> Callable[[DataFrame, int], None]:
    """One micro-batch of records (url, site_id, content, mimetype, title, ts, status, crawler_operation).

    A batch looks up the documents it meets by URL or hash in bucketed tables
    and writes only rows that changed. Classifying comes before cleaning and
    indexing, so unchanged pages skip both. A record whose operation is
    ``delete`` removes the document of its URL with its memberships; of all
    records of a URL the last one counts. The nodes of a text belong to all
    documents of a site that hold it and go with the last of them. Records of
    an unsupported type go to ``rejected``, records that lack URL or content
    and records that a strategy fails on to ``dead``; those without a site are
    skipped.
    """

    def apply(records: DataFrame, batch_id: int) -> None:
        spark = records.sparkSession
        records = records.withColumn("content_hash", ds.tx.content_hash(F.col("content"))).persist()
        try:
            routed = ds.precondition(records)
            write = lambda df, name: df.write.mode("overwrite").parquet(f"{site.at(name)}/batch={batch_id}")
            unsupported = (F.coalesce("mimetype", F.lit("")) != "") & (ds.u.mime_class(F.col("mimetype")) == "unsupported")
            fine = routed.filter("route = 'process'")
            write(fine.filter(unsupported).select("url", "site_id", "mimetype", "ts"), "rejected")
            gone = routed.filter("route = 'pass' AND crawler_operation = 'delete' AND url IS NOT NULL")
            last = site.hold(ds.latest_per_url(fine.filter(~unsupported).unionByName(gone).drop("content")), "last")
            todo = last.filter("route = 'process'")
            known, members = _by_keys(site, last, batch_id, "met", "url", "content_hash")
            deleted = last.filter("route = 'pass'").select("url", F.lit(True).alias("_lost"))
            known = site.hold(known.join(deleted, "url", "left"), "known")
            members = site.hold(members.join(known.filter("_lost").select("document_id", "_lost"), "document_id", "left"), "members")
            lost, lost_members = (df.filter("_lost").drop("_lost") for df in (known, members))
            kept, kept_members = (df.filter("_lost IS NULL").drop("_lost") for df in (known, members))
            changes = ds.settle_copies(
                ds.classify(todo.select("url", "site_id", "content_hash", "ts"), kept.drop("version"), kept_members)
            )
            versions = kept.select("document_id", F.col("version").alias("_version"))
            changes = changes.join(versions, "document_id", "left").withColumn(
                "version",
                F.coalesce("_version", F.lit(0)) + F.when(F.col("operation").isin("new", "edit"), 1).otherwise(0),
            )
            write(changes.select("document_id", "url", "site_id", "content_hash", "prev_content_hash", "operation", "version", "ts"), "changes")
            # the written outcome is read back: it is narrow, and nothing is computed twice
            outcome = spark.read.schema(CHANGED).parquet(f"{site.at('changes')}/batch={batch_id}")
            touched = outcome.filter("operation IN ('new', 'new_site', 'edit')").select(
                "url", "document_id", "operation", "prev_content_hash", "version"
            ).join(kept.select("document_id", F.col("created_at").alias("_created")), "document_id", "left")
            # contents are moved once, to the records that need them; records of one URL and hash have one content
            contents = records.filter("content IS NOT NULL").select("url", "content_hash", "content")
            wanted = todo.join(touched, "url").join(contents, ["url", "content_hash"]).dropDuplicates(["url", "content_hash"])
            full, failed = cleaning.clean_or_fail(wanted, strategies, hold=site.hold)
            # what could not be cleaned stays out of the store; its record can be sent again
            failed_urls = failed.select("url")
            outcome = site.hold(outcome.join(failed_urls, "url", "left_anti"), "outcome")
            dead = routed.filter("route = 'error'").select(
                "url", "site_id", "reason", "content", "ts", F.lit("store").alias("stage"), F.lit(0).alias("retry_count"))
            before = read_log(spark, site.at("dead"), DEAD, batch_id).filter("stage = 'clean'").join(
                failed_urls, "url", "left_semi").groupBy("url").agg(F.count("*").cast("int").alias("retry_count"))
            write(dead.unionByName(failed.join(before, "url", "left").select(
                "url", "site_id", F.col("clean_error").alias("reason"), "content", "ts", F.lit("clean").alias("stage"),
                F.coalesce("retry_count", F.lit(0)).alias("retry_count"))), "dead")
            wrote = full.filter("operation IN ('new', 'edit')")
            site.documents.write(
                wrote.select(
                    "document_id", "url", "content_hash", "title", "content", "clean_content", "mimetype", "version",
                    F.coalesce("_created", "ts").alias("created_at"), F.col("ts").alias("updated_at"),
                ),
                batch_id, lost.select("document_id"),
            )
            site.lookup.write(
                _keys(wrote, "url", "content_hash").select("key", "document_id"), batch_id,
                _keys(lost, "url", "content_hash").select("key", "document_id").unionByName(
                    _keys(wrote.filter("operation = 'edit'").select("document_id", "prev_content_hash"), "prev_content_hash")
                    .select("key", "document_id")),
            )
            joined = outcome.filter("document_id IS NOT NULL").select("site_id", "document_id", F.col("ts").alias("created_at"))
            site.members.write(
                joined.groupBy("site_id", "document_id").agg(F.min("created_at").alias("created_at"))
                .join(kept_members, ["site_id", "document_id"], "left_anti"),
                batch_id, lost_members.select("site_id", "document_id"),
            )
            # texts that lost a holder keep their nodes while another document of the site holds them
            edited = outcome.filter("operation = 'edit'").select("document_id", F.col("prev_content_hash").alias("content_hash"))
            left = kept_members.select("site_id", "document_id").unionByName(joined.select("site_id", "document_id")).join(
                edited, "document_id").unionByName(lost_members.select("site_id", "document_id").join(
                    lost.select("document_id", "content_hash"), "document_id")).select("site_id", "content_hash").distinct()
            left = site.hold(left, "left")
            free = left.select(F.concat_ws(":", "site_id", "content_hash").alias("doc_id"))
            if not left.isEmpty():
                others, other_members = _by_keys(site, left, batch_id, "others", "content_hash")
                now = wrote.select("document_id", "content_hash").unionByName(
                    others.join(wrote.select("document_id").unionByName(lost.select("document_id")), "document_id", "left_anti")
                    .select("document_id", "content_hash"))
                now_members = joined.select("site_id", "document_id").unionByName(
                    other_members.join(lost.select("document_id"), "document_id", "left_anti").select("site_id", "document_id")).unionByName(
                    kept_members.select("site_id", "document_id"))
                free = unheld(left, now, now_members).select(F.concat_ws(":", "site_id", "content_hash").alias("doc_id"))
            nodes = chunks.document_nodes(
                full.select("site_id", "content_hash", F.coalesce("clean_content", F.lit("")).alias("text"))
                .dropDuplicates(["site_id", "content_hash"])
            )
            site.nodes.write(nodes.select("node_id", "doc_id", "site_id", "content_hash", "chunk_no", "text"), batch_id, free)
            for table in site.tables():
                table.merge(spark, batch_id)
        finally:
            records.unpersist()

    return apply


def ingest(stream: DataFrame, site: Site, checkpoint: str, strategies=cleaning.STRATEGIES) -> None:
    run_available(stream, ingest_batch(site, strategies), checkpoint)


# ---- dedupe, metrics, sessions ----------------------------------------------

def distinct_tasks(stream: DataFrame, key: list[str], within: str | None = None) -> DataFrame:
    """Each URL once per task. With ``within`` the memory of a URL ends after that time."""
    if within is None:
        return stream.dropDuplicates(key)
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(key)


def live_metrics(stream: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counters per queue and time window, for update mode."""
    return (
        stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("_w"), "queue")
        .agg(*[F.sum(queues.delta(c)).alias(c) for c in queues.DELTAS])
        .select(F.col("_w.start").alias("window_start"), "queue", *queues.DELTAS)
    )


def session_activity(stream: DataFrame) -> DataFrame:
    """Last activity per session, for update mode; expiry is a filter on it."""
    return stream.groupBy("session_id").agg(F.max("ts").alias("last_activity"), F.count(F.lit(1)).alias("events"))


def session_windows(events: DataFrame, gap: str = "24 hours", late: str | None = None) -> DataFrame:
    """Sessions parted by ``gap`` of silence.

    A stream needs ``late``, the time that an event may come late. In append
    mode a session is written once, when the watermark has passed its end by
    ``gap``, and its state goes with it: what is kept are open sessions only.
    """
    rows = events if late is None else events.withWatermark("ts", late)
    return (
        rows.groupBy(F.session_window("ts", gap).alias("_w"), "session_id")
        .agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_activity"))
        .select("session_id", F.col("_w.start").alias("started_at"), "last_activity", "events")
    )


# ---- state per task and per queue -------------------------------------------

TASK_STATE = "status string, prev string, retries bigint, created bigint, started bigint, completed bigint, updated bigint"
TASK_OUT = "task_id string, status string, retry_count bigint, created_at bigint, started_at bigint, completed_at bigint, updated_at bigint"


def _advance(state: list, rows: pd.DataFrame) -> list:
    status, prev, retries, created, started, completed, updated = state
    rows = rows.sort_values(["us", "seq"])
    for event, us in zip(rows["event"].tolist(), rows["us"].tolist()):
        if event != "complete" or prev == "dequeue":
            status, updated = queues.STATUS_AFTER[event], us
            if event == "retry":
                retries += 1
            elif event == "enqueue" and created is None:
                created = us
            elif event == "dequeue":
                started = us
            elif event == "complete":
                completed = us
        prev = event
    return [status, prev, retries, created, started, completed, updated]


def task_states(stream: DataFrame) -> DataFrame:
    """State of each task, updated by every micro-batch; times are in microseconds."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else [None, None, 0, None, None, None, None]
        now = _advance(now, pd.concat(list(batches), ignore_index=True))
        state.update(tuple(now))
        out = pd.DataFrame([[key[0], now[0], *now[2:]]], columns=[
            "task_id", "status", "retry_count", "created_at", "started_at", "completed_at", "updated_at"])
        yield out.astype({c: "Int64" for c in out.columns[2:]})

    rows = stream.select("task_id", "event", "seq", F.unix_micros("ts").alias("us"))
    return rows.groupBy("task_id").applyInPandasWithState(
        update, TASK_OUT, TASK_STATE, "update", GroupStateTimeout.NoTimeout
    )


STALL_STATE = "processing bigint, us bigint"
STALL_OUT = "queue string, seq bigint, gap_seconds double"


def stall_alerts(stream: DataFrame, timeout_seconds: float) -> DataFrame:
    """One alert per check that finds a queue with the same work in hand for too long.

    The input is one row per queue and check, so a queue's state sees few rows.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["us", "seq"])
        before, at = state.get if state.exists else (None, None)
        held = rows["processing"].shift(1)
        times = rows["us"].shift(1)
        if len(rows) and before is not None:
            held.iloc[0], times.iloc[0] = before, at
        gap = (rows["us"] - times) / 1e6
        hit = (rows["processing"] > 0) & (rows["processing"] == held) & (gap > timeout_seconds)
        if len(rows):
            state.update((int(rows["processing"].iloc[-1]), int(rows["us"].iloc[-1])))
        yield pd.DataFrame({"queue": key[0], "seq": rows["seq"][hit], "gap_seconds": gap[hit]})

    rows = stream.select("queue", "seq", F.col("processing").cast("bigint").alias("processing"), F.unix_micros("ts").alias("us"))
    return rows.groupBy("queue").applyInPandasWithState(
        update, STALL_OUT, STALL_STATE, "append", GroupStateTimeout.NoTimeout
    )


def alert_sink(callback: Callable[[dict], None], root: str | None = None) -> Callable[[DataFrame, int], None]:
    """Call back for every alert on the executors, and keep the alerts when ``root`` is given."""

    def each(df: DataFrame, batch_id: int) -> None:
        def run(rows: Iterator) -> None:
            for row in rows:
                callback(row.asDict())

        if root is not None:
            batch_sink(root)(df, batch_id)
        df.foreachPartition(run)

    return each


def dead_letters(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to go on with, rows that failed with reason, payload and time).

    Rows without a site are skipped: they neither go on nor count as failed.
    """
    routed = ds.precondition(records)
    return (
        routed.filter(F.col("route").isin("process", "pass")).drop("route", "reason"),
        routed.filter("route = 'error'").select("url", "site_id", "reason", "content", "ts"),
    )


