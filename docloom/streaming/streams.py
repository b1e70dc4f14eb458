"""Streams: audit windows, realtime ingest, evidence with an end of life, review states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.sources.files import delete_path, file_system, path_exists


def audit_windows(audit: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """audit(ts, event) -> counts per window and event; events later than `late` are left out."""
    rows = audit.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window).alias("w"), "event").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event", "n")


def audit_sessions(audit: DataFrame, gap: str = "10 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    rows = audit.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def ingest(documents: DataFrame, chunks: Callable[[DataFrame], DataFrame], add: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch of documents is chunked and appended. A batch comes again after a failure, so `add` must leave
    out chunks that are there already (KnowledgeBase.add with new_only does)."""

    def batch(frame: DataFrame, number: int) -> None:
        made = chunks(frame)
        if not made.limit(1).isEmpty():
            add(made)

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(documents: DataFrame, key: str = "doc_id", ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """Documents whose key came before within the time are left out."""
    return documents.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def upsert_latest(events: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last event of each key in a table under path, a version for each micro-batch: a batch that comes again
    writes its version again, from the version before."""
    spark = events.sparkSession

    def batch(frame: DataFrame, number: int) -> None:
        before = f"{path}/{number - 1}"
        rows = frame.unionByName(spark.read.schema(frame.schema).parquet(before)) if path_exists(spark, before) else frame
        latest_by_key(rows, key, order).select(*frame.columns).write.mode("overwrite").parquet(f"{path}/{number}")
        delete_path(spark, f"{path}/{number - 2}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version of such a table."""
    system, at = file_system(spark, path)
    versions = [int(x.getPath().getName()) for x in system.listStatus(at) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{path}/{max(versions)}")


def _evidence(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        url, text, _ = state.get
        state.remove()
        yield pd.DataFrame({"evidence_id": [key[0]], "url": [url], "text": [text], "event": ["expired"]})
        return
    for frame in frames:
        row = frame.sort_values("ends").iloc[-1]
        end = int(row["ends"])
        state.update((row["url"], row["text"], end))
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"evidence_id": [key[0]], "url": [row["url"]], "text": [row["text"]], "event": ["stored"]})


def evidence_lifetimes(evidence: DataFrame, late: str = "0 seconds") -> DataFrame:
    """evidence(evidence_id, ts, url, text, expires_at) -> stored and, once the watermark passes the end of life,
    expired events. The last item of an id counts."""
    # The end of life as a number: pandas would show the time without its zone.
    rows = evidence.withWatermark("ts", late).withColumn("ends", F.unix_millis(F.col("expires_at").cast("timestamp")))
    return rows.groupBy("evidence_id").applyInPandasWithState(
        _evidence, "evidence_id long, url string, text string, event string", "url string, text string, expires long", "append", GroupStateTimeout.EventTimeTimeout
    )


def _review(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, seq = state.get if state.exists else ("", -1)
    for row in pd.concat(list(frames)).sort_values("seq").itertuples():
        if row.action == "enqueue" and not status:
            status, seq = "PENDING", row.seq
        elif status and row.action in ("approve", "replace") and row.seq > seq:
            status, seq = {"approve": "APPROVED", "replace": "REPLACED"}[row.action], row.seq
    state.update((status, int(seq)))
    if status:
        yield pd.DataFrame({"request_id": [key[0]], "status": [status], "seq": [int(seq)]})


def review_states(events: DataFrame) -> DataFrame:
    """events(request_id, seq, action) -> a row with the state of every request that a batch touches."""
    return events.groupBy("request_id").applyInPandasWithState(_review, "request_id long, status string, seq long", "status string, seq long", "update", GroupStateTimeout.NoTimeout)


def latest_by_key(events: DataFrame, key: str, order: str) -> DataFrame:
    """For foreachBatch upserts: the last row of each key."""
    columns: list[Column] = [F.col(c) for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")
