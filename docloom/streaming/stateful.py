"""Reviews and evidence as keyed state in a RocksDB store: what a restart finds again, and what can be read back as a table.

Both processors keep only what later rows can change, so rows may come late and in any order: of a review the first opening
and the last decision (which counts if it comes after the opening), of a piece of evidence its last version. They give the
rows that the batch views (state.review_latest, flow.get_evidence) give on the same events.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from docloom.config import EngineConfig

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REVIEWS = "seq long, draft string, status string, final_text string, created_at timestamp, reviewed_at timestamp"


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB, with changes alone in each checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class Reviews(StatefulProcessor):
    def __init__(self, refer_message: str, key: str):
        self.refer_message, self.key = refer_message, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.opened = handle.getValueState("opened", "seq long, ts timestamp, draft string")
        self.decided = handle.getValueState("decided", "seq long, ts timestamp, action string, final_text string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        opened = self.opened.get() if self.opened.exists() else None
        decided = self.decided.get() if self.decided.exists() else None
        before = opened, decided
        for r in rows:
            if r.action == "enqueue" and (opened is None or r.seq < opened[0]):
                opened = (r.seq, r.ts, r.draft)
            elif r.action in ("approve", "replace") and (decided is None or r.seq > decided[0]):
                decided = (r.seq, r.ts, r.action, r.final_text)
        if opened is not before[0]:
            self.opened.update(tuple(opened))
        if decided is not before[1]:
            self.decided.update(tuple(decided))
        if opened is None or (opened, decided) == before:
            return
        seq, ts, draft = opened
        if decided is None or decided[0] <= seq:
            status, text, at = "PENDING", None, None
        else:
            status, at = {"approve": "APPROVED", "replace": "REPLACED"}[decided[2]], decided[1]
            text = decided[3] if decided[2] == "approve" else self.refer_message
        yield Row(**{self.key: key[0]}, seq=seq, draft=draft, status=status, final_text=text, created_at=ts, reviewed_at=at)

    def close(self) -> None:
        pass


def review_updates(events: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """events(request_id, seq, ts, action, draft, final_text) as a stream -> the state of a request, as review_latest() has it,
    each time that a batch changes it (update mode)."""
    kind = dict(events.dtypes)["request_id"]
    processor = Reviews((config or EngineConfig()).refer_message, "request_id")
    rows = events.select("request_id", F.col("seq").cast("long"), F.col("ts").cast("timestamp"), "action", "draft", "final_text")
    return rows.groupBy("request_id").transformWithState(processor, f"request_id {kind}, {REVIEWS}", "Update", "None")


class Evidence(StatefulProcessor):
    """Stored and expired events. An item counts up to the millisecond of its end, so its timer stands one later."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "url string, text string, put long, ends long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.item.get() if self.item.exists() else None
        last = held
        for r in rows:
            if last is None or (r.put, r.ends) >= (last[2], last[3]):
                last = (r.url, r.text, r.put, r.ends)
        if last is held:
            return
        if held is not None:
            self.handle.deleteTimer(held[3] + 1)
        self.item.update(tuple(last))
        # A timer that the watermark has passed would never fire.
        self.handle.registerTimer(max(last[3] + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield Row(**{self.key: key[0]}, url=last[0], text=last[1], event="stored")

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        url, text, _, _ = self.item.get()
        self.item.clear()
        yield Row(**{self.key: key[0]}, url=url, text=text, event="expired")

    def close(self) -> None:
        pass


def evidence_updates(evidence: DataFrame, late: str = "0 seconds") -> DataFrame:
    """evidence(evidence_id, ts, url, text, expires_at) as a stream -> stored events and, once the watermark has passed the end
    of life, expired ones. The item that was put last counts. Items no later than the watermark are too late."""
    kind = dict(evidence.dtypes)["evidence_id"]
    rows = evidence.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("evidence_id", "ts", "url", "text", F.unix_millis("ts").alias("put"), F.unix_millis(F.col("expires_at").cast("timestamp")).alias("ends"))
    return rows.groupBy("evidence_id").transformWithState(Evidence("evidence_id"), f"evidence_id {kind}, url string, text string, event string", "Append", "EventTime")


def read_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A state variable of a stopped or running stream, as its last checkpoint has it: the key's and the value's columns."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()
    return rows.select("key.*", "value.*")


def alive(items: DataFrame, now: dt.datetime) -> DataFrame:
    """Of read_state(..., "item") what hasn't expired by then."""
    return items.where(F.col("ends") >= int(now.replace(tzinfo=now.tzinfo or dt.UTC).timestamp() * 1000))
