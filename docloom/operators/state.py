"""Review, exposure and audit as event logs with views of the latest state.

Nothing is updated in place: each change is an appended event with a key and an order, and the state of a key is
an aggregate over its events (combined before the shuffle, so a key with many events isn't gathered anywhere).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import EngineConfig

#: The events of the audit trail and the fields of their payloads (fixed values).
AUDIT_EVENTS = {
    "query_received": ("user_id", "len"),
    "query_deidentified": ("abstract",),
    "local_retrieval_done": ("hits", "top_score", "theta"),
    "external_retrieval_triggered": ("used",),
    "external_retrieval_skipped": (),
    "draft_generated": ("chars",),
    "queued_for_human_review": ("task_id", "unsuitable"),
    "delivered_to_patient": ("chars",),
}


def review_latest(events: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """events(request_id, seq, ts, action, draft, final_text) with actions enqueue, approve, replace ->
    (request_id, seq, draft, status, final_text, created_at, reviewed_at): a request's first enqueue opens its
    task; the latest decision after it counts, whatever came before. A replaced answer is the refer message."""
    config = config or EngineConfig()
    opened = events.where("action = 'enqueue'").groupBy("request_id").agg(F.min_by(F.struct("seq", "ts", "draft"), "seq").alias("o"))
    decided = events.where("action IN ('approve', 'replace')").join(opened, "request_id").where(F.col("seq") > F.col("o.seq"))
    latest = decided.groupBy("request_id").agg(F.max_by(F.struct("action", "ts", "final_text"), "seq").alias("d"))
    rows = opened.join(latest, "request_id", "left")
    status = F.when(F.col("d").isNull(), "PENDING").when(F.col("d.action") == "approve", "APPROVED").otherwise("REPLACED")
    text = F.when(F.col("d.action") == "approve", F.col("d.final_text")).when(F.col("d.action") == "replace", F.lit(config.refer_message))
    return rows.select("request_id", F.col("o.seq").alias("seq"), F.col("o.draft").alias("draft"), status.alias("status"), text.alias("final_text"), F.col("o.ts").alias("created_at"), F.col("d.ts").alias("reviewed_at"))


def with_task_ids(reviews: DataFrame, width: int = 1 << 16) -> DataFrame:
    """task_id: how many tasks were opened up to this one. Tasks are numbered within ranges of `width` of their order,
    and a running sum over the ranges' counts, a row for each range, tells what came before; so no task numbers all."""
    placed = reviews.withColumn("range", F.floor(F.col("seq") / width))
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("range", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("range").orderBy("seq")))
    return numbered.join(before, "range").withColumn("task_id", F.col("k") + F.col("before")).drop("range", "k", "before")


def pending(reviews: DataFrame, limit: int = 20) -> DataFrame:
    """The oldest open tasks; a sort with a limit, so no task holds more than `limit` rows of a partition."""
    return reviews.where("status = 'PENDING'").orderBy("seq").limit(limit)


def deliver(requests: DataFrame, reviews: DataFrame, *columns: str) -> DataFrame:
    """(request_id, result, text) and the requests' other columns asked for: not_found, pending_review or delivered
    with the final text, else the draft."""
    text = F.coalesce(F.nullif(F.col("final_text"), F.lit("")), F.nullif(F.col("draft"), F.lit("")), F.lit(""))
    result = F.when(F.col("status").isNull(), "not_found").when(F.col("status") == "PENDING", "pending_review").otherwise("delivered")
    tasks = reviews.select("request_id", "status", "draft", "final_text")
    rows = requests.select("request_id", *columns).join(tasks, "request_id", "left").select("request_id", *columns, result.alias("result"), text.alias("text"))
    return rows.withColumn("text", F.when(F.col("result") == "delivered", F.col("text")))


def exposure_latest(events: DataFrame) -> DataFrame:
    """events(request_id, seq, ts, action) with actions register, deliver, view -> (request_id, delivered, viewed,
    delivered_at, viewed_at). Registering again clears the flags; deliver and view only count after it."""
    reset = events.where("action = 'register'").groupBy("request_id").agg(F.max("seq").alias("from_seq"))

    def last(action: str) -> Column:
        return F.max(F.when((F.col("action") == action) & (F.col("seq") > F.col("from_seq")), F.struct("seq", "ts")))

    rows = events.join(reset, "request_id").groupBy("request_id").agg(last("deliver").alias("d"), last("view").alias("v"))
    return rows.select("request_id", F.col("d").isNotNull().cast("int").alias("delivered"), F.col("v").isNotNull().cast("int").alias("viewed"), F.col("d.ts").alias("delivered_at"), F.col("v.ts").alias("viewed_at"))


def audit_event(request_id: Column, event: str, payload: Column, ts: Column) -> Column:
    """An audit line as JSON. Raw texts don't belong in the payload."""
    if event not in AUDIT_EVENTS:
        raise ValueError(f"unknown audit event {event}")
    return F.to_json(F.struct(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), request_id.alias("request_id"), F.lit(event).alias("event"), payload.alias("payload")))


def funnel(audit: DataFrame) -> DataFrame:
    return audit.groupBy("event").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("request_id").alias("n_requests"))


def sessions(audit: DataFrame, gap: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """(key, session_start, session_end, n): events of a key with less than gap between neighbours."""
    rows = audit.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
