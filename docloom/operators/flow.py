"""A question's way through the engine, for whole batches: from the asked question to a draft in review, and from a
decision to the patient. Every step leaves rows of events; nothing is updated in place.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions import classify, text
from docloom.operators import state
from docloom.operators.outbox import Outbox
from docloom.sources import adapters
from docloom.sources.files import delete_path, scratch_folder


@dataclass
class Asked:
    """What questions leave: answers(request_id, task_id, status, draft, unsuitable), audit lines (request_id, ord, event, payload,
    ts), review and exposure events, the review queue's rows, and the evidence that was fetched. All read one stored
    table."""

    answers: DataFrame
    audit: DataFrame
    reviews: DataFrame
    exposures: DataFrame
    queue: DataFrame
    evidence: DataFrame


def _lines(rows: DataFrame, lines: list[tuple[Column, Column]]) -> DataFrame:
    """(request_id, ord, event, payload, ts): one audit row for each (event, payload) of a request."""
    made = F.array(*[F.struct(F.lit(n).alias("ord"), event.alias("event"), payload.alias("payload")) for n, (event, payload) in enumerate(lines)])
    return rows.select("request_id", "ts", F.explode(made).alias("line")).select("request_id", "line.ord", "line.event", "line.payload", "ts")


def ask(
    requests: DataFrame,
    hits: DataFrame,
    segments: DataFrame,
    model: adapters.LanguageModel,
    search: adapters.ExternalSearch | None = None,
    config: EngineConfig | None = None,
    outbox: Outbox | None = None,
    batch: str = "batch",
) -> Asked:
    """requests(request_id, seq, user_id, query, ts) with their hits(query_id, seg_id, score, rank), query_id being the
    request -> drafts that wait for a person. Payloads hold lengths, scores and the abstract, never the question.

    Model and search are called once for each question; what they say is written to the outbox (without one, to a scratch
    folder), and all that Asked holds is read from there. A batch that the outbox has already is read, not made again."""
    config = config or EngineConfig()
    outbox = outbox or Outbox(requests.sparkSession, scratch_folder(requests.sparkSession))
    if outbox.manifest(batch) is None:
        folder = outbox.new_folder()
        try:
            n = requests.count()
            first = outbox.reserve(n)
            rows = _gated(requests, hits, segments, config)
            outside = rows.where("external").select(F.col("request_id").alias("query_id"), "abstract", F.col("ts").alias("now"))
            adapters.search(outside, search or adapters.NoSearch(), config.external_k, config.evidence_ttl_seconds).write.parquet(f"{folder}/evidence")
            found = requests.sparkSession.read.parquet(f"{folder}/evidence")
            drafted = adapters.generate(_prompted(rows, found, config), model, config)
            numbered = state.with_task_ids(drafted).withColumn("task_id", F.col("task_id") + (first - 1))
            numbered.selectExpr(*(f"CAST({name} AS {kind}) AS {name}" for name, kind in outbox.drafts_columns(requests))).write.parquet(f"{folder}/drafts")
        except BaseException:
            delete_path(requests.sparkSession, folder)
            raise
        outbox.commit(batch, folder, first, n)
    return asked(outbox, batch, config)


def _gated(requests: DataFrame, hits: DataFrame, segments: DataFrame, config: EngineConfig) -> DataFrame:
    """Questions masked and abstracted, with their local evidence, and whether they go outside, too."""
    masked = text.deidentify(F.col("query"))
    labels = F.array_join(classify.unsuitable_labels(F.col("query")), ",")
    rows = requests.select("request_id", "seq", "user_id", "ts", "query", F.length("query").alias("len"), masked.alias("masked"), text.abstract_query(masked).alias("abstract"), labels.alias("unsuitable"))
    line = text.local_line(F.col("source"), F.col("pub_year"), F.col("text")).alias("line")
    found = hits.join(segments.select("seg_id", "source", "pub_year", "text"), "seg_id").groupBy(F.col("query_id").alias("request_id")).agg(
        F.count(F.lit(1)).alias("hits"), F.max("score").alias("top_score"), F.transform(F.array_sort(F.collect_list(F.struct("rank", line))), lambda x: x["line"]).alias("lines")
    )
    out = rows.join(found, "request_id", "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "top_score": F.coalesce("top_score", F.lit(0.0))})
    return out.withColumn("external", F.col("top_score") <= config.theta)


def _prompted(rows: DataFrame, evidence: DataFrame, config: EngineConfig) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "url", "text"))), lambda x: text.external_line(x["url"], x["text"]))
    external = evidence.groupBy(F.col("query_id").alias("request_id")).agg(lines.alias("outside"))
    none = F.array().cast("array<string>")
    together = F.concat(F.coalesce("lines", none), F.coalesce("outside", none))
    return rows.join(external, "request_id", "left").withColumn("used", F.coalesce(F.size("outside"), F.lit(0))).withColumn("prompt", text.prompt(together, F.col("masked"), config))


def asked(outbox: Outbox, batch: str | None = None, config: EngineConfig | None = None) -> Asked:
    """What the outbox has of a batch, or of all batches."""
    config = config or EngineConfig()
    stored = outbox.drafts(batch)

    def payload(*columns: Column) -> Column:
        return F.to_json(F.struct(*columns))

    told = F.when(F.col("external"), F.lit("external_retrieval_triggered")).otherwise(F.lit("external_retrieval_skipped"))
    audit = _lines(
        stored,
        [
            (F.lit("query_received"), payload(F.col("user_id"), F.col("len"))),
            (F.lit("query_deidentified"), payload(F.col("abstract"))),
            (F.lit("local_retrieval_done"), payload(F.col("hits"), F.col("top_score"), F.lit(config.theta).alias("theta"))),
            (told, F.when(F.col("external"), payload(F.col("used"))).otherwise("{}")),
            (F.lit("draft_generated"), payload(F.length("draft").alias("chars"))),
            (F.lit("queued_for_human_review"), payload(F.col("task_id"), F.col("unsuitable"))),
        ],
    )
    reviews = stored.select("request_id", "seq", "ts", F.lit("enqueue").alias("action"), "draft", F.lit(None).cast("string").alias("final_text"))
    exposures = stored.select("request_id", "seq", "ts", F.lit("register").alias("action"))
    answers = stored.select("request_id", "task_id", F.lit("queued_for_review").alias("status"), "draft", "unsuitable")
    queue = stored.select("task_id", "request_id", "user_id", F.col("query").alias("raw_query"), "draft", "unsuitable", F.lit("PENDING").alias("status"), F.col("ts").alias("created_at"))
    return Asked(answers, audit, reviews, exposures, queue, outbox.evidence(batch))


def by_request(reviews: DataFrame, requests: DataFrame) -> DataFrame:
    """The task of each request, as state.review_latest() has it; no row for one that was never opened."""
    return reviews.join(requests.select("request_id").distinct(), "request_id", "left_semi")


def deliver(requests: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """requests(request_id, seq, ts) for delivery -> (results(request_id, result, text), exposure events, audit lines).
    A delivery is one view as well; each repetition leaves its events again."""
    results = state.deliver(requests, reviews, "seq", "ts")
    done = results.where("result = 'delivered'")
    exposures = done.select("request_id", "seq", "ts", F.explode(F.array(F.lit("deliver"), F.lit("view"))).alias("action"))
    audit = _lines(done, [(F.lit("delivered_to_patient"), F.to_json(F.struct(F.length("text").alias("chars"))))])
    return results.select("request_id", "result", "text"), exposures, audit


def put_evidence(items: DataFrame, ttl_seconds: int = 600) -> DataFrame:
    """items(ts, seq, ...) -> the same with evidence_id and expires_at. The id is the clock in milliseconds; of items
    put in one millisecond the last stays."""
    rows = items.withColumn("evidence_id", F.unix_millis(F.col("ts").cast("timestamp")))
    columns = [c for c in rows.columns if c != "evidence_id"]
    kept = rows.groupBy("evidence_id").agg(F.max_by(F.struct(*columns), "seq").alias("item")).select("evidence_id", "item.*")
    return kept.withColumn("expires_at", F.col("ts") + F.expr(f"INTERVAL {ttl_seconds} SECONDS"))


def get_evidence(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """asked(evidence_id, now) -> the items that haven't expired by then; the last moment still counts."""
    return asked.join(stored, "evidence_id").where(F.col("now") <= F.col("expires_at"))


def write_audit(audit: DataFrame, path: str) -> None:
    """Appends the lines to the audit trail, one JSON object each; numbers of a payload stay numbers. An event outside the
    vocabulary or a payload with other fields than the event's is an error, so no text gets in by mistake."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = F.concat_ws(",", F.array_sort(F.coalesce(F.json_object_keys("payload"), F.array(F.lit("no object")))))
    known = reduce(lambda a, b: a | b, [(F.col("event") == e) & (fields == ",".join(sorted(names))) for e, names in state.AUDIT_EVENTS.items()])
    event = F.when(known, F.col("event")).otherwise(F.raise_error(F.concat(F.lit("unknown audit event "), F.col("event"), F.lit(" with "), fields)))
    head = F.to_json(F.struct(stamp.alias("ts"), F.col("request_id"), event.alias("event")))
    # The payload is JSON already: it goes in as it is, before the closing brace, on one line.
    line = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"payload":'), F.regexp_replace("payload", r"[\r\n]+", " "), F.lit("}"))
    audit.select(line.alias("value")).write.mode("append").text(path)


def read_audit(spark, path: str) -> DataFrame:
    """(ts, request_id, event, payload) with the payload as a map."""
    parsed = F.from_json("value", "ts string, request_id string, event string, payload map<string,string>")
    return spark.read.text(path).select(parsed.alias("x")).select(F.to_timestamp("x.ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "x.request_id", "x.event", "x.payload")
