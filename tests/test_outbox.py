import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.operators import flow, outbox, state
from docloom.sources import files

T0 = dt.datetime(2024, 1, 1)


class Counting:
    """Another draft each time; every call leaves a line in a file."""

    def __init__(self, path, fail=False):
        self.path, self.fail = path, fail

    def generate(self, prompt):
        with open(self.path, "a") as f:
            f.write("x\n")
        if self.fail:
            raise RuntimeError("no answer")
        return f"draft {os.urandom(6).hex()}"


class Search:
    def __init__(self, path):
        self.path = path

    def search(self, query, k):
        with open(self.path, "a") as f:
            f.write("x\n")
        return [{"title": "t", "url": "u", "text": query}] * k


def lines(path):
    return path.read_text().count("\n") if path.exists() else 0


def inputs(spark, ids):
    asked = spark.createDataFrame([(i, i, "u", f"When may I shower {i}", T0) for i in ids], "request_id long, seq long, user_id string, query string, ts timestamp")
    segs = spark.createDataFrame([(1, "s", 2020, "wash")], "seg_id long, source string, pub_year int, text string")
    hits = spark.createDataFrame([(i, 1, 0.9 if i % 2 else 0.1, 1) for i in ids], "query_id long, seg_id long, score double, rank int")
    return asked, hits, segs


def test_one_call_a_question_whatever_is_read(spark, tmp_path):
    box = outbox.Outbox(spark, str(tmp_path / "box"))
    calls, searches = tmp_path / "calls", tmp_path / "searches"
    made = flow.ask(*inputs(spark, range(40)), Counting(calls), Search(searches), outbox=box, batch="a")
    answers = {r.request_id: r.draft for r in made.answers.collect()}
    assert len(answers) == 40 == len(set(answers.values()))
    assert {r.request_id: r.draft for r in made.reviews.collect()} == answers == {r.request_id: r.draft for r in made.queue.collect()}
    chars = {r.request_id: json.loads(r.payload)["chars"] for r in made.audit.where("event = 'draft_generated'").collect()}
    assert chars == {k: len(v) for k, v in answers.items()}
    assert made.exposures.count() == 40 and made.evidence.count() == 60
    assert lines(calls) == 40 and lines(searches) == 20
    queue = made.queue.orderBy("task_id").first()
    assert (queue.task_id, queue.raw_query, queue.status) == (1, "When may I shower 0", "PENDING")


def test_batches_share_the_counter_and_come_again(spark, tmp_path):
    box = outbox.Outbox(spark, str(tmp_path / "box"))
    calls = tmp_path / "calls"
    for batch, ids in (("a", range(5)), ("b", range(5, 9)), ("a", range(5))):
        flow.ask(*inputs(spark, ids), Counting(calls), outbox=box, batch=batch)
    assert sorted((r.task_id, r.request_id) for r in flow.asked(box).queue.collect()) == [(i + 1, i) for i in range(9)]
    assert lines(calls) == 9 and len(box.manifests()) == 2
    # The whole way: queue, decision, delivery, as one state.
    made = flow.asked(box)
    columns = made.reviews.columns
    decided = spark.createDataFrame([(3, 100, T0, "approve", None, None), (4, 101, T0, "replace", None, None)], made.reviews.schema).select(columns)
    latest = state.review_latest(made.reviews.unionByName(decided))
    again = spark.createDataFrame([(i, 200 + i, T0) for i in (2, 3, 4, 77)], "request_id long, seq long, ts timestamp")
    results, _, _ = flow.deliver(again, latest)
    draft = made.answers.where("request_id = 3").first().draft
    assert {r.request_id: (r.result, r.text) for r in results.collect()} == {2: ("pending_review", None), 3: ("delivered", draft), 4: ("delivered", EngineConfig().refer_message), 77: ("not_found", None)}


def test_a_failure_leaves_nothing_and_ids_go_on(spark, tmp_path):
    box = outbox.Outbox(spark, str(tmp_path / "box"))
    flow.ask(*inputs(spark, range(3)), Counting(tmp_path / "calls"), outbox=box, batch="a")
    with pytest.raises(Exception, match="no answer"):
        flow.ask(*inputs(spark, range(3, 5)), Counting(tmp_path / "calls", fail=True), outbox=box, batch="b")
    assert box.manifest("b") is None and len(list((tmp_path / "box").glob("data-*"))) == 1
    flow.ask(*inputs(spark, range(3, 5)), Counting(tmp_path / "calls"), outbox=box, batch="b")
    ids = [r.task_id for r in box.drafts().orderBy("task_id").collect()]
    assert len(set(ids)) == 5 and ids[:3] == [1, 2, 3] and min(ids[3:]) > 3


def test_of_two_writers_of_a_batch_the_first_counts(spark, tmp_path):
    box = outbox.Outbox(spark, str(tmp_path / "box"))
    firsts = [box.reserve(2), box.reserve(3), box.reserve(1)]
    assert firsts == [1, 3, 6]
    folders = []
    for name in ("one", "two"):
        folders.append(box.new_folder())
        spark.createDataFrame([(name,)], "draft string").write.parquet(f"{folders[-1]}/drafts")
        box.commit("x", folders[-1], 1, 1)
    assert [r.draft for r in box.drafts("x").select("draft").collect()] == ["one"]
    assert not files.path_exists(spark, folders[1])
    assert not files.publish(spark, f"{tmp_path}/box/batches/{os.listdir(tmp_path / 'box' / 'batches')[0]}", "{}")


def test_evidence_goes_after_its_time(spark, tmp_path):
    box = outbox.Outbox(spark, str(tmp_path / "box"))
    flow.ask(*inputs(spark, [2]), Counting(tmp_path / "calls"), Search(tmp_path / "s"), EngineConfig(evidence_ttl_seconds=60), box, "a")
    assert box.expire_evidence(T0 + dt.timedelta(seconds=60)) == 0 and box.evidence("a").count() == 3
    assert box.expire_evidence(T0 + dt.timedelta(seconds=61)) == 1 and box.evidence("a").count() == 0
    assert box.drafts("a").count() == 1


def test_an_empty_batch_and_an_empty_outbox(spark, tmp_path):
    box = outbox.Outbox(spark, str(tmp_path / "box"))
    assert flow.asked(box).audit.count() == 0 and box.drafts("no").count() == 0
    made = flow.ask(*(x.limit(0) for x in inputs(spark, [1])), Counting(tmp_path / "calls"), outbox=box, batch="a")
    assert made.answers.count() == 0 and box.manifest("a")["n"] == 0


def test_numbers_stay_numbers_in_the_trail(spark, tmp_path):
    made = flow.ask(*inputs(spark, [1]), Counting(tmp_path / "calls"))
    flow.write_audit(made.audit, str(tmp_path / "trail"))
    written = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "trail")).collect()]
    payloads = {w["event"]: w["payload"] for w in written}
    assert payloads["local_retrieval_done"] == {"hits": 1, "top_score": 0.9, "theta": 0.75} and payloads["draft_generated"] == {"chars": 18}
    assert flow.read_audit(spark, str(tmp_path / "trail")).where("event = 'draft_generated'").select(F.col("payload")["chars"]).first()[0] == "18"
    with pytest.raises(Exception, match="unknown audit event"):
        flow.write_audit(made.audit.withColumn("payload", F.lit("not json")), str(tmp_path / "bad"))
