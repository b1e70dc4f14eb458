import datetime as dt
import random

import pytest

from docloom.operators import state
from docloom.streaming import stateful

T0 = dt.datetime(2024, 1, 1)
EVENTS = "request_id long, seq long, ts timestamp, action string, draft string, final_text string"


@pytest.fixture(autouse=True)
def store(spark):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n, None) for n in names}
    stateful.use_rocksdb(spark)
    spark.conf.set(names[2], "2")
    yield
    for n, value in before.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def run(spark, made, tmp_path, mode):
    """One run over what is new; a run goes on where the one before ended."""
    rows = []
    query = made.writeStream.outputMode(mode).foreachBatch(lambda df, n: rows.extend(df.collect()))
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    return rows


def put(spark, rows, schema, tmp_path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_reviews_in_any_order_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    events = [(rng.randrange(6), seq, T0 + dt.timedelta(seconds=seq), rng.choice(["enqueue", "approve", "replace", "other"]), f"d{seq}", f"f{seq}") for seq in range(60)]
    mixed = events[:]
    rng.shuffle(mixed)
    latest = {}
    for part in (mixed[:25], mixed[25:40], mixed[40:]):  # each run is a restart from the checkpoint; decisions come late
        for r in run(spark, stateful.review_updates(put(spark, part, EVENTS, tmp_path)), tmp_path, "update"):
            latest[r.request_id] = tuple(r)
    want = {r.request_id: tuple(r) for r in state.review_latest(spark.createDataFrame(events, EVENTS)).collect()}
    assert latest == want
    assert run(spark, stateful.review_updates(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))), tmp_path, "update") == []
    opened = {r.request_id: r.draft for r in stateful.read_state(spark, str(tmp_path / "cp"), "opened").collect()}
    assert opened == {k: v[2] for k, v in want.items()}


def test_evidence_to_the_millisecond(spark, tmp_path):
    schema = "evidence_id long, ts timestamp, url string, text string, expires_at timestamp"
    at = lambda ms: T0 + dt.timedelta(milliseconds=ms)
    first = run(spark, stateful.evidence_updates(put(spark, [(1, at(0), "u", "one", at(600)), (2, at(0), "u", "two", at(601)), (3, at(0), "u", "old", at(500))], schema, tmp_path)), tmp_path, "append")
    assert sorted((r.evidence_id, r.event) for r in first) == [(1, "stored"), (2, "stored"), (3, "stored")]
    # A later version of 3; the watermark comes to 601 ms: 1 has ended, 2 counts for its last millisecond.
    second = run(spark, stateful.evidence_updates(put(spark, [(3, at(10), "u", "new", at(900)), (9, at(601), "u", "x", at(5000))], schema, tmp_path)), tmp_path, "append")
    seen = [(r.evidence_id, r.event, r.text) for r in second]
    assert (1, "expired", "one") in seen and (3, "stored", "new") in seen and not [x for x in seen if x[0] == 2 or x == (3, "expired", "old")]
    left = stateful.read_state(spark, str(tmp_path / "cp"), "item")
    assert {r.evidence_id for r in left.collect()} == {2, 3, 9} and {r.evidence_id for r in stateful.alive(left, at(602)).collect()} == {3, 9}
    fourth = run(spark, stateful.evidence_updates(put(spark, [(7, at(602), "u", "z", at(5000))], schema, tmp_path)), tmp_path, "append")
    fifth = run(spark, stateful.evidence_updates(put(spark, [(7, at(603), "u", "z", at(5000))], schema, tmp_path)), tmp_path, "append")
    assert (2, "expired") in [(r.evidence_id, r.event) for r in fourth + fifth]
