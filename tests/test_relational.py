import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.operators import flow, index, knowledge, retrieval, sections, state
from docloom.sources import adapters, files, loaders
from docloom.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def test_headings_and_sections(spark):
    pages = ["2 Scope\nx", "2 Scope\ny", "1.2.3.4.5 deep\n3 After", "Page 3 of 34\n2.1  Details", "2024 in", "plain"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(pages, 1)] + [("g", 1, "pre"), ("h", 1, "pre"), ("h", 2, "1 Start here")], "file_name string, page_no int, text string")
    heads = [(r.file_name, r.page_no, r.section_id, r.section_title) for r in sections.find_headings(df).orderBy("file_name", "page_no").collect()]
    assert heads == [("f", 1, "2", "Scope"), ("f", 4, "2.1", "Details"), ("h", 2, "1", "Start here")]
    got = {(r.file_name, r.section_id): (r.page_start, r.page_end) for r in sections.build_sections(df).collect()}
    assert got == {("f", "2"): (1, 3), ("f", "2.1"): (4, 6), ("g", "0"): (1, 1), ("h", "1"): (2, 2)}
    assert sections.build_sections(df, keep_preamble=True).where("file_name = 'h'").count() == 2


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, seg_id long, score double")


def test_minmax_and_fusion(spark):
    rows = retrieval.minmax(hits(spark, [(1, 1, 0.5), (1, 2, 0.5), (2, 1, 3.0), (2, 2, 1.0), (2, 3, 2.0)]))
    assert {(r.query_id, r.seg_id): r.norm for r in rows.collect()} == {(1, 1): 1.0, (1, 2): 1.0, (2, 1): 1.0, (2, 2): 0.0, (2, 3): 0.5}
    fused = retrieval.fuse(hits(spark, [(1, 1, 1.0), (1, 2, 0.0)]), hits(spark, [(1, 2, 1.0)]), EngineConfig())
    assert {r.seg_id: r.score for r in fused.collect()} == {1: 0.65, 2: 0.35}


def test_boost_after_cut(spark):
    rows = hits(spark, [(1, i, 1.0 - i / 100) for i in range(25)])
    kinds = spark.createDataFrame([(i, "guideline" if i in (1, 24) else "education") for i in range(25)], "seg_id long, doc_type string")
    out = [r.seg_id for r in retrieval.boost(rows, kinds, EngineConfig()).orderBy("rank").collect()]
    assert out == [1, 0, 2, 3, 4, 5, 6, 7]


def test_sparse_fills_with_zero_scores_and_gate(spark):
    segs = spark.createDataFrame([(i, t, "education") for i, t in enumerate(["apple pear", "apple", "plum", "fig", "kiwi"])], "seg_id long, text string, doc_type string")
    asked = spark.createDataFrame([(7, "apple"), (8, "nothing")], "query_id long, text string")
    out = retrieval.sparse_topk(segs, asked, 3)
    assert [(r.query_id, r.seg_id, r.score > 0) for r in out.orderBy("query_id", "rank").collect()] == [(7, 1, True), (7, 0, True), (7, 2, False), (8, 0, False), (8, 1, False), (8, 2, False)]
    gate = retrieval.theta_gate(hits(spark, [(7, 1, 0.75)]), asked)
    assert {r.query_id: (r.top_score, r.external) for r in gate.collect()} == {7: (0.75, True), 8: (0.0, True)}
    assert not retrieval.theta_gate(hits(spark, [(7, 1, 0.7501)]), asked).where("query_id = 7").first().external


def test_dense_blocks_agree_with_brute_force(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "seg_id long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(1, [1.0, 2.0]), (2, [-1.0, 0.5])], "query_id long, embedding array<float>")
    want = {q: [s for _, s in sorted((-(a * (i % 7) + b * (i % 5)), i) for i in range(60))[:8]] for q, a, b in ((1, 1, 2), (2, -1, 0.5))}
    got = {q: [r.seg_id for r in retrieval.dense_topk(vectors, asked).where(f"query_id = {q}").orderBy("rank").collect()] for q in (1, 2)}
    assert got == want


def test_tiered_search(spark):
    rows = [(1, "realtime", 1, 0.9, "new"), (1, "historical", 2, 0.1, "old"), (1, "historical", 3, 0.05, "new")]
    df = spark.createDataFrame(rows, "query_id long, tier string, seg_id long, score double, text string")
    assert [r.seg_id for r in retrieval.tiered_search(df).orderBy("rank").collect()] == [2, 3]
    assert [r.seg_id for r in retrieval.tiered_search(df, merge_by_score=True).orderBy("rank").collect()] == [1, 2]


def test_review_deliver(spark):
    log = [(1, 1, "enqueue", "d1", None), (1, 2, "approve", None, "ok"), (1, 3, "replace", None, None), (2, 4, "enqueue", "d2", None), (2, 5, "approve", None, ""), (3, 6, "enqueue", "d3", None), (4, 7, "approve", None, "x")]
    df = spark.createDataFrame([(r, s, T0 + dt.timedelta(seconds=s), a, d, f) for r, s, a, d, f in log], "request_id long, seq long, ts timestamp, action string, draft string, final_text string")
    latest = state.review_latest(df)
    assert {r.request_id: r.status for r in latest.collect()} == {1: "REPLACED", 2: "APPROVED", 3: "PENDING"}
    assert [r.request_id for r in state.pending(latest).collect()] == [3]
    assert {r.seq: r.task_id for r in state.with_task_ids(latest).collect()} == {1: 1, 4: 2, 6: 3}
    asked = spark.createDataFrame([(1,), (2,), (3,), (9,)], "request_id long")
    assert {r.request_id: (r.result, r.text) for r in state.deliver(asked, latest).collect()} == {1: ("delivered", EngineConfig().refer_message), 2: ("delivered", "d2"), 3: ("pending_review", None), 9: ("not_found", None)}
    with pytest.raises(ValueError):
        state.audit_event(F.lit("r"), "raw_text", F.lit(1), F.lit(T0))


def test_exposure_resets(spark):
    df = spark.createDataFrame([(1, s, T0 + dt.timedelta(seconds=s), a) for s, a in enumerate(["register", "deliver", "view", "register", "view"])], "request_id long, seq long, ts timestamp, action string")
    row = state.exposure_latest(df).first()
    assert (row.delivered, row.viewed, row.delivered_at, row.viewed_at) == (0, 1, None, T0 + dt.timedelta(seconds=4))


def test_knowledge_base(spark, tmp_path):
    kb = knowledge.KnowledgeBase(spark, str(tmp_path / "kb"))
    chunks = spark.createDataFrame([("a", "s", 0, "text"), ("b", "s", 1, "more")], knowledge.CHUNK_SCHEMA)
    assert kb.merge() is False and kb.add(chunks, "realtime") == 2 and kb.add(chunks, "historical") == 2
    assert kb.merge() is True and kb.read("historical").count() == 4 and kb.read("realtime").count() == 0
    assert [(r.tier, r.n_chunks) for r in kb.status().collect()] == [("historical", 4)]
    with pytest.raises(ValueError):
        kb.add(chunks.limit(0), "realtime")


def test_sources(spark, tmp_path):
    assert files.load_segments(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.load_segments(spark, str(tmp_path / "none"), missing_ok=False).count()
    assert files.load_or_demo(spark, str(tmp_path / "none")).count() == 2
    files.write_segments(files.demo_segments(spark), str(tmp_path / "segments"))
    assert files.load_segments(spark, str(tmp_path / "segments")).where("doc_type = 'guideline'").count() == 1
    (tmp_path / "bad").write_text("{bad\n")
    assert files.load_segments(spark, str(tmp_path / "bad"), strict=False).select("seg_id", "_corrupt_record").first()._corrupt_record == "{bad"
    page = spark.createDataFrame([("http://a.b/x/y?q#f", '<a href="z"> <a href="/r"> <a href="//c.d/"> <a href="#g"> <a href="?k=1&amp;l=2"> <a href="z"> <a href="">')], "url string, html string")
    assert [r.link for r in files.crawl_frontier(page).orderBy("ord").collect()] == ["http://a.b/x/y?q#f", "http://a.b/x/z", "http://a.b/r", "http://a.b/x/y?q#g", "http://a.b/x/y?k=1&l=2"]


def test_adapters(spark):
    df = adapters.embed(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, text string"), adapters.HashEmbedder(8)).orderBy("id").collect()
    assert df[0].embedding == df[1].embedding and abs(sum(x * x for x in df[0].embedding) - 1) < 1e-6 and sum(df[2].embedding) == 0
    assert adapters.generate(spark.createDataFrame([("p",)], "prompt string"), adapters.EchoModel()).first().draft.startswith("Draft ")

    class Two:
        def search(self, query, k):
            return [{"title": "t" * 300, "url": "u", "text": query}] * 5

    gated = spark.createDataFrame([(1, "abc", T0)], "query_id long, abstract string, now timestamp")
    found = adapters.search(gated, Two(), k=2).collect()
    assert len(found) == 2 and len(found[0].title) == 200 and found[0].expires_at == T0 + dt.timedelta(seconds=600)

    class Blank:
        def pages(self, content):
            return ["", " "]

    made = adapters.extract_pages(spark.createDataFrame([("f", bytearray(b"one\x0ctwo"))], "path string, content binary"), Blank(), adapters.PlainPages())
    assert [(r.page_no, r.text) for r in made.orderBy("page_no").collect()] == [(1, "one"), (2, "two")]


def stream(spark, tmp_path, df, name):
    df.write.parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def collect_stream(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "enqueue"), (1, 2, "approve"), (2, 3, "approve"), (2, 4, "enqueue")], "request_id long, seq long, action string")
    rows = collect_stream(streams.review_states(stream(spark, tmp_path, log, "log")), "review_rows", "update")
    assert {r.request_id: r.status for r in rows} == {1: "APPROVED", 2: "PENDING"}
    audit = spark.createDataFrame([(T0 + dt.timedelta(minutes=m), "e", 1) for m in (0, 5, 70, 200)], "ts timestamp, event string, user_id long")
    rows = collect_stream(streams.audit_windows(stream(spark, tmp_path, audit, "audit")), "audit_rows", "complete")
    assert sorted(r.n for r in rows) == [1, 1, 2]
    kb = knowledge.KnowledgeBase(spark, str(tmp_path / "kb"))
    docs = spark.createDataFrame([("s", "some text")], "source string, text string")
    made = lambda d: d.select(F.sha1("text").alias("seg_id"), "source", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk"))
    streams.ingest(stream(spark, tmp_path, docs, "docs"), made, lambda c: kb.add(c, "realtime"), str(tmp_path / "cp")).awaitTermination(120)
    assert kb.read("realtime").count() == 1
    late = spark.createDataFrame([(1, T0, "u", "x", T0 + dt.timedelta(minutes=10))], "evidence_id long, ts timestamp, url string, text string, expires_at timestamp")
    rows = collect_stream(streams.evidence_lifetimes(stream(spark, tmp_path, late, "late")), "evidence_rows", "append")
    assert [r.event for r in rows][:1] == ["stored"]


def test_index_is_built_once_and_replaced(spark, tmp_path):
    segs = spark.createDataFrame([(i, t, "education") for i, t in enumerate(["apple pear", "apple", "plum", "fig", "kiwi"])], "seg_id long, text string, doc_type string")
    asked = spark.createDataFrame([(7, "apple pear"), (8, "nothing")], "query_id long, text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None)], "seg_id long, embedding array<double>")
    built = index.RetrievalIndex(spark, str(tmp_path / "index"))
    assert built.info().first().asDict() == {"exists": False, "n_segments": 0, "n_terms": 0, "n_vectors": 0, "n_bytes": 0}
    with pytest.raises(FileNotFoundError):
        built.config()
    built.build(segs, vectors, index.IndexConfig(embedding_model="m", embedding_size=2))
    want = [tuple(r) for r in retrieval.sparse_topk(segs, asked, 3).orderBy("query_id", "rank").collect()]
    assert [tuple(r) for r in built.sparse_topk(asked, 3).orderBy("query_id", "rank").collect()] == want
    by_vector = spark.createDataFrame([(7, [1.0, 0.5])], "query_id long, embedding array<double>")
    assert [r.seg_id for r in built.dense_topk(by_vector, 5).orderBy("rank").collect()] == [0, 1]
    assert built.retrieve(asked, by_vector).where("query_id = 7 AND rank = 1").first().seg_id == 0
    with pytest.raises(ValueError):
        built.dense_topk(spark.createDataFrame([(7, [1.0])], "query_id long, embedding array<double>"))
    info = built.info().first()
    assert (info.exists, info.n_segments, info.n_terms, info.n_vectors) == (True, 5, 5, 3) and info.n_bytes > 0
    built.build(segs.limit(2), config=index.IndexConfig(ngram_max=2))
    assert built.version == 1 and built.config().ngram_max == 2 and built.info().first().n_vectors == 0
    built.clear()
    assert built.version == -1


def test_retrieval_without_questions_or_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0]), (2, None)], "seg_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0]), (2, None)], "query_id long, embedding array<float>")
    assert [(r.query_id, r.seg_id) for r in retrieval.dense_topk(vectors, asked).collect()] == [(1, 1)]
    assert retrieval.dense_topk(vectors, asked.limit(0)).collect() == [] and retrieval.dense_topk(vectors.limit(0), asked).collect() == []
    segs = spark.createDataFrame([(1, "a bc", "x")], "seg_id long, text string, doc_type string")
    assert retrieval.sparse_topk(segs, spark.createDataFrame([], "query_id long, text string")).collect() == []


def test_boost_takes_the_last_type(spark):
    kinds = spark.createDataFrame([(1, "guideline", 0), (1, "education", 1), (2, "education", 0)], "seg_id long, doc_type string, n int")
    out = retrieval.boost(hits(spark, [(1, 1, 0.9), (1, 2, 1.0)]), kinds, EngineConfig(), order="n").orderBy("rank").collect()
    assert [(r.seg_id, r.score) for r in out] == [(2, 1.0), (1, 0.9)]


def test_question_to_delivery(spark, tmp_path):
    segs = files.demo_segments(spark)
    asked = spark.createDataFrame([("r1", 1, "u1", "When can I shower?", T0), ("r2", 2, "u1", "What is the rule on parking, call 13812345678", T0)], "request_id string, seq long, user_id string, query string, ts timestamp")
    found = spark.createDataFrame([("r1", "guideline_1", 0.9, 1)], "query_id string, seg_id string, score double, rank int")
    made = flow.ask(asked, found, segs, adapters.EchoModel())
    assert {(r.request_id, r.status, r.unsuitable) for r in made.answers.collect()} == {("r1", "queued_for_review", ""), ("r2", "queued_for_review", "hospital_regulations")}
    lines = {(r.request_id, r.event): json.loads(r.payload) for r in made.audit.collect()}
    assert len(lines) == 12 and {e for _, e in lines} <= set(state.AUDIT_EVENTS)
    assert lines["r1", "local_retrieval_done"] == {"hits": 1, "top_score": 0.9, "theta": 0.75} and lines["r1", "external_retrieval_skipped"] == {}
    assert lines["r2", "external_retrieval_triggered"] == {"used": 0} and lines["r2", "queued_for_human_review"] == {"task_id": 2, "unsuitable": "hospital_regulations"}
    assert "13812345678" not in json.dumps(list(lines.values()))
    latest = state.review_latest(made.reviews)
    assert [r.status for r in flow.by_request(latest, asked.where("seq = 1")).collect()] == ["PENDING"]
    again = asked.select("request_id", (F.col("seq") + 10).alias("seq"), "ts")
    results, exposures, audit = flow.deliver(again, latest)
    assert {r.result for r in results.collect()} == {"pending_review"} and exposures.collect() == [] and audit.collect() == []
    decided = made.reviews.unionByName(spark.createDataFrame([("r1", 5, T0, "approve", None, "Two days.")], made.reviews.schema))
    results, exposures, audit = flow.deliver(again, state.review_latest(decided))
    assert {(r.request_id, r.result, r.text) for r in results.collect()} == {("r1", "delivered", "Two days."), ("r2", "pending_review", None)}
    seen = state.exposure_latest(made.exposures.unionByName(exposures)).where("request_id = 'r1'").first()
    assert (seen.delivered, seen.viewed) == (1, 1)
    trail = str(tmp_path / "audit")
    flow.write_audit(made.audit, trail)
    flow.write_audit(audit, trail)
    back = {(r.request_id, r.event): r.payload for r in flow.read_audit(spark, trail).collect()}
    assert len(back) == 13 and back["r1", "delivered_to_patient"] == {"chars": "9"}
    with pytest.raises(Exception, match="unknown audit event"):
        flow.write_audit(audit.withColumn("event", F.lit("raw_text")), trail)
    with pytest.raises(Exception, match="unknown audit event"):
        flow.write_audit(audit.withColumn("payload", F.lit('{"chars":1,"query":"raw"}')), trail)
    nobody = flow.deliver(spark.createDataFrame([("no", 1, T0)], again.schema), latest)[0].first()
    assert nobody.result == "not_found"


def test_evidence_put_and_get(spark):
    items = spark.createDataFrame([(T0, 1, "x", "y"), (T0, 2, "x", "later"), (T0 + dt.timedelta(seconds=1), 3, "x", "z")], "ts timestamp, seq long, url string, text string")
    stored = flow.put_evidence(items, 10)
    at = {r.text: r.evidence_id for r in stored.collect()}
    assert set(at) == {"later", "z"}
    asked = spark.createDataFrame([(at["later"], T0 + dt.timedelta(seconds=s)) for s in (0, 10, 11)], "evidence_id long, now timestamp")
    assert [r.text for r in flow.get_evidence(asked, stored).collect()] == ["later"] * 2


def test_loaders(spark):
    class Pages:
        def pages(self, content):
            if content.startswith(b"bad"):
                raise OSError("broken")
            return content.decode().split("|")

    class Scan:
        def pages(self, content):
            return [" ", "seen " + content.decode()]

    found = spark.createDataFrame([("a.txt", bytearray("grü".encode("latin-1"))), ("b.pdf", bytearray(b"one|two")), ("c.pdf", bytearray(b"bad")), ("d.doc", bytearray(b"x")), ("e.pdf", bytearray(b"w" * 1200)), ("f.TXT", None)], "path string, content binary")
    documents, failures = loaders.load_files(found, Pages(), Scan())
    rows = {(r.source, r.page_no): (r.text, r.metadata.get("ocr")) for r in documents.collect()}
    assert rows == {("a.txt", 1): ("grü", None), ("b.pdf", 2): ("seen one|two", "True"), ("e.pdf", 1): ("w" * 1200, None), ("f.TXT", 1): ("", None)}
    assert {(r.source, r.error) for r in failures.collect()} == {("c.pdf", "broken"), ("d.doc", "unsupported file type: doc")}
    plain, _ = loaders.load_files(found.where("path = 'b.pdf'"), Pages())
    assert [(r.page_no, r.text) for r in plain.orderBy("page_no").collect()] == [(1, "one"), (2, "two")]
    assert loaders.decode_text("中文".encode("gb18030")) == "中文" and loaders.decode_text("﻿x".encode()) == "x" and loaders.decode_text("y".encode("utf-16")) == "y"
    pages = spark.createDataFrame([("http://a/x", '<a href="/y">l</a><a href="/gone">l</a><p>start</p>'), ("http://a/y", "<p>child</p>")], "url string, html string")
    urls = spark.createDataFrame([("http://a/x",), ("http://a/none",)], "url string")
    documents, failures = loaders.load_pages(urls, pages, crawl=True)
    assert [(r.source, r.page_no, r.metadata["url"]) for r in documents.orderBy("page_no").collect()] == [("http://a/x", 1, "http://a/x"), ("http://a/x", 2, "http://a/y")]
    assert [r.source for r in failures.collect()] == ["http://a/none"]
    with pytest.raises(ValueError):
        loaders.loaded_or_error(loaders.load_pages(urls.where("url LIKE '%none'"), pages)[0])
    turns = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (2, 1, " "), (1, 3, None)], "conv_id long, turn long, text string")
    made = loaders.transcripts(turns)
    assert [(r.source, r.text) for r in made.collect()] == [("1", "first\nsecond")] and loaders.transcript_chunks(made, 8, 0).count() == 2


def test_knowledge_log_replace_and_repeats(spark, tmp_path):
    kb = knowledge.KnowledgeBase(spark, str(tmp_path / "kb"))
    chunks = spark.createDataFrame([("a", "s", 0, "text"), ("b", "t", 1, "more")], knowledge.CHUNK_SCHEMA)
    assert kb.add(chunks, "realtime", at=T0) == 2 and kb.add(chunks, "realtime", new_only=True) == 0
    assert kb.add(chunks.unionByName(chunks.limit(1).withColumn("seg_id", F.lit("c"))), "realtime", new_only=True, at=T0 + dt.timedelta(hours=1)) == 1
    info = {r.tier: r for r in kb.info().collect()}
    assert (info["realtime"].n_chunks, info["realtime"].n_sources, info["realtime"].last_updated) == (3, 2, T0 + dt.timedelta(hours=1)) and not info["historical"].exists
    assert kb.add(chunks.limit(1), "realtime", replace=True) == 1 and kb.read("realtime").count() == 1
    assert kb.merge() and {r.tier for r in kb.sources().collect()} == {"historical"}
    kb.clear("historical")
    assert kb.sources().collect() == [] and kb.info().where("tier = 'historical'").first().n_chunks == 0


def test_quality_samples(spark):
    pages = spark.createDataFrame([("f", i, "ab  " if i % 2 else "") for i in range(1, 10)] + [("g", 1, "abc")], "file_name string, page_no int, text string")
    files_ = spark.createDataFrame([("f",), ("g",), ("h",)], "file_name string")
    rows = {r.file_name: r for r in sections.quality_sample(pages, files_).collect()}
    assert rows["f"].sample_n == 6 and rows["g"].nonempty_ratio_mean == 1.0 and (rows["h"].sample_n, rows["h"].nonempty_ratio_mean, rows["h"].pages) == (0, 0.0, [])
    assert rows["f"].nonempty_ratio_mean == pytest.approx(sum(0.5 for p in rows["f"].pages if p % 2) / 6) and rows["f"].pages == sorted(rows["f"].pages)


def test_quality_sample_of_repeated_and_null_pages(spark):
    rows = [("f", 1, "ab"), ("f", 1, ""), (None, 2, "a "), (None, None, "abc"), ("f", 3, None)]
    pages = spark.createDataFrame(rows, "file_name string, page_no int, text string")
    for most in (files.BROADCAST_KEYS, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(files, "BROADCAST_KEYS", most)
            found = {r.file_name: r for r in sections.quality_sample(pages).collect()}
            plan = sections.sample_pages(pages)._jdf.queryExecution().optimizedPlan().toString()
        assert ("rightHint=(strategy=broadcast)" in plan) == (most > 0)
        assert (found["f"].sample_n, found["f"].nonempty_ratio_mean, found["f"].pages) == (2, 1.0, [1, 3])
        assert (found[None].sample_n, found[None].nonempty_ratio_mean, found[None].pages) == (2, 0.75, [2])
    assert sections.quality_sample(pages.limit(0)).collect() == []


def test_boost_reads_only_what_was_cut(spark):
    segs = spark.createDataFrame([(i, "guideline" if i % 2 else "education", i) for i in range(9)] + [(1, "education", 99)], "seg_id long, doc_type string, at long")
    fused = spark.createDataFrame([(7, i, (9 - i) / 10) for i in range(8)], "query_id long, seg_id long, score double")
    want = {i: round((9 - i) / 10 * (EngineConfig().boost if i in (3, 5, 7) else 1), 10) for i in range(8)}
    got = {r.seg_id: r.score for r in retrieval.boost(fused, segs, EngineConfig(), order="at").collect()}
    assert got == pytest.approx(want)


def test_task_numbers_over_ranges(spark):
    rows = spark.createDataFrame([(s,) for s in (5, 1, 70_000, 66_000, 200_000, 7)], "seq long")
    assert {r.seq: r.task_id for r in state.with_task_ids(rows).collect()} == {1: 1, 5: 2, 7: 3, 66_000: 4, 70_000: 5, 200_000: 6}


def test_upserts_and_repeats_in_streams(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (1, 3, "c")], "id long, seq long, v string")
    log.where("seq < 3").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    streams.upsert_latest(source(), str(tmp_path / "table"), "id", "seq", str(tmp_path / "cp")).awaitTermination(120)
    log.where("seq = 3").write.mode("append").parquet(str(tmp_path / "in"))
    streams.upsert_latest(source(), str(tmp_path / "table"), "id", "seq", str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.id, r.v) for r in streams.read_latest(spark, str(tmp_path / "table")).collect()} == {(1, "c"), (2, "b")}
    docs = spark.createDataFrame([(1, T0), (1, T0 + dt.timedelta(seconds=5)), (2, T0)], "doc_id long, ts timestamp")
    rows = collect_stream(streams.without_repeats(stream(spark, tmp_path, docs, "repeats")), "repeat_rows", "append")
    assert sorted(r.doc_id for r in rows) == [1, 2]


def test_evidence_ends_in_any_time_zone(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    late = spark.createDataFrame([(1, T0, "u", "x", T0 + dt.timedelta(minutes=10)), (2, T0 + dt.timedelta(minutes=30), "u", "y", T0 + dt.timedelta(hours=9))], "evidence_id long, ts timestamp, url string, text string, expires_at timestamp")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
        rows = collect_stream(streams.evidence_lifetimes(stream(spark, tmp_path, late, "zones")), "zone_rows", "append")
        assert ("stored", 1) in [(r.event, r.evidence_id) for r in rows] and ("expired", 2) not in [(r.event, r.evidence_id) for r in rows]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_quality_report_and_settings(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([("f", 1, "ab "), ("f", 2, "")], "file_name string, page_no int, text string")
    sections.write_quality(sections.quality_sample(pages), str(tmp_path / "qc.json"))
    assert json.loads(files.read_small(spark, str(tmp_path / "qc.json"))) == {"f": {"sample_n": 2, "nonempty_ratio_mean": pytest.approx(1 / 3), "pages": [1, 2]}}
    names = ['q"{', "参考", None]
    odd = spark.createDataFrame([(n, 1, 0.5, [i]) for i, n in enumerate(names)], "file_name string, sample_n long, nonempty_ratio_mean double, pages array<int>")
    sections.write_quality(odd, str(tmp_path / "qc.json"))
    assert json.loads(files.read_small(spark, str(tmp_path / "qc.json"))) == {n or "null": {"sample_n": 1, "nonempty_ratio_mean": 0.5, "pages": [i]} for i, n in enumerate(names)}
    sections.write_quality(odd.limit(0), str(tmp_path / "qc.json"))
    assert json.loads(files.read_small(spark, str(tmp_path / "qc.json"))) == {} and len(list(tmp_path.glob("*.tmp"))) == 0
    EngineConfig().assert_internal()
    for url in ("https://api.openai.com/v1", "http://x.deepseek.com"):
        with pytest.raises(ValueError):
            EngineConfig(service_url=url).assert_internal()
        with pytest.raises(ValueError):
            adapters.HttpModel(EngineConfig(service_url=url))
    monkeypatch.setenv("DOCLOOM_THETA", "0.5")
    assert EngineConfig.from_env().theta == 0.5


def test_embedded_texts_find_each_other(spark):
    texts = spark.createDataFrame([(1, "wound care after surgery"), (2, "parking at the clinic"), (3, None)], "seg_id long, text string")
    vectors = adapters.embed(texts, adapters.HashEmbedder())
    asked = adapters.embed(spark.createDataFrame([(9, "care of a wound after surgery")], "query_id long, text string"), adapters.HashEmbedder())
    assert retrieval.dense_topk(vectors, asked, 1).first().seg_id == 1
