import pytest
from pyspark.sql import functions as F

from docloom.operators import ingest, knowledge


def test_routes_and_knowledge(spark, tmp_path):
    plain = "This is a plain text about wounds that heal. " * 30
    rows = [(1, "s", plain), (2, "s", "目录 前言 习题\n第一章 开头\n" + "课文内容很多很多很多很多很多很多。" * 20), (3, "t", "Title\nAbstract: all about it Keywords: k\n1 Intro\nThe body of the paper is long enough.\n2 End\nThe end of the paper comes here."), (4, "t", " \n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = ingest.split_documents(df).collect()
    assert {(r.doc_id, r.route, r.book_type) for r in out} == {(1, "generic", None), (2, "book", "textbook"), (3, "academic", None)}
    assert all(len(r.chunk) >= 15 for r in out)
    base = knowledge.KnowledgeBase(spark, str(tmp_path / "kb"))
    failures = spark.createDataFrame([("gone", "not found")], "source string, error string")
    assert ingest.build_knowledge(base, df, failures=failures) == {"tier": "historical", "chunks": len(out), "sources": 2, "failed_sources": 1}
    with pytest.raises(ValueError):
        ingest.build_knowledge(base, df.where("doc_id = 4"))


def test_batch_route_and_scaled_size(spark):
    rows = [(1, "short"), (2, "目录 前言 习题\n第一章 开头\n" + "课文内容很多很多很多很多很多很多。" * 20), (3, "This is a plain text about wounds that heal. " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ingest.batch_route(df, "doc_id") == ("book", "textbook") and ingest.batch_route(df.where("doc_id = 1"), "doc_id") == ("generic", None) and ingest.batch_route(df.limit(0), "doc_id") == ("generic", None)
    assert {r.route for r in ingest.split_documents(df, batch_order="doc_id").select("route").distinct().collect()} == {"book"}
    many = df.where("doc_id = 3").withColumn("text", F.repeat("text", 20))
    lengths = {a: max(len(r.chunk) for r in ingest.split_documents(many, size=20, overlap=5, adaptive=a).collect()) for a in (False, True)}
    assert lengths[False] <= 20 < lengths[True] <= 60  # 13,500 chunks of 20 are estimated, so the size grows by 2.7
    one = ingest.split_documents(df).where("doc_id = 3").collect()
    assert {r.total_chunks for r in one} == {len(one)} and sorted(r.chunk_index for r in one) == list(range(len(one)))


def test_academic_pages(spark):
    pages = spark.createDataFrame([("f", 1, "Title\nAbstract: all about it Keywords: k\n1 Intro\nbody"), ("f", 2, "plain words " * 80), ("f", 3, None)], "file_name string, page_no int, text string")
    rows = [(r.page_no, r.section) for r in ingest.academic_pages(pages).orderBy("page_no", "chunk_index").collect()]
    assert rows[:3] == [(1, "title_author_info"), (1, "abstract"), (1, "main_content")] and set(rows[3:]) == {(2, None)} and len(rows) > 4


def test_segments(spark):
    pages = spark.createDataFrame([("a.pdf", 1, "Guideline for the care of wounds\ndoi 10.1234/x1\n1 Scope of it\nbody"), ("a.pdf", 2, "more")], "file_name string, page_no int, text string")
    row = ingest.segments_of(pages).first()
    assert (row.source, row.section_title, row.page_start, row.page_end, row.title, row.doi) == ("a", "Scope of it", 1, 2, "Guideline for the care of wounds", "10.1234/x1")
    assert len(row.seg_id) == 40


def test_join_documents(spark):
    df = spark.createDataFrame([("f", 2, "b", {"k": "2"}), ("f", 1, "a", {"k": "1"}), ("f", 3, " ", {"k": "3"})], "file_name string, page_no int, text string, metadata map<string,string>")
    row = ingest.join_documents(df).first()
    assert (row.text, row.metadata) == ("a\n\nb", {"k": "1"})
