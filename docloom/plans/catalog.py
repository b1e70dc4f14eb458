"""All queries of the engine's own operators over the test tables, by name, with their SQL for DuckDB.

Inputs are whole tables; where the tables lack the text an operator needs, both sides derive the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions import classify, splitters, text
from docloom.operators import chunking, embedding, filters, flow, index, ingest, intervals, knowledge, outbox, progress, retrieval, sections, state
from docloom.operators.vectors import VectorCells
from docloom.plans.oracle import ORACLE_SQL as ORACLE_SQL
from docloom.plans.oracle import CLEAN_CASES, LINK_CASES, TITLES
from docloom.sources import adapters, crawl, files, loaders

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 5 == 0, "guideline").otherwise("education")
    return d.select(F.col("doc_id").alias("seg_id"), "text", "source", kind.alias("doc_type"), (F.col("doc_id") % 10 + 2015).cast("int").alias("pub_year"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seg_id"), "embedding")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = questions(spark, sf_dir).select(F.col("query_id").alias("seg_id"))
    return vectors(spark, sf_dir).join(ids, "seg_id").withColumnRenamed("seg_id", "query_id")


def masking_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    parts = ["call ", F.lpad(key, 11, "1"), " id ", F.lpad(key, 17, "2"), "X on ", F.date_format("o_orderdate", "yyyy-MM-dd"), " at 9:30, mail u", key, "@mail.example.org or ", F.lpad(key, 7, "3"), " times ", key]
    return o.select("o_orderkey", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))


#: Sentences for orders by key, with one, two or no label, and near misses.
POLICY = (
    "Where can I get a refund for the parking fee",
    "I will sue the clinic in court",
    "Please give me the doctor phone number",
    "Can I fake the form to bypass the line",
    "What are the rules about suing",
    "Is there a rule on personal info and billing",
    "When can I shower after the operation",
    "A regulation says the physician  address is public",
)


def policy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentence = F.get(F.array(*[F.lit(p) for p in POLICY]), (F.col("o_orderkey") % 8).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(sentence, F.lit(" "), F.col("o_orderkey").cast("string")).alias("text"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of one file per source, page numbers by id; every third starts with a heading."""
    n = F.col("doc_id")
    number = F.when(n % 7 == 0, F.concat(F.lit("1.2.3.4."), (n % 3).cast("string"))).otherwise(F.concat((n % 5 + 1).cast("string"), F.lit("."), (n % 2).cast("string")))
    name = F.when(n % 11 == 0, "ab").otherwise("Scope of part")
    head = F.concat(F.lit("Page 1 of 9\n"), number, F.lit(" "), name, F.lit("\n"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("file_name"), F.col("doc_id").alias("page_no"), F.when(n % 3 == 0, F.concat(head, F.col("text"))).otherwise(F.col("text")).alias("text"))


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as review actions: signup opens, click approves (every third without a text), error replaces."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "error", "replace").otherwise("other")
    final = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("text "), F.col("event_id").cast("string")))
    draft = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("draft "), F.col("event_id").cast("string")))
    return e.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), "ts", action.alias("action"), draft.alias("draft"), final.alias("final_text"))


@query
def hybrid_retrieve(spark, sf_dir):
    asked = questions(spark, sf_dir).select("query_id", text.abstract_query(text.deidentify(F.col("text"))).alias("text"))
    return retrieval.hybrid_retrieve(segments(spark, sf_dir), asked, vectors(spark, sf_dir), question_vectors(spark, sf_dir))


@query
def tfidf_sparse_topk(spark, sf_dir):
    return retrieval.sparse_topk(segments(spark, sf_dir), questions(spark, sf_dir))


@query
def tfidf_bigram_topk(spark, sf_dir):
    return retrieval.sparse_topk(segments(spark, sf_dir), questions(spark, sf_dir), ngram_max=2, min_df=2)


@query
def tfidf_vocabulary(spark, sf_dir):
    s = segments(spark, sf_dir).select("seg_id", "text")
    terms = retrieval.segment_terms(retrieval.spread(s), ngram_max=2).select(F.explode("terms").alias("term"))
    vocab = retrieval.with_idf(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), s.count())
    return vocab.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def dense_topk(spark, sf_dir):
    return retrieval.dense_topk(vectors(spark, sf_dir), question_vectors(spark, sf_dir))


@query
def minmax_normalize(spark, sf_dir):
    return retrieval.minmax(retrieval.dense_topk(vectors(spark, sf_dir), question_vectors(spark, sf_dir))).select("query_id", "seg_id", "norm")


def _channels(spark, sf_dir):
    return retrieval.dense_topk(vectors(spark, sf_dir), question_vectors(spark, sf_dir)), retrieval.sparse_topk(segments(spark, sf_dir), questions(spark, sf_dir))


@query
def weighted_fusion(spark, sf_dir):
    return retrieval.fuse(*_channels(spark, sf_dir), EngineConfig())


@query
def guideline_boost(spark, sf_dir):
    return retrieval.boost(retrieval.fuse(*_channels(spark, sf_dir), EngineConfig()), segments(spark, sf_dir), EngineConfig())


@query
def theta_gate(spark, sf_dir):
    return retrieval.theta_gate(guideline_boost(spark, sf_dir), questions(spark, sf_dir))


@query
def tiered_search_dedupe(spark, sf_dir):
    d = docs_of(spark, sf_dir).select(F.col("doc_id").alias("seg_id"), "text", F.when(F.col("doc_id") % 4 == 0, "realtime").otherwise("historical").alias("tier"))
    hits = retrieval.dense_topk(vectors(spark, sf_dir), question_vectors(spark, sf_dir), 24).join(d, "seg_id")
    return retrieval.tiered_search(hits)


@query
def deidentify_documents(spark, sf_dir):
    masked = text.deidentify(F.col("text"))
    return docs_of(spark, sf_dir).select("doc_id", F.sha1(masked).alias("masked_sha1"), F.length(masked).cast("long").alias("n_chars"))


@query
def deidentify_synthetic(spark, sf_dir):
    return masking_text(spark, sf_dir).select("o_orderkey", text.deidentify(F.col("text")).alias("masked"))


@query
def abstract_query(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", text.abstract_query(F.col("text")).alias("abstract"))


@query
def trim_words(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", text.trim_to_words(F.col("text"), 25).alias("trimmed"))


@query
def build_prompt(spark, sf_dir):
    hits = guideline_boost(spark, sf_dir)
    s = segments(spark, sf_dir)
    line = text.local_line(F.col("source"), F.col("pub_year"), F.col("text")).alias("line")
    lines = hits.join(s, "seg_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line))), lambda x: x["line"]).alias("lines"))
    rows = questions(spark, sf_dir).join(lines, "query_id", "left")
    return rows.select("query_id", text.prompt(F.coalesce("lines", F.array().cast("array<string>")), text.deidentify(F.col("text"))).alias("prompt"))


@query
def classify_unsuitable(spark, sf_dir):
    return policy_text(spark, sf_dir).select("o_orderkey", F.array_join(classify.unsuitable_labels(F.col("text")), ",").alias("labels"))


def _marked(spark, sf_dir):
    """Documents with, by id, words that classifiers look for."""
    mark = F.get(F.array(*[F.lit(x) for x in ("", " 目录 前言 ", " Abstract: x ", " 第一章 习题 ", " 小说 Copyright © ", " 摘要 关键词 目录 前言 ", " 手册 本书 读者 ", " 药 ")]), (F.col("doc_id") % 8).cast("int"))
    inside = F.concat(F.substring("text", 1, 1900), mark, F.substring("text", 1901, 1 << 30))
    return docs_of(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 16 < 8, F.concat(mark, "text")).otherwise(inside).alias("text"))


@query
def is_academic(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", classify.is_academic(F.col("text")).alias("is_academic"))


@query
def is_book(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", classify.is_book(F.col("text")).alias("is_book"), classify.route(F.col("text")).alias("route"))


@query
def book_type(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", classify.book_type(F.col("text")).alias("book_type"))


@query
def normalize_text(spark, sf_dir):
    raw = F.concat(F.lit("\r\n\n\n\n"), F.replace("text", F.lit(". "), F.lit(".-\n \n\n\n")), F.lit("well-\nknown é-\nop \n "))
    return docs_of(spark, sf_dir).select("doc_id", F.sha1(text.normalize(raw)).alias("normal_sha1"), F.length(text.normalize(raw)).cast("long").alias("n_chars"))


@query
def title_doi(spark, sf_dir):
    page = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\nClinical Guideline for part "), F.col("doc_id").cast("string"), F.lit("\ndoi 10.1234/AbC-"), F.col("doc_id").cast("string"), F.lit(" x"))).otherwise(""))
    return docs_of(spark, sf_dir).select("doc_id", text.title(page).alias("title"), text.doi(page).alias("doi"))


@query
def qc_ratio(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.round(text.nonspace_ratio(F.col("text")), 6).alias("ratio"))


@query
def find_headings(spark, sf_dir):
    return sections.find_headings(doc_pages(spark, sf_dir))


@query
def build_sections(spark, sf_dir):
    s = sections.build_sections(doc_pages(spark, sf_dir))
    return s.select("file_name", "section_id", "section_title", "page_start", "page_end", F.length("text").cast("long").alias("n_chars"), F.sha1("text").alias("text_sha1"))


@query
def window_chunks(spark, sf_dir):
    return chunking.explode_chunks(docs_of(spark, sf_dir), chunking.window_chunks(F.col("text")), "doc_id").select("doc_id", "chunk_index", F.sha1("chunk").alias("chunk_sha1"))


@query
def segment_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", "source", F.posexplode(chunking.window_chunks(F.col("text"))).alias("j", "chunk"))
    return rows.select("doc_id", "j", sections.segment_id(F.col("source"), F.lit("0"), F.col("j"), F.col("chunk")).alias("seg_id"))


def _headed(name, every):
    """Whole documents with headings of a kind before some of their lines."""

    def titled(line, i):
        place, heads = F.col("doc_id") + i, F.array(*[F.lit(x) for x in TITLES[name]])
        return F.when(place % every == 1, F.concat(F.get(heads, (F.floor(place / every) % len(TITLES[name])).cast("int")), F.lit("\n"), line)).otherwise(line)

    return lambda spark, sf_dir: docs_of(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), titled), "\n").alias("text"))


def _chunked(chunks, source=docs_of):
    def run(spark, sf_dir):
        return chunking.explode_chunks(source(spark, sf_dir), chunks(F.col("text")), "doc_id").select("doc_id", "chunk_index", F.sha1("chunk").alias("chunk_sha1"), F.length("chunk").cast("long").alias("n_chars"))

    return run


#: Lines as paragraphs, as the tables have no blank lines.
QUERIES["pack_paragraphs"] = _chunked(lambda t: chunking.pack_paragraphs(F.replace(t, F.lit("\n"), F.lit("\n\n"))))
QUERIES["pack_sentences"] = _chunked(chunking.pack_sentences)
QUERIES["pack_words"] = _chunked(chunking.pack_words)
QUERIES["pack_lines"] = _chunked(chunking.pack_lines)
QUERIES["pack_default"] = _chunked(chunking.pack_default)
QUERIES["split_references"] = _chunked(lambda t: chunking.split_references(F.regexp_replace(t, r"\. ", ".\n[7] ")))
QUERIES["split_abstract"] = _chunked(lambda t: chunking.split_abstract(F.regexp_replace(t, "^([A-Z][a-z]*) ", "$1 Abstract: ")))
QUERIES["split_drug"] = _chunked(lambda t: chunking.split_drug(F.replace(t, F.lit(". "), F.lit("【性状】"))))
QUERIES["academic_lines"] = _chunked(lambda t: chunking.split_academic_lines(F.regexp_replace(t, r"\. ", ".\nRESULTS\n")))
QUERIES["recursive_chunks"] = _chunked(splitters.chunks_udf(splitters.recursive_chunks))
QUERIES["sentence_chunks"] = _chunked(splitters.chunks_udf(splitters.sentence_chunks, size=500, overlap=50))
QUERIES["length_chunks"] = _chunked(splitters.chunks_udf(splitters.length_chunks, size=500, overlap=50))
QUERIES["main_content_chunks"] = _chunked(splitters.chunks_udf(splitters.main_content), _headed("main", 4))
QUERIES["textbook_chunks"] = _chunked(splitters.chunks_udf(splitters.textbook_chunks), _headed("textbook", 2))
QUERIES["novel_chunks"] = _chunked(splitters.chunks_udf(splitters.novel_chunks), _headed("novel", 2))
QUERIES["manual_chunks"] = _chunked(splitters.chunks_udf(splitters.manual_chunks), _headed("manual", 2))
QUERIES["reference_chunks"] = _chunked(splitters.chunks_udf(splitters.reference_chunks), _headed("reference", 2))
QUERIES["large_document_chunks"] = _chunked(splitters.chunks_udf(splitters.large_document_chunks))
QUERIES["academic_chunks"] = _chunked(splitters.chunks_udf(lambda t: [c for _, c in splitters.academic_chunks(t)]))


@query
def filter_small_chunks(spark, sf_dir):
    rows = chunking.explode_chunks(docs_of(spark, sf_dir), F.split("text", r"[.,]"), "doc_id")
    return rows.select("doc_id", "chunk_index", filters.keep_chunk(F.col("chunk")).alias("kept"), filters.keep_simple(F.col("chunk")).alias("kept_simple"))


@query
def drop_contained_neighbours(spark, sf_dir):
    kept = filters.filter_chunks(F.split("text", r"[.,]"))
    return docs_of(spark, sf_dir).select("doc_id", F.size(kept).cast("long").alias("n_kept"), F.sha1(F.array_join(kept, "|")).alias("kept_sha1"))


@query
def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha1(text.clean_html(F.col("html"))).alias("text_sha1"), F.length(text.clean_html(F.col("html"))).cast("long").alias("n_chars"))


def _with_cases(spark, sf_dir, cases):
    """Every page's number with each of a fixed list of cases: page_id, n, x."""
    rows = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(x).alias("x")) for n, (x, _) in enumerate(cases)])
    return table(spark, sf_dir, "pages").select("page_id", F.explode(rows).alias("c")).select("page_id", "c.n", "c.x")


@query
def clean_html_cases(spark, sf_dir):
    page = F.concat("x", F.lit("<p>"), F.col("page_id").cast("string"), F.lit("</p>"))
    return _with_cases(spark, sf_dir, CLEAN_CASES).select("page_id", "n", text.clean_html(page).alias("text"))


@query
def resolve_links(spark, sf_dir):
    base = F.concat(F.lit("http://h"), (F.col("page_id") % 7).cast("string"), F.lit(".example/a/d"), F.col("page_id").cast("string"), F.lit("/e?q=1#t"))
    return _with_cases(spark, sf_dir, LINK_CASES).select("page_id", "n", files.resolve(base, F.col("x")).alias("link"))


@query
def extract_links(spark, sf_dir):
    return files.crawl_frontier(table(spark, sf_dir, "pages").select("url", "html"))


@query
def token_estimate(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query
def file_limits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".TXT").otherwise(".doc")).alias("path"), (F.col("n_chars") * (F.col("doc_id") % 2000) * 10).alias("length"))
    return files.file_limits(d)


@query
def source_dispatch(spark, sf_dir):
    n = F.col("doc_id") % 4
    source = F.when(n == 0, F.concat(F.lit("https://a.example/"), F.col("doc_id").cast("string"))).when(n == 3, "list.pdf").otherwise("list.txt")
    head = F.when(n == 1, F.concat(F.lit("one\n http://b.example\n"), F.col("text"))).otherwise(F.col("text"))
    return docs_of(spark, sf_dir).select("doc_id", files.source_type(source, head).alias("source_type"))


@query
def url_list(spark, sf_dir):
    lines = table(spark, sf_dir, "pages").select(F.explode(F.array(F.concat(F.lit("  "), F.col("url"), F.lit(" ")), F.concat(F.lit("see "), F.col("url")))).alias("value"))
    return files.url_list(lines)


@query
def chunk_scale(spark, sf_dir):
    return chunking.chunk_scale(docs_of(spark, sf_dir), most=100)


@query
def review_latest(spark, sf_dir):
    return state.review_latest(review_events(spark, sf_dir)).select("request_id", "seq", "draft", "status", "final_text")


@query
def review_pending(spark, sf_dir):
    numbered = state.with_task_ids(state.review_latest(review_events(spark, sf_dir)))
    return state.pending(numbered.withColumn("status", F.when(F.col("request_id") % 2 == 0, "PENDING").otherwise(F.col("status"))), 20).select("task_id", "request_id", "seq")


@query
def deliver_status(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id")).distinct().unionByName(spark.range(1).select((F.col("id") - 5).alias("request_id")))
    return state.deliver(users, state.review_latest(review_events(spark, sf_dir)))


@query
def exposure_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "signup", "register").when(F.col("event_type") == "purchase", "deliver").when(F.col("event_type") == "view", "view").otherwise("other")
    rows = state.exposure_latest(e.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), "ts", action.alias("action")))
    return rows.select("request_id", "delivered", "viewed", F.date_format("delivered_at", "yyyy-MM-dd HH:mm:ss").alias("delivered_at"), F.date_format("viewed_at", "yyyy-MM-dd HH:mm:ss").alias("viewed_at"))


@query
def audit_funnel(spark, sf_dir):
    return state.funnel(table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.col("user_id").alias("request_id")))


@query
def audit_session_windows(spark, sf_dir):
    rows = state.sessions(table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")))
    return rows.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"), "n")


@query
def ttl_alive(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("ts").cast("timestamp") + F.expr("INTERVAL 600 SECONDS")).alias("expires_at"), F.col("ts").cast("timestamp").alias("ts"))
    now = F.col("ts") + F.when(F.col("event_id") % 3 == 0, F.expr("INTERVAL 600 SECONDS")).when(F.col("event_id") % 3 == 1, F.expr("INTERVAL '600.000001' SECOND")).otherwise(F.expr("INTERVAL 5 SECONDS"))
    return filters.alive(e, now).select("event_id")


def _tiers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "text", F.when(F.col("doc_id") % 4 == 0, "realtime").otherwise("historical").alias("tier"))


@query
def kb_status(spark, sf_dir):
    return knowledge.status(_tiers(spark, sf_dir))


@query
def kb_merge(spark, sf_dir):
    """Both tiers written, merged and asked for what they hold."""
    base = knowledge.KnowledgeBase(spark, files.scratch_folder(spark))
    d = table(spark, sf_dir, "documents").select(F.sha1(F.col("doc_id").cast("string")).alias("seg_id"), "source", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk"), "doc_id")
    base.add(d.where("doc_id % 4 <> 0"), "historical")
    base.add(d.where("doc_id % 4 = 0"), "realtime")
    base.merge()
    return base.info().select("tier", "exists", "n_sources", "n_chunks", "n_chars")


@query
def chunk_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.explode(chunking.window_chunks(F.col("text"))).alias("chunk"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(F.length("chunk")), 6).alias("mean_chars"), F.max(F.length("chunk")).cast("long").alias("max_chars"))


@query
def quality_sample(spark, sf_dir):
    pages = doc_pages(spark, sf_dir)
    named = pages.select("file_name").distinct().unionByName(spark.range(1).select(F.lit("nothing.pdf").alias("file_name")))
    rows = sections.quality_sample(pages, named)
    return rows.select("file_name", "sample_n", F.round("nonempty_ratio_mean", 6).alias("nonempty_ratio_mean"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query
def book_records(spark, sf_dir):
    rows = ingest.book_records(_headed("textbook", 2)(spark, sf_dir), F.lit("textbook"))
    return rows.select("doc_id", "chunk_index", "total_chunks", "chunk_size", F.sha1("chunk").alias("chunk_sha1"))


def _index(spark, sf_dir):
    built = index.RetrievalIndex(spark, files.scratch_folder(spark))
    built.build(segments(spark, sf_dir), vectors(spark, sf_dir), index.IndexConfig(embedding_model="table", embedding_size=64))
    return built


@query
def indexed_sparse_topk(spark, sf_dir):
    return _index(spark, sf_dir).sparse_topk(questions(spark, sf_dir))


@query
def indexed_retrieve(spark, sf_dir):
    return _index(spark, sf_dir).retrieve(questions(spark, sf_dir), question_vectors(spark, sf_dir))


@query
def index_grown_topk(spark, sf_dir):
    """An index of most segments, some of them in an older wording, to which the others and the new wordings are added; then
    made one part."""
    segs, old = segments(spark, sf_dir), F.col("seg_id") % 10
    built = index.RetrievalIndex(spark, files.scratch_folder(spark))
    built.build(segs.where(old < 9).withColumn("text", F.when(old == 8, F.concat(F.lit("older wording "), "text")).otherwise(F.col("text"))))
    built.add(segs.where(old >= 8))
    built.compact()
    return built.sparse_topk(questions(spark, sf_dir))


@query
def dense_cells_topk(spark, sf_dir):
    return VectorCells.build(vectors(spark, sf_dir), files.scratch_folder(spark)).topk(question_vectors(spark, sf_dir))


@query
def latent_topk(spark, sf_dir):
    """Texts to vectors to hits: singular directions of the segments, their embeddings kept by content, and the questions'."""
    segs, asked = segments(spark, sf_dir), questions(spark, sf_dir)
    embedder = embedding.fit(segs)
    store = embedding.EmbeddingStore(spark, files.scratch_folder(spark))
    of_segments = store.embedded(segs.select("seg_id", "text"), embedder, embedder.name).select("seg_id", "embedding")
    return retrieval.dense_topk(of_segments, adapters.embed(asked, embedder).select("query_id", "embedding"))


@query
def session_events(spark, sf_dir):
    """Every session with the events of its user in it, as intervals."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"))
    found = state.sessions(table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "6 hours")
    spans = found.select("user_id", F.unix_micros("session_start").alias("start"), F.unix_micros("session_end").alias("end"))
    met = intervals.interval_join(spans, e.withColumn("end", F.col("start") + 1), ["user_id"])
    return met.select("user_id", F.col("left.start").alias("session_us"), F.col("right.event_id").alias("event_id"))


@query
def section_pages(spark, sf_dir):
    """Every section with the pages of its file that it covers."""
    pages = doc_pages(spark, sf_dir)
    found = sections.build_sections(pages).select("file_name", "section_id", F.col("page_start").alias("start"), (F.col("page_end") + 1).alias("end"))
    met = intervals.interval_join(found, pages.select("file_name", F.col("page_no").alias("start"), (F.col("page_no") + 1).alias("end")), ["file_name"])
    return met.groupBy("file_name", F.col("left.section_id").alias("section_id"), F.col("left.start").alias("page_start")).agg(F.count(F.lit(1)).alias("n_pages"), F.max("right.start").cast("long").alias("last_page"))


@query
def crawl_progress(spark, sf_dir):
    """Stages of a pass over the pages, counted while it writes."""
    seen = progress.Progress(spark)
    pages = seen.stage(table(spark, sf_dir, "pages").select("url", "html"), "pages")
    files.kept(seen.stage(files.crawl_frontier(pages), "links"))
    seen.finished()
    return seen.table()


@query
def index_info(spark, sf_dir):
    return _index(spark, sf_dir).info().select("exists", "n_segments", "n_terms", "n_vectors", (F.col("n_bytes") > 0).alias("has_bytes"))


def site_pages(spark, sf_dir):
    """Pages of seven hosts; each links to the seventh and fourteenth page after it, of its own host, and to others."""
    n = F.col("page_id")
    link = lambda path: F.concat(F.lit('<a href="'), path, F.lit('">x</a> '))
    at = lambda k: F.concat(F.lit("/p"), (n + k).cast("string"))
    other = F.concat(F.lit("http://h"), ((n + 1) % 7).cast("string"), F.lit(".example/p"), (n + 1).cast("string"))
    url = F.concat(F.lit("http://h"), (n % 7).cast("string"), F.lit(".example/p"), n.cast("string"))
    return table(spark, sf_dir, "pages").select(n, url.alias("url"), F.concat(link(at(7)), link(other), link(at(14)), link(at(7)), F.col("html")).alias("html"))


def source_files(spark, sf_dir):
    """Documents as files of three kinds, the PDFs with a form feed for every full stop, and one list of URLs."""
    n = F.col("doc_id")
    path = F.concat(F.lit("d"), n.cast("string"), F.when(n % 3 == 0, ".txt").when(n % 3 == 1, ".pdf").otherwise(".doc"))
    body = F.when(n % 3 == 1, F.replace("text", F.lit(". "), F.lit("\f"))).otherwise(F.col("text"))
    listed = spark.range(1).select(F.lit("list.txt").alias("path"), F.encode(F.lit("one\n http://h1.example/p1 \nhttp://h2.example/none\n"), "utf-8").alias("content"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.encode(body, "utf-8").alias("content")).unionByName(listed)


def _loaded(spark, sf_dir):
    pages, found = site_pages(spark, sf_dir), source_files(spark, sf_dir)
    extra = spark.range(3).select(F.get(F.array(*[F.lit(x) for x in ("http://none.example/x", "gone.txt", "list.txt")]), F.col("id").cast("int")).alias("source"))
    asked = pages.where("page_id % 5 = 0").select(F.col("url").alias("source")).unionByName(found.select(F.col("path").alias("source"))).unionByName(extra)
    return loaders.load_sources(asked, pages, found, crawl=True)


@query
def crawl_source(spark, sf_dir):
    """All pages as seeds of the crawl data source, with their children."""
    pages, folder = site_pages(spark, sf_dir), files.scratch_folder(spark)
    crawl.write_pages(pages, f"{folder}/pages")
    files.write_small(spark, f"{folder}/seeds.txt", "".join(f"{r.url}\n" for r in pages.select("url").toLocalIterator()))
    crawl.register(spark)
    found = spark.read.format("crawl").options(path=f"{folder}/pages", seed_file=f"{folder}/seeds.txt").load()
    return found.select("seed", "ord", "url", F.length("html").cast("long").alias("n_chars"))


@query
def load_documents(spark, sf_dir):
    documents, _ = _loaded(spark, sf_dir)
    return documents.select("source", "page_no", F.length("text").cast("long").alias("n_chars"), F.sha1("text").alias("text_sha1"))


@query
def failed_sources(spark, sf_dir):
    _, failures = _loaded(spark, sf_dir)
    return failures


@query
def transcripts(spark, sf_dir):
    return loaders.transcripts(table(spark, sf_dir, "conversations")).select("source", F.length("text").cast("long").alias("n_chars"), F.sha1("text").alias("text_sha1"))


@query
def review_by_request(spark, sf_dir):
    asked = spark.range(40).select((F.col("id") * 3).alias("request_id"))
    return flow.by_request(state.review_latest(review_events(spark, sf_dir)), asked).select("request_id", "seq", "status", "final_text")


def _asked_twice(spark, sf_dir):
    """All benchmark items as questions, in two batches that share an outbox, the first of them coming again; the model
    never answers twice the same."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.col("item_id").alias("seq"), F.concat(F.lit("u"), (F.col("item_id") % 3).cast("string")).alias("user_id"), F.col("text").alias("query"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    hits, segs = files.kept(guideline_boost(spark, sf_dir)), segments(spark, sf_dir)
    box = outbox.Outbox(spark, files.scratch_folder(spark))
    for k in (0, 1, 0):
        flow.ask(items.where(F.col("request_id") % 2 == k), hits, segs, adapters.VaryingModel(), outbox=box, batch=f"batch {k}")
    return flow.asked(box)


@query
def ask_audit(spark, sf_dir):
    return _asked_twice(spark, sf_dir).audit.select("request_id", "ord", "event", "payload")


@query
def ask_agreement(spark, sf_dir):
    """Answers, review events, the queue and the audit trail of each question side by side."""
    made = _asked_twice(spark, sf_dir)
    chars = made.audit.where("event = 'draft_generated'").select("request_id", F.get_json_object("payload", "$.chars").cast("int").alias("chars"))
    reviews = made.reviews.select("request_id", F.col("draft").alias("reviewed"))
    queue = made.queue.select("request_id", "task_id", F.col("draft").alias("queued"), "status")
    rows = made.answers.select("request_id", "draft").join(reviews, "request_id").join(queue, "request_id").join(chars, "request_id")
    same = (F.col("draft") == F.col("reviewed")) & (F.col("draft") == F.col("queued")) & (F.length("draft") == F.col("chars"))
    return rows.select("request_id", "task_id", "status", same.alias("same"))


@query
def deliver_events(spark, sf_dir):
    """Every user asks for a delivery: the events that this leaves."""
    users = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("request_id")).agg(F.max("event_id").alias("seq"), F.max("ts").alias("ts"))
    _, exposures, audit = flow.deliver(users, state.review_latest(review_events(spark, sf_dir)))
    return exposures.select("request_id", F.col("action").alias("event"), F.lit(None).cast("string").alias("payload")).unionByName(audit.select("request_id", "event", "payload"))


@query
def evidence_get(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("text"))
    later = F.when(F.col("seq") % 3 == 0, F.expr("INTERVAL 600 SECONDS")).when(F.col("seq") % 3 == 1, F.expr("INTERVAL '600.000001' SECOND")).otherwise(F.expr("INTERVAL 5 SECONDS"))
    asked = e.select(F.col("seq").alias("ask"), F.unix_millis("ts").alias("evidence_id"), (F.col("ts") + later).alias("now"))
    return flow.get_evidence(asked, flow.put_evidence(e)).select("ask", "evidence_id", "text")


@query
def segment_files(spark, sf_dir):
    """Segments written as JSON Lines and loaded again."""
    path = files.scratch_folder(spark)
    files.write_segments(segments(spark, sf_dir).withColumn("seg_id", F.col("seg_id").cast("string")), path)
    return files.load_segments(spark, path, missing_ok=False).select("seg_id", "source", "doc_type", "pub_year", F.sha1("text").alias("text_sha1"))


@query
def demo_segments(spark, sf_dir):
    """All documents as a segment file that is loaded, and a missing file, which gives the demonstration segments."""
    folder, segs = files.scratch_folder(spark), segments(spark, sf_dir)
    rows = segs.withColumn("seg_id", F.col("seg_id").cast("string")).withColumn("category", F.lit("general"))
    files.write_segments(rows, f"{folder}/segments")
    both = files.load_or_demo(spark, f"{folder}/segments").select("seg_id", "source", "doc_type", "pub_year", "category", "text")
    both = both.unionByName(files.load_or_demo(spark, f"{folder}/missing").select("seg_id", "source", "doc_type", "pub_year", "category", "text"))
    return both.select("seg_id", "source", "doc_type", "pub_year", "category", F.length("text").cast("long").alias("n_chars"))


@query
def join_documents(spark, sf_dir):
    pages = doc_pages(spark, sf_dir).withColumn("metadata", F.create_map(F.lit("page"), F.col("page_no").cast("string")))
    blank = pages.withColumn("text", F.when(F.col("page_no") % 10 == 3, " \n").otherwise(F.col("text")))
    return ingest.join_documents(blank).select("file_name", F.col("metadata")["page"].alias("first_page"), F.length("text").cast("long").alias("n_chars"), F.sha1("text").alias("text_sha1"))


@query
def drop_blank(spark, sf_dir):
    return filters.drop_blank(docs_of(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 7 == 2, " \t\n").otherwise(F.col("text")))).select("doc_id")


@query
def chunk_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("metadata", F.create_map(F.lit("lang"), F.col("lang"), F.lit("chunk_index"), F.lit("old")))
    rows = d.select("doc_id", "metadata", chunking.window_chunks(F.col("text")).alias("c")).select("doc_id", "metadata", F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "chunk"))
    return ingest.with_metadata(rows).select("doc_id", "chunk_index", F.to_json("metadata").alias("metadata"))


class _FiveItems:
    """More items than are asked for, with fields over their limits."""

    def search(self, query: str, k: int) -> list[dict]:
        return [{"title": f"{i}" * 300, "url": "u" * 600, "text": (query + " ") * 200} for i in range(5)]


@query
def external_evidence(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.abstract_query(F.col("text")).alias("abstract"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("now"))
    found = adapters.search(asked, _FiveItems())
    return found.select("query_id", "ord", F.sha1("title").alias("title_sha1"), F.length("url").cast("long").alias("url_chars"), F.sha1("text").alias("text_sha1"), F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))
