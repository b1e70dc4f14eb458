"""From documents to segments: routing to splitters, filtering, segment records, building the knowledge base."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import classify, splitters, text
from docloom.operators import chunking, filters, knowledge, sections
from docloom.operators.progress import Progress


def join_documents(pages: DataFrame, key: str = "file_name", order: str = "page_no", content: str = "text", metadata: str = "metadata") -> DataFrame:
    """One row per key: non-blank contents joined by blank lines, and the metadata of the first page."""
    kept = F.collect_list(F.when(text.strip(F.col(content)) != "", F.struct(F.col(order).alias("o"), F.col(content).alias("c"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(kept), lambda x: x["c"]), "\n\n").alias(content), F.min_by(metadata, order).alias(metadata))


def book_chunks(content: Column, kind: Column, size: int = 500) -> Column:
    """The splitter of a kind of book; each splitter's function only runs over the rows of its kind."""
    of = lambda name: F.when(kind == name, content)
    branch = F.when(kind == "academic", chunking.split_academic_lines(content, size)).when(kind == "drug", chunking.split_drug(content, size))
    for name, function in (("textbook", splitters.textbook_chunks), ("novel", splitters.novel_chunks), ("manual", splitters.manual_chunks), ("reference", splitters.reference_chunks)):
        branch = branch.when(kind == name, splitters.chunks_udf(function, size=size)(of(name)))
    return branch.otherwise(chunking.pack_default(content, size))


def batch_route(docs: DataFrame, order: str, content: str = "text") -> tuple[str, str | None]:
    """(route, book type) of a whole batch, from its first document of more than 100 characters (else its first)."""
    first = docs.where(text.strip(F.col(content)) != "").orderBy((F.length(content) <= 100), order).limit(1)
    head = F.substring(content, 1, 3000)
    row = first.select(classify.route(head).alias("route"), classify.book_type(F.col(content)).alias("kind")).first()
    return (row.route, row.kind if row.route == "book" else None) if row else ("generic", None)


def split_documents(docs: DataFrame, key: str = "doc_id", content: str = "text", size: int = 500, overlap: int = 50, adaptive: bool = False, batch_order: str | None = None) -> DataFrame:
    """docs -> (key, route, book_type, chunk_index, total_chunks, chunk). Every document goes its own way: books by
    their type, papers by their parts, others by separators; with batch_order all go the way of the batch's first.
    adaptive: size and overlap grow with the estimated number of chunks, except the overlap of papers. Blank documents
    are dropped and chunks filtered; the index counts the chunks that stay."""
    own_overlap = overlap
    if adaptive:
        scaled = chunking.chunk_scale(docs, content, size, overlap).first()  # one row
        size, overlap = scaled.chunk_size, scaled.chunk_overlap
    rows = docs.where(text.strip(F.col(content)) != "")
    if batch_order is not None:
        route, kind = batch_route(docs, batch_order, content)
        rows = rows.withColumn("route", F.lit(route)).withColumn("book_type", F.lit(kind).cast("string"))
    else:
        rows = rows.withColumn("route", classify.route(F.col(content)))
        rows = rows.withColumn("book_type", F.when(F.col("route") == "book", classify.book_type(F.col(content))))
    paper = splitters.chunks_udf(lambda t: [c for _, c in splitters.academic_chunks(t, size, own_overlap)])
    plain = splitters.chunks_udf(splitters.recursive_chunks, size=size, overlap=overlap)
    branches = {
        "book": book_chunks(F.col(content), F.col("book_type"), size),
        "academic": paper(F.col(content)),
        "generic": plain(F.col(content)),
    }
    out = None
    for route, chunks in branches.items():
        kept = rows.where(F.col("route") == route).select(key, "route", "book_type", filters.filter_chunks(chunks).alias("kept"))
        part = kept.select(key, "route", "book_type", F.size("kept").alias("total_chunks"), F.posexplode("kept").alias("chunk_index", "chunk"))
        out = part if out is None else out.unionByName(part)
    return out


def book_records(docs: DataFrame, kind: Column, key: str = "doc_id", content: str = "text", size: int = 500) -> DataFrame:
    """(key, book_type, chunk_index, total_chunks, chunk_size, chunk) of books: index, total and length are those before
    chunks are stripped and blank ones left out."""
    made = docs.select(key, kind.alias("book_type"), book_chunks(F.col(content), kind, size).alias("chunks"))
    rows = made.select(key, "book_type", F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "chunk"))
    return rows.select(key, "book_type", "chunk_index", "total_chunks", F.length("chunk").alias("chunk_size"), text.strip(F.col("chunk")).alias("chunk")).where("chunk <> ''")


def academic_pages(pages: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """pages(file_name, page_no, text) -> (file_name, page_no, section, chunk_index, chunk), page by page: a page with
    the marks of a paper by its parts, any other by separators (section null)."""
    marked = pages.withColumn("paper", classify.is_academic(F.col("text")))
    kind = "array<struct<section: string, chunk: string>>"

    @F.pandas_udf(kind)
    def parts(texts: pd.Series) -> pd.DataFrame:
        return texts.map(lambda t: [{"section": p, "chunk": c} for p, c in splitters.academic_chunks(t or "", size, overlap)])

    plain = splitters.chunks_udf(splitters.recursive_chunks, size=size, overlap=overlap)
    papers = marked.where("paper").select("file_name", "page_no", parts("text").alias("chunks"))
    others = marked.where("NOT paper").select("file_name", "page_no", F.transform(plain(F.col("text")), lambda c: F.struct(F.lit(None).cast("string").alias("section"), c.alias("chunk"))).alias("chunks"))
    rows = papers.unionByName(others).select("file_name", "page_no", F.posexplode("chunks").alias("chunk_index", "x"))
    return rows.select("file_name", "page_no", "x.section", "chunk_index", "x.chunk")


def with_metadata(chunks: DataFrame, metadata: str = "metadata") -> DataFrame:
    """chunks(metadata, chunk_index, total_chunks, ...): the document's metadata, and the chunk's own place over it."""
    own = F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("total_chunks"), F.col("total_chunks").cast("string"))
    given = F.map_filter(F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("chunk_index", "total_chunks"))
    return chunks.withColumn(metadata, F.map_concat(given, own))


def segments_of(pages: DataFrame, source: str | None = None, doc_type: str = "guideline", size: int = 2200, overlap: int = 200) -> DataFrame:
    """pages(file_name, page_no, text) -> segment records: sections cut into windows, each with its hash."""
    first = pages.groupBy("file_name").agg(F.min_by("text", "page_no").alias("first"))
    named = first.select("file_name", text.title(F.col("first")).alias("title"), text.doi(F.col("first")).alias("doi"))
    rows = sections.build_sections(pages).withColumn("chunks", chunking.window_chunks(F.col("text"), size, overlap)).drop("text")
    rows = rows.select("*", F.posexplode("chunks").alias("j", "text")).drop("chunks").join(named, "file_name")
    return rows.select(
        sections.segment_id(F.col("file_name"), F.col("section_id"), F.col("j"), F.col("text")).alias("seg_id"),
        "text",
        (F.lit(source) if source else F.regexp_replace("file_name", r"\.[^.]*$", "")).alias("source"),
        F.lit(doc_type).alias("doc_type"),
        "title", "doi", "section_id", "section_title", "page_start", "page_end", "file_name",
    )


def build_knowledge(
    base: knowledge.KnowledgeBase, docs: DataFrame, tier: str = "historical", source: str = "source", failures: DataFrame | None = None, adaptive: bool = True, progress: Progress | None = None
) -> dict:
    """Documents (doc_id, source, text) chunked and appended to a tier; a summary of what was added and what couldn't
    be loaded. No chunk at all is an error. progress gets the rows and bytes of documents and chunks as they pass."""
    seen = docs if progress is None else progress.stage(docs.select("doc_id", source), "documents")
    chunks = split_documents(docs, adaptive=adaptive).join(seen.select("doc_id", source), "doc_id")
    rows = chunks.select(F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), "chunk_index", "chunk")).alias("seg_id"), F.col(source).alias("source"), "chunk_index", "chunk")
    added = base.add(rows if progress is None else progress.stage(rows, "chunks"), tier)
    if progress is not None:
        progress.finished()
    failed = 0 if failures is None else failures.count()
    return {"tier": tier, "chunks": added, "sources": base.read(tier).select("source").distinct().count(), "failed_sources": failed}
