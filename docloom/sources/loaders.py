"""From sources to documents: files, pages and their children, lists of URLs, transcripts.

Documents have (source, page_no, text, metadata). What can't be loaded is a row of failures(source, error), and only a
batch of which nothing can be loaded is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import splitters
from docloom.functions.text import clean_html, strip
from docloom.sources.adapters import PageExtractor, PlainPages
from docloom.sources.files import MAX_LINKS, crawl_frontier, source_type

DOCUMENTS = "source string, page_no int, text string, metadata map<string,string>"
FAILURES = "source string, error string"
#: A PDF with fewer characters in all is read again as images.
SCANNED = 1000
ENCODINGS = ("utf-8", "gb18030")


def decode_text(content: bytes) -> str:
    """By byte order mark, else the first encoding that fits, else Latin-1, which fits everything."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def _read_file(path: str, content: bytes, extractor: PageExtractor, scanned: PageExtractor | None) -> list[tuple[int, str, dict]]:
    """(page number, text, metadata) of one file, by its extension."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    name = {"file_name": path.rsplit("/", 1)[-1]}
    if kind == "txt":
        return [(1, decode_text(content), name)]
    if kind != "pdf":
        raise ValueError(f"unsupported file type: {kind or 'none'}")
    pages = [(n, text, name | {"page": str(n)}) for n, text in enumerate(extractor.pages(content), 1)]
    if scanned is not None and sum(len(text) for _, text, _ in pages) < SCANNED:
        try:
            seen = [(n, text, name | {"page": str(n), "ocr": "True"}) for n, text in enumerate(scanned.pages(content), 1) if text.strip()]
        except Exception:
            seen = []
        return seen or pages
    return pages


def load_files(files: DataFrame, extractor: PageExtractor | None = None, scanned: PageExtractor | None = None) -> tuple[DataFrame, DataFrame]:
    """files(path, content), as the binaryFile source gives them -> (documents, failures)."""
    extractor = extractor or PlainPages()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, n, text, meta, None) for n, text, meta in _read_file(path, bytes(content or b""), extractor, scanned)]
                except Exception as e:
                    rows.append((path, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["source", "page_no", "text", "metadata", "error"])

    read = files.select("path", "content").mapInPandas(run, DOCUMENTS + ", error string")
    return read.where("error IS NULL").drop("error"), read.where("error IS NOT NULL").select("source", "error")


def load_pages(urls: DataFrame, pages: DataFrame, crawl: bool = False, most: int = MAX_LINKS, clean: bool = True) -> tuple[DataFrame, DataFrame]:
    """urls(url) from pages(url, html), a table of fetched pages -> (documents, failures). crawl: a page's first `most`
    distinct links to its own host are loaded as well, in their order as pages of the start; one without a page is
    skipped, a start without a page is a failure."""
    starts = urls.select("url").distinct()
    fetched = pages.select("url", "html").dropDuplicates(["url"])
    found = starts.join(fetched, "url", "left")
    failures = found.where("html IS NULL").select(F.col("url").alias("source"), F.lit("not found").alias("error"))
    wanted = found.where("html IS NOT NULL")
    if crawl:
        frontier = crawl_frontier(wanted, most).select("url", "ord", "link")
        wanted = frontier.join(fetched.withColumnRenamed("url", "link"), "link").where("html IS NOT NULL")
    else:
        wanted = wanted.withColumn("ord", F.lit(0)).withColumn("link", F.col("url"))
    body = clean_html(F.col("html")) if clean else F.col("html")
    meta = F.create_map(F.lit("url"), F.col("link"), F.lit("start"), F.col("url"))
    return wanted.select(F.col("url").alias("source"), (F.col("ord") + 1).alias("page_no"), body.alias("text"), meta.alias("metadata")), failures


def load_sources(sources: DataFrame, pages: DataFrame, files: DataFrame, extractor: PageExtractor | None = None, scanned: PageExtractor | None = None, crawl: bool = False) -> tuple[DataFrame, DataFrame]:
    """sources(source) against pages(url, html) and files(path, content) -> (documents, failures), each source by its
    type: a URL, a text file that lists URLs, or a file. A listed URL that can't be loaded is skipped."""
    heads = files.select(F.col("path").alias("source"), F.when(F.col("path").endswith(".txt"), F.decode("content", "utf-8")).alias("head"))
    typed = sources.select("source").distinct().join(heads, "source", "left").withColumn("type", source_type(F.col("source"), F.col("head")))
    documents, failures = load_pages(typed.where("type = 'url'").select(F.col("source").alias("url")), pages, crawl)
    listed = typed.where("type = 'url_list'").select("source", F.explode(F.split("head", "\n")).alias("line")).select(F.col("source").alias("list"), strip(F.col("line")).alias("source")).where(F.col("source").startswith("http"))
    of_lists, _ = load_pages(listed.select(F.col("source").alias("url")), pages)
    documents = documents.unionByName(of_lists.join(listed.select("source").distinct(), "source", "left_semi"))
    wanted = typed.where("type = 'file'").select(F.col("source").alias("path"))
    read, broken = load_files(files.join(wanted, "path", "left_semi"), extractor, scanned)
    missing = wanted.join(files.select("path"), "path", "left_anti").select(F.col("path").alias("source"), F.lit("not found").alias("error"))
    return documents.unionByName(read), failures.unionByName(broken).unionByName(missing)


def loaded_or_error(documents: DataFrame) -> DataFrame:
    """documents, or an error if there are none."""
    if documents.limit(1).isEmpty():
        raise ValueError("no source could be loaded")
    return documents


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def transcripts(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Turns of conversations -> documents of type video_transcript, a line for each turn; blank turns are left out, a
    transcript without text is none."""
    rows = turns.where(strip(F.col(text)) != "").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("text"))
    return rows.select(F.col(key).cast("string").alias("source"), F.lit(1).alias("page_no"), "text", F.create_map(F.lit("type"), F.lit("video_transcript"), F.lit("title"), F.col(key).cast("string")).alias("metadata"))


def transcript_chunks(documents: DataFrame, size: int = 800, overlap: int = 150) -> DataFrame:
    chunks = splitters.chunks_udf(splitters.recursive_chunks, size=size, overlap=overlap, separators=splitters.SEPARATORS_PLAIN)
    return documents.select("source", F.posexplode(chunks(F.col("text"))).alias("chunk_index", "chunk"))
