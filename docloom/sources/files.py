"""Sources: segment files, URL lists, pages and their links, limits on files."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce
from operator import and_

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.html import link_targets_of
from docloom.functions.text import bind, strip

SEGMENT_SCHEMA = (
    "seg_id string, text string, source string, doc_type string, pub_year int, category string, title string, doi string, "
    "section_id string, section_title string, page_start int, page_end int, file_name string, _corrupt_record string"
)
#: The demonstration segments (fixed values).
DEMO = (
    ("guideline_1", "Follow surgeon instructions after radical prostatectomy. Showering is typically allowed once the wound is sealed and dressings are removed.", "guideline_demo", "guideline", 2023, "postop_care"),
    ("edu_1", "Seek medical attention for fever, increasing pain, redness, swelling, or wound discharge.", "education_demo", "education", 2022, "warnings"),
)
MAX_INDEX_BYTES, MAX_FILE_BYTES, LARGE_FILE_BYTES, CHARS_PER_CHUNK = 20 << 20, 500 << 20, 100 << 20, 1000
EXTENSIONS = ("pdf", "txt")
MAX_LINKS = 5
BROADCAST_KEYS = 200_000


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    system, at = file_system(spark, path)
    return system.exists(at)


def delete_path(spark: SparkSession, path: str) -> None:
    system, at = file_system(spark, path)
    system.delete(at, True)


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A short text as one file of the shared file system, in place of what was there."""
    system, at = file_system(spark, path)
    out = system.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_small(spark: SparkSession, path: str) -> str:
    system, at = file_system(spark, path)
    stream = system.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_single(rows: DataFrame, path: str) -> None:
    """rows(value) as one text file, in place of what was there: made by tasks in a folder beside it, then renamed."""
    spark, made = rows.sparkSession, f"{path}.{uuid.uuid4().hex}.tmp"
    rows.write.text(made)
    system, at = file_system(spark, path)
    part = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{made}/part-*"))[0].getPath()
    system.delete(at, True)
    system.rename(part, at)
    delete_path(spark, made)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """A short text as a file that no one else has made: whole or not at all, and False if the file is there already. The
    text goes to a name of its own first, then the file system renames it without overwriting. (A local file
    system looks before it renames; of two processes at the very same moment the later one would win there.)"""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    made = f"{path}.{uuid.uuid4().hex}.tmp"
    write_small(spark, made, text)
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    plain = spark.sparkContext._gateway.new_array(kind, 1)
    plain[0] = kind.NONE
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = file_system(spark, path)[0]
    try:
        if system.exists(at):
            return False
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf)
        context.rename(system.makeQualified(jvm.org.apache.hadoop.fs.Path(made)), system.makeQualified(at), plain)
        return True
    except Py4JJavaError as error:
        if system.exists(at) and "AlreadyExists" in str(error.java_exception):
            return False
        raise
    finally:
        delete_path(spark, made)


def names_in(spark: SparkSession, path: str, ending: str = ".json") -> list[str]:
    """The names with this ending in a folder, in order; none if it doesn't exist."""
    system, at = file_system(spark, path)
    return sorted(n for n in (x.getPath().getName() for x in system.listStatus(at)) if n.endswith(ending)) if system.exists(at) else []


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; one of this machine only where that is unset and all runs in one
    process. It goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="docloom-")
    path = f"{base}/{uuid.uuid4().hex}"
    system, at = file_system(spark, path)
    system.deleteOnExit(at)
    return path


def kept(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The rows, computed once and written to a scratch folder, for several readers."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrowed(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """rows whose keys, null ones too, are among those of a stored table `wanted`. Up to BROADCAST_KEYS of them go out to the
    rows, which then aren't shuffled; more are joined by a shuffle."""
    named = wanted.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    if wanted.count() <= BROADCAST_KEYS:
        named = F.broadcast(named)
    return rows.join(named, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_semi")


def demo_segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEMO, "seg_id string, text string, source string, doc_type string, pub_year int, category string")


def load_segments(spark: SparkSession, path: str, missing_ok: bool = True, strict: bool = True) -> DataFrame:
    """JSON Lines of segments under a fixed schema. A missing path gives no rows, or an error unless missing_ok.
    strict: a bad line is an error; otherwise it is a row with _corrupt_record."""
    if missing_ok and not path_exists(spark, path):
        return spark.createDataFrame([], SEGMENT_SCHEMA).drop("_corrupt_record")
    if strict:
        schema = SEGMENT_SCHEMA.replace(", _corrupt_record string", "")
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(SEGMENT_SCHEMA).option("mode", "PERMISSIVE").json(path)


def load_or_demo(spark: SparkSession, path: str) -> DataFrame:
    found = load_segments(spark, path)
    return demo_segments(spark) if found.limit(1).isEmpty() else found


def write_segments(segments: DataFrame, path: str) -> None:
    segments.write.mode("overwrite").json(path)


def url_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Stripped lines that start with http."""
    return lines.select(strip(F.col(column)).alias("url")).where(F.col("url").startswith("http"))


def source_type(source: Column, head: Column) -> Column:
    """url, url_list (a .txt file of which one of the first five lines starts with http) or file."""
    lines = F.slice(F.split(F.coalesce(head, F.lit("")), "\n"), 1, 5)
    is_list = source.endswith(".txt") & F.exists(lines, lambda x: strip(x).startswith("http"))
    return F.when(source.startswith("http://") | source.startswith("https://"), F.lit("url")).when(is_list, F.lit("url_list")).otherwise(F.lit("file"))


def file_limits(files: DataFrame) -> DataFrame:
    """files(path, length) -> checks and estimates by size."""
    extension = F.lower(F.substring_index("path", ".", -1))
    chunks = F.floor(F.col("length") / CHARS_PER_CHUNK).cast("long")
    return files.select(
        "path",
        "length",
        (extension.isin(*EXTENSIONS) & (F.col("length") > 0) & (F.col("length") <= MAX_INDEX_BYTES)).alias("indexable"),
        (F.col("length") <= MAX_FILE_BYTES).alias("valid"),
        (F.col("length") > LARGE_FILE_BYTES).alias("large"),
        chunks.alias("est_chunks"),
        (chunks / 10).alias("est_seconds"),
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under a path; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def _without_dots(path: Column) -> Column:
    """An absolute path without its `.` and `..` segments and without empty ones, but for the last."""
    parts = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))

    def fold(p: Column) -> Column:
        last = F.get(p, F.size(p) - 1)
        some = F.filter(p, lambda x, i: (x != "") | (i == F.size(p) - 1))
        up = F.aggregate(
            some,
            F.array().cast("array<string>"),
            lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
        )
        return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.concat(up, F.array(F.lit("")))).otherwise(up), "/"))

    return bind(parts, fold)


def resolve(base: Column, href: Column) -> Column:
    """A link made absolute against http(s) base URLs: absolute, //host, /path, ?query, #fragment and relative ones, with
    dot segments taken out of paths that are resolved. White space around a link and line ends and tabs in it go; a scheme that is
    the base's own, without a host behind it, says nothing."""
    scheme = F.lower(F.regexp_extract(base, r"(?i)^(https?):", 1))
    root = F.regexp_extract(base, r"(?i)^(https?://[^/?#]*)", 1)
    plain = F.regexp_replace(base, r"[?#].*$", "")
    path = F.substring(plain, F.length(root) + 1, F.length(plain))
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    clean = F.regexp_replace(F.btrim(href, F.lit("".join(map(chr, range(33))))), r"[\t\r\n]", "")

    def absolute(h: Column) -> Column:
        own, rest = F.regexp_extract(h, r"^[^?#]*", 0), F.regexp_extract(h, r"[?#].*$", 0)
        return (
            F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h == "", base)
            .when(h.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), h))
            .when(h.startswith("?"), F.concat(plain, h))
            .when(h.startswith("/"), F.concat(root, _without_dots(own), rest))
            .otherwise(F.concat(root, _without_dots(F.concat(folder, own)), rest))
        )

    idle = F.lower(F.regexp_extract(clean, r"^([a-zA-Z][a-zA-Z0-9+.-]*):(?!//)", 1))
    return bind(F.when((idle != "") & (idle == scheme), F.regexp_replace(clean, r"^[^:]*:", "")).otherwise(clean), absolute)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]*)", 1)


def crawl_frontier(pages: DataFrame, most: int = MAX_LINKS) -> DataFrame:
    """pages(url, html) -> (url, ord, link): the page itself (ord 0) and its first `most` distinct links to the same
    host, in document order. A fragment is part of a link. One row of pages at a time, no shuffle."""
    pages = pages.select("url", link_targets_of("html").alias("hrefs"))
    absolute = F.transform("hrefs", lambda h: resolve(F.col("url"), h))
    same = F.filter(absolute, lambda x: host(x) == host(F.col("url")))
    frontier = F.slice(F.array_distinct(F.concat(F.array("url"), same)), 1, most + 1)
    return pages.select("url", F.posexplode(frontier).alias("ord", "link"))
