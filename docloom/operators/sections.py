"""Headings of pages and the sections between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import nonspace_ratio, normalize, strip
from docloom.sources.files import kept, narrowed, write_single

#: A number of parts, an optional separator, a title (fixed value); `3mg daily` matches, too.
HEADING = r"^([0-9]+(?:\.[0-9]+)*)\s*[\x{2002}\x{2003}\x{00A0}\s]*[—\- –]*\s*(.+?)\s*$"
PAGE_LINE = r"(?i)^Page\s+[0-9]+\s+of\s+[0-9]+"
MIN_TITLE, MAX_DOTS = 3, 3


def first_heading(text: Column) -> Column:
    """struct<id, title> of the page's first heading line, null if there is none. A heading of more than four
    parts ends the page's scan but isn't one."""
    lines = F.transform(F.split(normalize(text), "\n"), strip)
    heads = F.filter(lines, lambda x: (x != "") & ~x.rlike(PAGE_LINE) & (F.length(F.regexp_extract(x, HEADING, 2)) >= MIN_TITLE))
    line = F.get(heads, F.lit(0))
    number = F.regexp_extract(line, HEADING, 1)
    return F.when(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) <= MAX_DOTS, F.struct(number.alias("section_id"), F.regexp_extract(line, HEADING, 2).alias("section_title")))


def find_headings(pages: DataFrame) -> DataFrame:
    """pages(file_name, page_no, text) -> (file_name, page_no, section_id, section_title); of neighbours with one
    heading the first stays."""
    found = pages.select("file_name", "page_no", first_heading(F.col("text")).alias("h")).where("h IS NOT NULL")
    w = Window.partitionBy("file_name").orderBy("page_no")
    return found.withColumn("before", F.lag("h").over(w)).where("before IS NULL OR h <> before").select("file_name", "page_no", "h.section_id", "h.section_title")


def build_sections(pages: DataFrame, keep_preamble: bool = False) -> DataFrame:
    """(file_name, section_id, section_title, page_start, page_end, text). Pages before a file's first heading are
    dropped unless keep_preamble; a file without headings is one section 0, document. Each page belongs to the last
    heading at or before it, by a running count over the numbers of pages and headings alone; texts come to them
    afterwards, so a file's texts never meet in one task but section by section."""
    heads = find_headings(pages)
    numbers = pages.select("file_name", "page_no").distinct().join(heads, ["file_name", "page_no"], "left")
    upto = Window.partitionBy("file_name").orderBy("page_no")
    numbers = numbers.withColumn("number", F.count("section_id").over(upto)).withColumn("heads", F.count("section_id").over(Window.partitionBy("file_name")))
    if not keep_preamble:
        numbers = numbers.where("number > 0 OR heads = 0")
    marked = pages.select("file_name", "page_no", "text").join(numbers, ["file_name", "page_no"])
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n\n")
    return (
        marked.groupBy("file_name", "number")
        .agg(
            F.coalesce(F.max("section_id"), F.lit("0")).alias("section_id"),
            F.coalesce(F.max("section_title"), F.lit("document")).alias("section_title"),
            F.min("page_no").alias("page_start"),
            F.max("page_no").alias("page_end"),
            texts.alias("text"),
        )
        .drop("number")
    )


def segment_id(file_name: Column, section_id: Column, index: Column, text: Column) -> Column:
    return F.sha1(F.concat_ws("|", file_name, section_id, index.cast("string"), F.substring(text, 1, 80)))


def sample_pages(pages: DataFrame, n: int = 6) -> DataFrame:
    """Up to n pages of each file, by the hash of their number, so that a sample can be drawn again; a number that comes
    again is one page, all of whose rows are taken. The numbers are drawn and stored before any text is read."""
    w = Window.partitionBy("file_name").orderBy(F.md5(F.col("page_no").cast("string")), "page_no")
    numbers = pages.select("file_name", "page_no").distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    return narrowed(pages, kept(numbers.drop("k")), "file_name", "page_no")


def quality_sample(pages: DataFrame, files: DataFrame | None = None, n: int = 6) -> DataFrame:
    """(file_name, sample_n, nonempty_ratio_mean, pages): the mean share of characters that aren't white space over a
    sample of each file, the greatest of a page that comes again. files(file_name) without a page have a sample of 0 and
    a mean of 0."""
    rows = sample_pages(pages, n).groupBy("file_name", "page_no").agg(F.max(nonspace_ratio(F.col("text"))).alias("ratio"))
    counted = rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("sample_n"), F.avg("ratio").alias("nonempty_ratio_mean"), F.sort_array(F.collect_list("page_no")).alias("pages"))
    if files is None:
        return counted
    joined = files.select("file_name").distinct().join(counted, "file_name", "left")
    return joined.select("file_name", F.coalesce("sample_n", F.lit(0)).alias("sample_n"), F.coalesce("nonempty_ratio_mean", F.lit(0.0)).alias("nonempty_ratio_mean"), F.coalesce("pages", F.array().cast(dict(counted.dtypes)["pages"])).alias("pages"))


def _one_object(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects of one field each, as lines of a single object."""
    lead = "{"
    for batch in batches:
        lines = []
        for row in filter(lambda x: x != "{}", batch.column(0).to_pylist()):
            lines.append(lead + row[1:-1])
            lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["{}" if lead == "{" else "}"])], names=["value"])


def write_quality(sample: DataFrame, path: str) -> None:
    """The quality sample as one JSON file, an object for each file name (null: `null`). One task writes it row by row in the
    order of names, as it is one file; none of it goes through the driver."""
    name = F.coalesce("file_name", F.lit("null"))
    rows = sample.select(name.alias("name"), F.to_json(F.create_map(name, F.struct("sample_n", "nonempty_ratio_mean", "pages"))).alias("row"))
    # Without a row the plan would have no task; one empty object makes sure of it.
    rows = rows.unionByName(sample.sparkSession.range(1).select(F.lit(None).cast("string").alias("name"), F.lit("{}").alias("row")))
    write_single(rows.repartition(1).sortWithinPartitions("name").select("row").mapInArrow(_one_object, "value string"), path)
