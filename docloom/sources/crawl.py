"""A crawl as a data source: spark.read.format("crawl") and spark.readStream.format("crawl") over stored pages.

    crawl.register(spark)
    spark.read.format("crawl").option("path", folder_of_pages).option("seeds", "http://a/,http://b/x").load()

A page table is a folder of Parquet files with url and html, dealt by a hash of the host (write_pages makes one), so one
partition reads the pages of some hosts and nothing else. A seed gives the page itself and the first `most` distinct
links to its own host, in the page's order (ord 0 is the page); a link without a stored page gives a row without html. A filter on
host is pushed down to the partitions. The stream takes the seeds from a growing text file list, `per_batch` at a time; its
offset is how many it has taken, so a restart loses and repeats none.

The list of seeds is held by the driver (what a crawl begins with, not what it finds). Python readers see files through PyArrow's file systems, local or others that PyArrow knows; a store that Spark alone can read
is read with loaders.load_sources instead.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from docloom.functions.html import link_targets
from docloom.sources.files import MAX_LINKS, host

SCHEMA = "seed string, ord int, url string, host string, html string"
BUCKETS = 64
#: Pages lie in row groups of about so many bytes, in the order of their URLs; a task looks up the pages of so many seeds,
#: neighbours in that order, at a time, in record batches of so many rows.
GROUP_BYTES, SEEDS_AT_ONCE, BATCH_ROWS = 4 << 20, 500, 256


def bucket_of(name: str, buckets: int) -> int:
    return zlib.crc32(name.encode()) % buckets


def write_pages(pages: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """pages(url, html) as a table that the source reads: a folder for each bucket of hosts, of several files where it is large."""
    name = F.coalesce(host(F.col("url")), F.lit(""))
    rows = pages.select("url", "html", name.alias("host"), (F.crc32(F.encode(name, "utf-8")) % buckets).cast("int").alias("bucket"))
    rows.repartitionByRange("bucket", "url").sortWithinPartitions("bucket", "host", "url").write.partitionBy("bucket").option("maxRecordsPerFile", 200_000).option("parquet.block.size", GROUP_BYTES).parquet(path)


@dataclass
class Seeds(InputPartition):
    bucket: int
    seeds: tuple[tuple[int, str], ...]


def _batches(path: str, part: Seeds, most: int) -> Iterator[pa.RecordBatch]:
    """The pages of one bucket that its seeds and their links need: for some seeds at a time two looks, each for a list of
    URLs, in the row groups between the first and the last of them."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    folder = f"{at}/bucket={part.bucket}"
    found = system.get_file_info(folder).type != fs.FileType.NotFound
    stored = ds.dataset(folder, filesystem=system, format=ds.ParquetFileFormat(default_fragment_scan_options=ds.ParquetFragmentScanOptions(pre_buffer=False))) if found else None

    def pages(urls: set[str]) -> dict[str, str]:
        if stored is None or not urls:
            return {}
        wanted, url = sorted(urls), pc.field("url")
        between = (url >= wanted[0]) & (url <= wanted[-1]) & url.isin(wanted)
        # One batch after the other: readahead would hold many batches of whole pages.
        table = stored.to_table(columns=["url", "html"], filter=between, batch_size=BATCH_ROWS, batch_readahead=1, fragment_readahead=1, use_threads=False)
        return dict(zip(table.column("url").to_pylist(), table.column("html").to_pylist(), strict=True))

    for k in range(0, len(part.seeds), SEEDS_AT_ONCE):
        seeds = part.seeds[k : k + SEEDS_AT_ONCE]
        wanted = pages({u for _, u in seeds})
        frontier = []
        for _, seed in seeds:
            links = [seed]
            for target in link_targets(wanted.get(seed)):
                if len(links) > most:
                    break
                link = urljoin(seed, target.strip())
                if urlsplit(link).netloc == urlsplit(seed).netloc and link not in links:
                    links.append(link)
            frontier += [(seed, n, link) for n, link in enumerate(links)]
        wanted |= pages({u for _, _, u in frontier} - set(wanted))
        for n in range(0, len(frontier), BATCH_ROWS):
            rows = frontier[n : n + BATCH_ROWS]
            cols = [[r[0] for r in rows], pa.array([r[1] for r in rows], pa.int32()), [r[2] for r in rows], [urlsplit(r[2]).netloc for r in rows], pa.array([wanted.get(r[2]) for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) if isinstance(c, list) else c for c in cols], names=["seed", "ord", "url", "host", "html"])


def _dealt(seeds: list[str], buckets: int, hosts: set[str] | None = None) -> list[Seeds]:
    by_bucket: dict[int, list[tuple[int, str]]] = {}
    for n, seed in enumerate(seeds):
        name = urlsplit(seed).netloc
        if hosts is None or name in hosts:
            by_bucket.setdefault(bucket_of(name, buckets), []).append((n, seed))
    # Many seeds of one bucket are several partitions, each of neighbours by URL, whose pages lie together.
    ranked = ((b, sorted(own, key=lambda x: x[1])) for b, own in sorted(by_bucket.items()))
    return [Seeds(b, tuple(own[k : k + 2000])) for b, own in ranked for k in range(0, len(own), 2000)]


def _listed(options: dict) -> list[str]:
    """Seeds by option, or the lines of a text file that start with http."""
    if "seeds" in options:
        return [s for s in options["seeds"].split(",") if s]
    path = options["seed_file"]
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_stream(at) as f:
        lines = f.read().decode().split("\n")[:-1]  # the last line may be half written
    return [x.strip() for x in lines if x.strip().startswith("http")]


class CrawlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.hosts = options, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("host",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.hosts = values if self.hosts is None else self.hosts & values
            else:
                yield f

    def partitions(self) -> list[Seeds]:
        return _dealt(_listed(self.options), int(self.options.get("buckets", BUCKETS)), self.hosts)

    def read(self, partition: Seeds | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # without partitions it is read once all the same
            yield from _batches(self.options["path"], partition, int(self.options.get("most", MAX_LINKS)))


class CrawlStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.seen = options, 0

    def initialOffset(self) -> dict:
        return {"taken": 0}

    def latestOffset(self) -> dict:
        self.seen = min(len(_listed(self.options)), self.seen + int(self.options.get("per_batch", 1000)))
        return {"taken": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Seeds]:
        self.seen = max(self.seen, end["taken"])
        return _dealt(_listed(self.options)[start["taken"] : end["taken"]], int(self.options.get("buckets", BUCKETS)))

    def read(self, partition: Seeds | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # without partitions it is read once all the same
            yield from _batches(self.options["path"], partition, int(self.options.get("most", MAX_LINKS)))

    def commit(self, end: dict) -> None:
        pass


class CrawlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crawl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CrawlReader:
        return CrawlReader(dict(self.options))

    def streamReader(self, schema) -> CrawlStream:
        return CrawlStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CrawlSource)
