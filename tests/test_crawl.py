import pytest
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from docloom.sources import crawl, files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("crawl") / "pages")
    rows = [(f"http://h{k % 3}.example/a/p{k}", f"<p>page {k}</p><a href='../a/p{k + 3}'>next</a><a href=\"/gone{k}\">g</a><a href='http://o.example/'>o</a><a href=p{k + 6}>x</a>") for k in range(30)]
    df = spark.createDataFrame(rows, "url string, html string")
    crawl.write_pages(df, path, 8)
    crawl.register(spark)
    return df, path


def read(spark, path, seeds, **more):
    return spark.read.format("crawl").options(path=path, seeds=",".join(seeds), buckets="8", **more).load()


def expected(spark, df, seeds, most=files.MAX_LINKS):
    seeds_df = spark.createDataFrame([(s,) for s in seeds], "url string")
    frontier = files.crawl_frontier(df.join(seeds_df, "url"), most).withColumnRenamed("url", "seed")
    return sorted((r.seed, r.ord, r.link, r.html) for r in frontier.join(df.withColumnRenamed("url", "link"), "link", "left").collect())


def test_pages_with_their_children(spark, pages):
    df, path = pages
    seeds = [f"http://h{k % 3}.example/a/p{k}" for k in range(0, 30, 2)]
    got = read(spark, path, seeds)
    assert sorted((r.seed, r.ord, r.url, r.html) for r in got.collect()) == expected(spark, df, seeds)
    assert {r.ord for r in read(spark, path, seeds, most="1").collect()} == {0, 1}
    missing = read(spark, path, ["http://h0.example/none", "http://nowhere.example/"]).collect()
    assert sorted((r.url, r.html) for r in missing) == [("http://h0.example/none", None), ("http://nowhere.example/", None)]
    assert read(spark, path, []).collect() == []


def test_hosts_are_pushed_down(spark, pages):
    df, path = pages
    seeds = [r.url for r in df.collect()]
    some = read(spark, path, seeds).where(F.col("host") == "h1.example")
    assert {r.host for r in some.collect()} == {"h1.example"} and some.count() == sum(1 for _, _, u, _ in expected(spark, df, seeds) if "h1." in u)
    reader = crawl.CrawlReader({"seeds": ",".join(seeds), "buckets": "8"})
    assert list(reader.pushFilters([crawl.EqualTo(("host",), "h1.example")])) == []
    assert {s for p in reader.partitions() for _, s in p.seeds} == {s for s in seeds if "h1." in s}


def test_a_stream_goes_on_after_a_restart(spark, pages, tmp_path):
    df, path = pages
    seeds = [r.url for r in df.orderBy("url").collect()]
    listed = tmp_path / "seeds.txt"
    rows = []

    def run():
        stream = spark.readStream.format("crawl").options(path=path, seed_file=str(listed), buckets="8", per_batch="4").load()
        query = stream.writeStream.foreachBatch(lambda batch, n: rows.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    listed.write_text("".join(f"{s}\n" for s in seeds[:10]) + "no url\n" + seeds[10])  # the last line isn't whole yet
    run()
    assert {r.seed for r in rows} == set(seeds[:10])
    listed.write_text("".join(f"{s}\n" for s in seeds[:10]) + "no url\n" + "".join(f"{s}\n" for s in seeds[10:17]))
    run()
    assert sorted((r.seed, r.ord, r.url, r.html) for r in rows) == expected(spark, df, seeds[:17])


def test_seeds_of_a_task_are_neighbours_and_looked_up_in_runs(tmp_path, monkeypatch):
    """Seeds in any order are dealt in the order of their URLs, and no look asks for more than the pages of some of them."""
    urls = [f"http://h.example/p{k}" for k in range(5000)]
    dealt = crawl._dealt(urls[::-1], 64)
    assert [u for p in dealt for _, u in p.seeds] == sorted(urls) and len(dealt) == 3
    monkeypatch.setattr(crawl, "SEEDS_AT_ONCE", 7)
    bucket = dealt[0].bucket
    (tmp_path / f"bucket={bucket}").mkdir()
    html = ['<a href="/p%d">x</a> %d' % (k + 9, k) for k in range(100)]
    pq.write_table(pa.table({"url": urls[:100], "html": html}), tmp_path / f"bucket={bucket}" / "a.parquet", row_group_size=10)
    seeds = crawl.Seeds(bucket, tuple(sorted(enumerate(urls[:100]), key=lambda x: x[1])))
    batches = list(crawl._batches(str(tmp_path), seeds, 5))
    assert max(b.num_rows for b in batches) <= 14
    rows = {(r["seed"], r["ord"]): (r["url"], r["html"]) for b in batches for r in b.to_pylist()}
    assert rows == {(urls[k], n): (urls[k + 9 * n], html[k + 9 * n] if k + 9 * n < 100 else None) for k in range(100) for n in (0, 1)}
