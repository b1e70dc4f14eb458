import numpy as np

from docloom.operators import embedding, ingest, knowledge, retrieval
from docloom.operators.progress import Progress, StreamProgress

SF = "/root/testdata/sf0.001"


def test_singular_values_like_numpy(spark):
    segs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS seg_id", "text")
    made = embedding.fit(segs, size=16, most_terms=800)
    texts = {r.seg_id: retrieval._terms(r.text or "", 1) for r in segs.collect()}
    n = len(texts)
    df = {}
    for c in texts.values():
        for t in c:
            df[t] = df.get(t, 0) + 1
    idf = {t: np.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    chosen = sorted(df, key=lambda t: (-df[t], t))[:800]
    place = {t: i for i, t in enumerate(chosen)}
    matrix = np.zeros((n, 800))
    for row, c in zip(matrix, texts.values(), strict=True):
        norm = np.sqrt(sum((m * idf[t]) ** 2 for t, m in c.items())) or 1
        for t, m in c.items():
            if t in place:
                row[place[t]] = m * idf[t] / norm
    values = np.linalg.svd(matrix, compute_uv=False)[:16]
    assert set(made.terms) == set(chosen)
    assert np.allclose(made.values[:8], values[:8], rtol=1e-3) and np.allclose(made.values, values, rtol=2e-2)
    assert np.allclose(made.directions.T @ made.directions, np.eye(16), atol=1e-8)


class Counted:
    def __init__(self, inner, path):
        self.inner, self.path = inner, path

    def embed(self, texts):
        with open(self.path, "a") as f:
            f.write("x\n" * len(texts))
        return self.inner.embed(texts)


def test_only_new_texts_are_embedded(spark, tmp_path):
    segs = spark.createDataFrame([(1, "apple pear"), (2, "apple pear"), (3, "plum apple"), (4, None), (5, "kiwi")], "seg_id long, text string")
    made = embedding.fit(segs, size=3)
    store, calls = embedding.EmbeddingStore(spark, str(tmp_path / "store")), tmp_path / "calls"
    counted = Counted(made, str(calls))
    first = {r.seg_id: list(r.embedding) for r in store.embedded(segs, counted, made.name).collect()}
    assert len(first) == 5 and first[1] == first[2] and not any(first[4]) and abs(np.linalg.norm(first[3]) - 1) < 1e-6
    n = calls.read_text().count("x")
    assert n == 4
    more = segs.unionByName(spark.createDataFrame([(6, "plum")], segs.schema))
    assert store.embedded(more, counted, made.name).count() == 6 and calls.read_text().count("x") == n + 1
    assert store.embedded(more, counted, "other").count() == 6 and calls.read_text().count("x") == n + 1 + 5
    made.save(spark, str(tmp_path / "model"))
    again = embedding.LatentEmbedder.load(spark, str(tmp_path / "model"))
    assert again.name == made.name and np.allclose(again.embed(["apple plum"]), made.embed(["apple plum"]))
    assert embedding.fit(segs.limit(0)).embed(["x"]).shape == (1, 64)


def test_progress_counts_without_a_second_job(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "Some words here. " * 60) for i in range(12)], "doc_id long, source string, text string")
    told = []
    seen = Progress(spark, lambda *x: told.append(x))
    built = ingest.build_knowledge(knowledge.KnowledgeBase(spark, str(tmp_path / "kb")), docs, progress=seen)
    rows = {r.stage: r.n_rows for r in seen.table().collect()}
    assert rows == {"documents": 12, "chunks": built["chunks"]} and [x[0] for x in told] == ["documents", "chunks"]


def test_progress_of_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(10).selectExpr("id", "CAST(id AS string) AS text").coalesce(1).write.parquet(folder)
    seen = StreamProgress(spark)
    try:
        rows = StreamProgress.observed(spark.readStream.schema("id long, text string").parquet(folder), "read")
        query = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        assert [(r.stage, r.n_rows, r.n_bytes) for r in seen.table().collect()] == [("read", 10, 10)] and not seen.failed
    finally:
        seen.close()
