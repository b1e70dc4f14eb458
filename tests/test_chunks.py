import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.operators import embedding, index, retrieval


def corpus(spark, n=400):
    rng = random.Random(3)
    texts = [" ".join(f"w{min(rng.randrange(1, 900), rng.randrange(1, 900))}" for _ in range(rng.randrange(20, 120))) for _ in range(n)]
    rows = [(i, t, "education") for i, t in enumerate([*texts, "", None, "Único straße w1", "w1 w1"])]
    return spark.createDataFrame(rows, "seg_id long, text string, doc_type string").repartition(4)


def asked(spark):
    return spark.createDataFrame([(1, "w1 w2 w3 w4"), (2, "w700 w12 w12 straße"), (3, "nowhere"), (4, None)], "query_id long, text string")


def brute_force(segments, questions, k, ngram_max, min_df):
    texts = {r.seg_id: retrieval._terms(r.text or "", ngram_max) for r in segments.collect()}
    df = {}
    for terms in texts.values():
        for t in terms:
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + len(texts)) / (1 + d)) + 1 for t, d in df.items() if d >= min_df}

    def weights(terms):
        raw = {t: n * idf[t] for t, n in terms.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    of = {s: weights(t) for s, t in texts.items()}
    out = []
    for q in questions.collect():
        w = weights(retrieval._terms(q.text or "", ngram_max))
        scored = sorted((-round(sum(x * own.get(t, 0) for t, x in w.items()), retrieval.DIGITS), s) for s, own in of.items())
        out += [(q.query_id, s, -x + 0.0, rank) for rank, (x, s) in enumerate(scored[:k], 1)]
    return sorted(out, key=lambda r: (r[0], r[3]))


def shuffled(spark, run):
    """What run() gives, and how many rows its stages shuffled."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        context.listenerBus().waitUntilEmpty()
        none = gateway.jvm.java.util.ArrayList()
        found = context.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    before = stages()
    out = run()
    return out, sum(n for key, n in stages().items() if key not in before)


@pytest.mark.parametrize(("ngram_max", "min_df", "chunk"), [(1, 1, 1 << 19), (2, 2, 1 << 19), (2, 1, 700), (1, 2, 700)])
def test_weights_by_chunks_and_few_rows_shuffled(spark, monkeypatch, ngram_max, min_df, chunk):
    monkeypatch.setattr(retrieval, "CHUNK", chunk)
    segments, questions = corpus(spark).localCheckpoint(), asked(spark)
    got, rows = shuffled(spark, lambda: [tuple(r) for r in retrieval.sparse_topk(segments, questions, 10, ngram_max, min_df).orderBy("query_id", "rank").collect()])
    assert got == brute_force(segments, questions, 10, ngram_max, min_df)
    if chunk > 700:
        occurrences = sum(len(retrieval._terms(r.text or "", ngram_max)) for r in segments.collect())
        assert rows < occurrences / 3


def test_postings_are_made_without_a_row_for_each_term_of_a_segment(spark, tmp_path):
    segments, questions = corpus(spark), asked(spark)
    segments.write.parquet(str(tmp_path / "segments"))
    segments = spark.read.parquet(str(tmp_path / "segments"))
    built = index.RetrievalIndex(spark, str(tmp_path / "index"))
    built.build(segments)
    folder, rows = shuffled(spark, built.prepare)
    made = spark.read.parquet(f"{folder}/postings")
    terms = sum(len(retrieval._terms(r.text or "", 1)) for r in segments.collect())
    assert rows < terms / 3 and made.agg(F.sum(F.size("seg_ids"))).first()[0] == terms
    assert made.groupBy("term", "block").count().where("count > 1").isEmpty() and made.where(F.size("seg_ids") > index.BLOCK_ROWS).isEmpty()
    got, rows = shuffled(spark, lambda: [tuple(r) for r in built.sparse_topk(questions, 10).orderBy("query_id", "rank").collect()])
    assert got == brute_force(segments, questions, 10, 1, 1)


def test_an_embedder_is_fitted_from_few_rows(spark):
    segments = corpus(spark).localCheckpoint()
    made, rows = shuffled(spark, lambda: embedding.fit(segments, size=4, rounds=1))
    assert rows < sum(len(retrieval._terms(r.text or "", 1)) for r in segments.collect()) / 3
    # Each text is the sum of its terms' directions.
    texts = ["w1 w2 w2 unknown", None, "", "w3", "nothing"]
    for text, got in zip(texts, made.embed(texts), strict=True):
        want = sum((n * made.terms[t][1] * made.directions[made.terms[t][0]] for t, n in retrieval._terms(text or "", 1).items() if t in made.terms), np.zeros(4))
        assert np.allclose(got, want / (np.linalg.norm(want) or 1))


def test_a_posting_is_whole_numbers_and_its_weights_are_made_from_them(spark, tmp_path):
    segments = corpus(spark)
    built = index.RetrievalIndex(spark, str(tmp_path / "index"))
    built.build(segments)
    folder = built.prepare()
    rows = spark.read.parquet(f"{folder}/postings").collect()
    wholes = {r.block: r for r in rows if r.term is None}
    texts = {r.seg_id: retrieval._terms(r.text or "", 1) for r in segments.collect()}
    # A norm is stored once for a segment, not with each of its terms.
    assert sum(len(r.norms) for r in wholes.values()) == len(texts) and sum(len(r.seg_ids) for r in rows) == sum(map(len, texts.values()))
    idf = {r.term: r.idf for r in built.vocabulary().collect()}
    norm = {s: math.sqrt(sum((n * idf[t]) ** 2 for t, n in ts.items())) for s, ts in texts.items()}
    seen = 0
    for r in rows:
        if r.term is not None:
            whole = wholes[r.block]
            made = {whole.segs[p]: tf * (math.log((1 + len(texts)) / (1 + r.df)) + 1) / whole.norms[p] for p, tf in zip(r.seg_ids, r.tfs, strict=True)}
            assert all(math.isclose(w, texts[s][r.term] * idf[r.term] / norm[s]) for s, w in made.items())
            assert max(made.values()) <= r.most < max(made.values()) * 1.01
            seen += len(made)
    assert seen == sum(map(len, texts.values()))
    size = sum(f.stat().st_size for f in (tmp_path / "index").glob("derived-*/postings/*.parquet"))
    assert size < 8 * seen


def test_sparse_rows_are_multiplied_without_a_wide_dense_matrix():
    rng = np.random.default_rng(2)
    n, columns, each = 512, 20_000, 100
    places = [np.sort(rng.choice(columns, each, replace=False)).astype(np.int32) for _ in range(n)]
    weights = rng.random((n, each))
    matrix = np.zeros((n, columns))
    np.put_along_axis(matrix, np.array(places, np.int64), weights, 1)
    basis = rng.normal(size=(columns, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(places, pa.list_(pa.int32())), pa.array(list(weights), pa.list_(pa.float64()))], names=["places", "weights"])
    for gram, want in ((False, matrix.T @ (matrix @ basis)), (True, (matrix @ basis).T @ (matrix @ basis))):
        tracemalloc.start()
        got = embedding._partial(iter([batch]), basis, gram)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.allclose(got, want) and peak < 4e6
