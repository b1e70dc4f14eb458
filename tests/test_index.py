import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import index, retrieval
from docloom.operators.vectors import VectorCells
from docloom.sources import files
from docloom.sources.snapshots import Conflict, Snapshots


def corpus(spark, ids, seed=1, words=60):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{min(rng.randrange(1, words), rng.randrange(1, words))}" for _ in range(rng.randrange(4, 25))), "guideline" if i % 5 == 0 else "education") for i in ids]
    return spark.createDataFrame(rows, "seg_id long, text string, doc_type string")


def asked(spark, n=12):
    rng = random.Random(9)
    rows = [(q, " ".join(f"w{rng.randrange(1, 60)}" for _ in range(rng.randrange(1, 7)))) for q in range(n)] + [(n, "nothing here"), (n + 1, "w1")]
    return spark.createDataFrame(rows, "query_id long, text string")


def rows(df):
    return [tuple(r) for r in df.orderBy("query_id", "rank").collect()]


def test_growing_equals_a_rebuild(spark, tmp_path):
    grown = index.RetrievalIndex(spark, str(tmp_path / "grown"))
    grown.build(corpus(spark, range(900)))
    early = index.RetrievalIndex(spark, str(tmp_path / "grown"))
    before = rows(early.sparse_topk(asked(spark), 5))
    # New segments, some of which replace old ones, then some are removed.
    grown.add(corpus(spark, range(850, 1000), seed=2))
    grown.remove(spark.createDataFrame([(3,), (990,), (5000,)], "seg_id long"))
    now = corpus(spark, range(850)).unionByName(corpus(spark, range(850, 1000), seed=2)).where("seg_id NOT IN (3, 990)")
    want = rows(retrieval.sparse_topk(now, asked(spark), 5))
    assert rows(grown.sparse_topk(asked(spark), 5)) == want
    assert grown.size() == 998 == grown.info().first().n_segments
    rebuilt = index.RetrievalIndex(spark, str(tmp_path / "rebuilt"))
    rebuilt.build(now)
    assert sorted(map(tuple, grown.vocabulary().collect())) == sorted(map(tuple, rebuilt.vocabulary().collect()))
    # A reader keeps its version; compaction changes no result, and vacuum leaves what is needed.
    assert rows(early.sparse_topk(asked(spark), 5)) == before
    grown.compact()
    assert len(grown.parts) == 1 and rows(grown.sparse_topk(asked(spark), 5)) == want
    gone = grown.vacuum()
    assert gone and rows(grown.sparse_topk(asked(spark), 5)) == want
    # An addition tokenises what is added alone.
    assert grown.parts[0]["n"] == 998


def test_pruning_reads_less_and_loses_nothing(spark, tmp_path):
    # Blocks of their own subjects: most of them can't reach the k-th score.
    near = [(i, " ".join(f"s{i // 256}x{(i * 7 + j) % 40}" for j in range(12)) + " common", "education") for i in range(256 * 12)]
    segs = spark.createDataFrame(near, "seg_id long, text string, doc_type string").coalesce(1)
    questions = spark.createDataFrame([(q, f"common s{q}x1 s{q}x8 s{q}x15 s{q}x22") for q in range(6)] + [(99, "common")], "query_id long, text string")
    built = index.RetrievalIndex(spark, str(tmp_path / "index"))
    built.build(segs)
    assert rows(built.sparse_topk(questions, 8)) == rows(retrieval.sparse_topk(segs, questions, 8))
    report = built.sparse_report(questions, 8).first()
    assert report.scored < report.pairs / 2


def test_a_failure_leaves_the_version_before(spark, tmp_path, monkeypatch):
    built = index.RetrievalIndex(spark, str(tmp_path / "index"))
    built.build(corpus(spark, range(50)))
    want = rows(built.sparse_topk(asked(spark), 3))
    bad = corpus(spark, range(50, 60)).withColumn("text", F.when(F.col("seg_id") == 55, F.raise_error(F.lit("torn"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="torn"):
        built.add(bad)
    assert built.refresh() == 0 and rows(built.sparse_topk(asked(spark), 3)) == want
    # Two writers from one version: the second is told.
    other = index.RetrievalIndex(spark, str(tmp_path / "index"))
    built.add(corpus(spark, range(50, 55)))
    with pytest.raises(Conflict):
        other.add(corpus(spark, range(60, 65)))
    assert other.refresh() == 1 and other.size() == 55


def test_snapshots(spark, tmp_path):
    snaps = Snapshots(spark, str(tmp_path / "s"))
    assert snaps.read() == (-1, {}) and snaps.update(lambda s: None) == -1
    assert snaps.commit(-1, {"a": 1}) == 0
    with pytest.raises(Conflict):
        snaps.commit(-1, {"a": 2})
    seen = []

    def change(state):
        if not seen:
            snaps.commit(0, {"a": 10})  # another writer comes in between
        seen.append(state["a"])
        return {"a": state["a"] + 1}

    assert snaps.update(change) == 2 and seen == [1, 10] and snaps.read() == (2, {"a": 11}) and snaps.read(0) == (0, {"a": 1})
    for folder in ("x", "y"):
        spark.range(1).write.parquet(snaps.at(folder))
    snaps.commit(2, {"folders": ["y"]})
    assert snaps.vacuum(lambda s: s.get("folders", [])) == ["x"] and files.path_exists(spark, snaps.at("y")) and snaps.versions() == [3]


def vectors(spark, n=3000, dims=8, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dims)) * 4
    matrix = (centres[rng.integers(0, 20, n)] + rng.normal(size=(n, dims)) * 0.3).astype(np.float32)
    matrix[5] = matrix[6] = matrix[7]  # ties
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)] + [(n, None)], "seg_id long, embedding array<float>")


def test_cells_are_exact_and_read_less(spark, tmp_path):
    all_vectors = vectors(spark)
    cells = VectorCells.build(all_vectors, str(tmp_path / "cells"))
    questions = all_vectors.where("seg_id < 40").withColumnRenamed("seg_id", "query_id")
    want = rows(retrieval.dense_topk(all_vectors, questions, 8))
    assert rows(cells.topk(questions, 8)) == want
    assert cells.share_read(questions, 8) < 0.5
    near = {(q, s) for q, s, _, _ in rows(cells.topk(questions, 8, probes=4))}
    assert len(near & {(q, s) for q, s, _, _ in want}) > 0.95 * len(want) and cells.share_read(questions, 8, probes=4) < 0.3
    # Some vectors don't count.
    without = spark.createDataFrame([(i,) for i in range(0, 3000, 2)], "seg_id long")
    assert rows(cells.topk(questions, 8, without=without)) == rows(retrieval.dense_topk(all_vectors.where("seg_id % 2 = 1"), questions, 8))
    assert cells.vectors().count() == 3001


def test_cells_of_odd_inputs(spark, tmp_path):
    none = vectors(spark).limit(0)
    questions = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert VectorCells.build(none, str(tmp_path / "none")).topk(questions).collect() == []
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "seg_id long, embedding array<float>")
    cells = VectorCells.build(few, str(tmp_path / "few"))
    assert rows(cells.topk(questions, 5)) == [(1, 1, 1.0, 1), (1, 2, 1.0, 2)] and cells.topk(questions.limit(0), 5).collect() == []


def test_an_index_with_vectors_grows(spark, tmp_path):
    all_vectors = vectors(spark, 300)
    built = index.RetrievalIndex(spark, str(tmp_path / "index"))
    built.build(corpus(spark, range(200)), all_vectors.where("seg_id < 200"))
    moved = all_vectors.where("seg_id >= 150").withColumn("embedding", F.transform("embedding", lambda x: -x))
    built.add(corpus(spark, range(150, 301), seed=3), moved)
    live = all_vectors.where("seg_id < 150").unionByName(moved)
    questions = all_vectors.where("seg_id < 10").withColumnRenamed("seg_id", "query_id")
    assert rows(built.dense_topk(questions, 6)) == rows(retrieval.dense_topk(live, questions, 6))
    assert built.vectors().count() == 301
