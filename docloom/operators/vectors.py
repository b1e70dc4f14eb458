"""Vectors in cells around centroids, for dense search that need not read them all.

Vectors are dealt to the nearest of a bounded number of centroids, which a bounded sample gives; each cell is one range of the
stored table, with the radius of its farthest vector. For a question q no vector of a cell scores more than
q.c + |q| * radius. The best cells give the k-th score to beat; in exact mode all cells whose bound reaches it are
read, and no other. In approximate mode only the first `probes` cells of each question are. Rows without a vector are
kept apart and match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.retrieval import _HITS, DIGITS, SLICE_ROWS, _hits, _query_blocks, top_k
from docloom.sources.files import path_exists

#: Vectors that centroids are taken from at most (a sample by hash of the id), rounds of moving them, and the most centroids.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 1024
_CELLS = "cell int, seg_id long, embedding array<float>"
_CENTRES = "cell int, centre array<double>, radius double, n long"


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and how far it is."""
    squares = (centres * centres).sum(axis=1) - 2 * vectors @ centres.T
    cell = squares.argmin(axis=1)
    return cell, np.linalg.norm(vectors - centres[cell], axis=1)


def _centres(sample: np.ndarray, k: int) -> np.ndarray:
    """Centres by moving k spread vectors to the means of those that are nearest to them."""
    rng = np.random.default_rng(0)
    centres = sample[rng.permutation(len(sample))[:k]].copy()
    for _ in range(ROUNDS):
        cell, _ = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        count = np.bincount(cell, minlength=len(centres))
        centres[count > 0] = sums[count > 0] / count[count > 0][:, None]
    return centres


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


@dataclass
class VectorCells:
    spark: SparkSession
    path: str

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None) -> VectorCells:
        """vectors(seg_id, embedding) -> cells under path. All vectors must have one length."""
        spark = vectors.sparkSession
        some = vectors.where("embedding IS NOT NULL")
        n = some.count()
        share = min(1.0, SAMPLE / max(n, 1))
        drawn = some.where(F.pmod(F.xxhash64("seg_id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * SAMPLE)
        sample = np.array([list(r[0]) for r in drawn.select("embedding").collect()], np.float64)
        k = cells or min(MOST_CELLS, max(1, int(np.sqrt(n))))
        centres = _centres(sample, min(k, len(sample))) if len(sample) else np.zeros((1, 1))
        sent = spark.sparkContext.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    cell, _ = _nearest(_matrix(part.column(1), part.num_rows), sent.value)
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), part.column(0), part.column(1)], names=["cell", "seg_id", "embedding"])

        placed = some.select(F.col("seg_id").cast("long"), F.col("embedding").cast("array<float>")).mapInArrow(run, _CELLS)
        # In ranges of cell and id: a cell with a great share of all vectors is several ranges.
        placed.repartitionByRange("cell", "seg_id").sortWithinPartitions("cell", "seg_id").write.parquet(f"{path}/cells")
        vectors.where("embedding IS NULL").select(F.col("seg_id").cast("long")).write.parquet(f"{path}/empty")
        stored = spark.read.schema(_CELLS).parquet(f"{path}/cells")

        def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            radius, count = np.zeros(len(sent.value)), np.zeros(len(sent.value), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    cell = part.column(0).to_numpy()
                    away = np.linalg.norm(_matrix(part.column(2), part.num_rows) - sent.value[cell], axis=1)
                    np.maximum.at(radius, cell, away)
                    count += np.bincount(cell, minlength=len(count))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(radius)), pa.int32()), pa.array(radius), pa.array(count)], names=["cell", "radius", "n"])

        sizes = {r.cell: (r.radius, r.n) for r in stored.mapInArrow(far, "cell int, radius double, n long").groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()}
        rows = [(i, c.tolist(), *sizes.get(i, (0.0, 0))) for i, c in enumerate(centres)]
        spark.createDataFrame(rows, _CENTRES).coalesce(1).write.parquet(f"{path}/centres")
        return cls(spark, path)

    def vectors(self) -> DataFrame:
        """(seg_id, embedding), rows without a vector included."""
        empty = self.spark.read.schema("seg_id long").parquet(f"{self.path}/empty").withColumn("embedding", F.lit(None).cast("array<float>"))
        return self.spark.read.schema(_CELLS).parquet(f"{self.path}/cells").drop("cell").unionByName(empty)

    def _plan(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centres, radii and sizes: MOST_CELLS rows at most."""
        rows = self.spark.read.schema(_CENTRES).parquet(f"{self.path}/centres").orderBy("cell").collect()
        return np.array([r.centre for r in rows]), np.array([r.radius for r in rows]), np.array([r.n for r in rows], np.int64)

    def _read(self, visits: np.ndarray, ids: np.ndarray, questions: np.ndarray, k: int, without: DataFrame | None) -> DataFrame:
        """Hits of the block's questions in the cells that visits (questions by cells) marks; other cells aren't read."""
        sent = self.spark.sparkContext.broadcast((visits, ids, questions))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            visits, ids, questions = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    cell, matrix = part.column(0).to_numpy(), _matrix(part.column(2), part.num_rows)
                    segs = part.column(1).to_numpy()
                    for c in np.unique(cell):
                        rows, asked = np.flatnonzero(cell == c), np.flatnonzero(visits[:, c])
                        if len(asked):
                            yield _hits(ids[asked], segs[rows], matrix[rows] @ questions[asked].T, k, False)

        wanted = np.flatnonzero(visits.any(axis=0)).tolist()
        rows = self.spark.read.schema(_CELLS).parquet(f"{self.path}/cells")
        rows = rows.where(F.col("cell").isin(wanted)) if wanted else rows.limit(0)
        if without is not None:
            rows = rows.join(without, "seg_id", "left_anti").select("cell", "seg_id", "embedding")
        return rows.mapInArrow(run, _HITS)

    def topk(self, questions: DataFrame, k: int = 8, probes: int | None = None, without: DataFrame | None = None) -> DataFrame:
        """The k best of each question by inner product: (query_id, seg_id, score, rank)."""
        return top_k(self._search(questions, k, probes, without)[0], k)

    def share_read(self, questions: DataFrame, k: int = 8, probes: int | None = None) -> float:
        """The share of all (question, vector) products that a search makes."""
        _, made, all_products = self._search(questions, k, probes, None)
        return made / max(1, all_products)

    def _search(self, questions: DataFrame, k: int, probes: int | None, without: DataFrame | None) -> tuple[DataFrame, int, int]:
        hits, made, total = self.spark.createDataFrame([], _HITS), 0, 0
        if not path_exists(self.spark, f"{self.path}/centres"):
            return hits, 0, 0
        centres, radius, n = self._plan()
        if not n.sum():
            return hits, 0, 0
        for block in _query_blocks(questions):
            ids, matrix = np.array([q for q, _ in block], np.int64), np.array([v for _, v in block], np.float64)
            bound = matrix @ centres.T + np.linalg.norm(matrix, axis=1)[:, None] * radius
            bound[:, n == 0] = -np.inf
            order = np.argsort(-bound, axis=1)
            rank = np.argsort(order, axis=1)
            # The cells that come first must hold k vectors, or they give no score to beat.
            if probes is None:
                before = np.take_along_axis(np.cumsum(n[order], axis=1) - n[order], rank, axis=1)
                begun = (before < k) & np.isfinite(bound)
                got = top_k(self._read(begun, ids, matrix, k, without), k)
                low = {r.query_id: r.low for r in got.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).collect()}
                to_beat = np.array([low.get(i, -np.inf) for i in ids.tolist()])
                visits = (bound + 2 * 10.0**-DIGITS >= to_beat[:, None]) & np.isfinite(bound)
            else:
                visits = (rank < probes) & np.isfinite(bound)
            hits = hits.unionByName(self._read(visits, ids, matrix, k, without))
            made, total = made + int((visits * n).sum()), total + int(n.sum()) * len(ids)
        return hits, made, total
