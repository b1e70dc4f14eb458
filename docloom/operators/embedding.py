"""Embeddings of the corpus by its own terms: a truncated singular value decomposition of the TF-IDF rows, found by
randomised subspace iteration, and a store that keeps embeddings by the hash of their text.

Columns are the terms of most segments, MOST_TERMS at most, so a basis of `size` directions over them is a matrix of bounded
size: it goes out as a broadcast, every task multiplies its rows with it and back (A'(A V)), and the partial products are
summed by blocks of columns. The driver keeps the bounded matrix orthogonal. In the end the small matrix (A V)'(A V)
gives singular values and the rotation to singular vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import retrieval
from docloom.sources.adapters import Embedder, embed
from docloom.sources.files import kept
from docloom.sources.snapshots import Conflict, Snapshots

#: Columns of the matrix at most; directions beside those asked for; columns whose partial products make one row; rows that
#: are multiplied at a time, over the columns they use (few, as most columns of many rows are used by one or two of them); words
#: that are embedded at a time.
MOST_TERMS, SPARE, BLOCK, DENSE_ROWS, SOME_WORDS = 1 << 15, 10, 512, 16, 1 << 14


@dataclass
class LatentEmbedder:
    """Unit vectors of texts along the first singular directions; texts without a known term get zeros."""

    terms: dict[str, tuple[int, float]]
    directions: np.ndarray
    values: np.ndarray
    ngram_max: int = 1

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.directions.shape[1]))
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array(texts, pa.string())], names=["at", "text"])
        for at, words, sizes in retrieval._chunks(iter([batch]), SOME_WORDS):
            terms, row, place, tf = retrieval._counted(words, sizes, self.ngram_max)
            found = [self.terms.get(t, (-1, 0.0)) for t in terms.to_pylist()]
            column, idf = np.array([c for c, _ in found], np.int64)[place], np.array([w for _, w in found])[place]
            known = np.flatnonzero(column >= 0)
            if len(known):
                own, first = np.unique(row[known], return_index=True)
                out[at.to_numpy()[own]] = np.add.reduceat((tf[known] * idf[known])[:, None] * self.directions[column[known]], first)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    @property
    def name(self) -> str:
        """Tells embedders apart whose vectors don't fit together."""
        return "latent-" + hashlib.sha256(np.round(self.directions, 6).tobytes() + repr(sorted(self.terms.items())).encode()).hexdigest()[:16]

    def save(self, spark: SparkSession, path: str) -> None:
        by_place = sorted((place, term, idf) for term, (place, idf) in self.terms.items())
        rows = [(place, term, idf, self.directions[place].tolist()) for place, term, idf in by_place]
        spark.createDataFrame(rows, "place int, term string, idf double, direction array<double>").write.parquet(f"{path}/terms")
        spark.createDataFrame([(self.ngram_max, self.values.tolist())], "ngram_max int, singular array<double>").write.parquet(f"{path}/values")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LatentEmbedder:
        rows = spark.read.parquet(f"{path}/terms").orderBy("place").collect()  # MOST_TERMS rows at most
        value = spark.read.parquet(f"{path}/values").first()
        return cls({r.term: (r.place, r.idf) for r in rows}, np.array([r.direction for r in rows]), np.array(value.singular), value.ngram_max)


def _partial(batches: Iterator[pa.RecordBatch], basis: np.ndarray, gram: bool) -> np.ndarray:
    """What the rows (places, weights) of one task add to a product."""
    out = np.zeros((basis.shape[1],) * 2 if gram else basis.shape)
    for batch in batches:
        for at in range(0, batch.num_rows, DENSE_ROWS):
            part = batch.slice(at, DENSE_ROWS)
            size = pa.compute.list_value_length(part.column(0)).to_numpy(zero_copy_only=False)
            used, place = np.unique(part.column(0).flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            dense = np.zeros((part.num_rows, len(used)))
            dense[np.repeat(np.arange(part.num_rows), size), place] = part.column(1).flatten().to_numpy(zero_copy_only=False)
            along = dense @ basis[used]
            if gram:
                out += along.T @ along
            else:
                out[used] += dense.T @ along
    return out


def _product(rows: DataFrame, basis: np.ndarray, gram: bool) -> np.ndarray:
    """A'(A basis), or (A basis)'(A basis) with gram. rows(places, weights) are the sparse rows of A."""
    sent = rows.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _partial(batches, sent.value, gram)
        for k in range(0, len(out), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([out[k : k + BLOCK].ravel()], pa.list_(pa.float64()))], names=["block", "sums"])

    def matrix(table: pa.Table) -> np.ndarray:
        return table.column("sums").combine_chunks().flatten().to_numpy()

    def add(table: pa.Table) -> pa.Table:
        total = matrix(table).reshape(table.num_rows, -1).sum(axis=0)
        return pa.table({"block": table.column("block")[:1], "sums": pa.array([total], pa.list_(pa.float64()))})

    ddl = "block long, sums array<double>"
    summed = rows.mapInArrow(run, ddl).groupBy("block").applyInArrow(add, ddl).orderBy("block").toArrow()
    return matrix(summed).reshape(-1, basis.shape[1]) if summed.num_rows else np.zeros((basis.shape[1],) * 2 if gram else basis.shape)


def _placed(weights: DataFrame, columns: list[str]) -> DataFrame:
    """(terms, weights) -> (places, weights), by the columns' order."""
    sent = weights.sparkSession.sparkContext.broadcast(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = pa.array(sent.value, pa.string())
        for batch in batches:
            terms = batch.column(0)
            sizes = np.cumsum(np.append(0, pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False)))
            places = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.compute.index_in(terms.flatten(), columns))
            yield pa.RecordBatch.from_arrays([places, batch.column(1)], names=["places", "weights"])

    return weights.mapInArrow(run, "places array<int>, weights array<double>")


def fit(segments: DataFrame, size: int = 64, most_terms: int = MOST_TERMS, rounds: int = 6, ngram_max: int = 1) -> LatentEmbedder:
    """segments(seg_id, text) -> an embedder of `size` directions (fewer if there are fewer terms). Deterministic."""
    corpus = retrieval.spread(segments.select("seg_id", "text"))
    buckets = retrieval.buckets_for(corpus)
    chunks = kept(retrieval.coded(corpus, ngram_max, buckets))
    n = chunks.agg(F.count("uid")).first()[0]
    vocab = retrieval.with_idf(retrieval.known_terms(retrieval.frequencies(chunks)), n)
    columns = vocab.orderBy(F.col("df").desc(), "term").limit(most_terms).collect()  # bounded by most_terms
    known = {r.term: (i, r.idf) for i, r in enumerate(columns)}
    if not known:
        return LatentEmbedder({}, np.zeros((0, size)), np.zeros(size), ngram_max)
    wanted = segments.sparkSession.createDataFrame([(0, list(known), [1] * len(known))], "seg_id long, terms array<string>, tfs array<int>")
    weights = retrieval.segment_weights(chunks, retrieval.frequencies(chunks, retrieval.coded_terms(wanted, buckets)), n)
    rows = kept(_placed(weights.select("terms", "weights"), list(known)))
    # Every task sends a matrix; more tasks than cores would only send more of them.
    rows = rows.coalesce(max(1, segments.sparkSession.sparkContext.defaultParallelism))
    width = min(size + SPARE, len(known))
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(len(known), width)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(_product(rows, basis, False))[0]
    square, turn = np.linalg.eigh(_product(rows, basis, True))
    order = np.argsort(-square)[:size]
    values = np.sqrt(np.maximum(square[order], 0))
    directions = basis @ turn[:, order]
    # A direction's sign is free: its greatest part is positive.
    directions *= np.where(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])] < 0, -1, 1)
    return LatentEmbedder(known, directions, values, ngram_max)


@dataclass
class EmbeddingStore:
    """Embeddings by the hash of their text and the embedder's name, under snapshots. Only texts that aren't there are
    embedded, each distinct text once."""

    spark: SparkSession
    root: str

    SCHEMA = "name string, hash string, embedding array<float>"

    def _known(self, state: dict) -> DataFrame:
        snaps = Snapshots(self.spark, self.root)
        paths = [snaps.at(f) for f in state.get("folders", [])]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def embedded(self, rows: DataFrame, embedder: Embedder, name: str, text: str = "text") -> DataFrame:
        """rows with their embedding; what is new is embedded and stored first."""
        snaps = Snapshots(self.spark, self.root)
        hashed = rows.withColumn("__hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        for _ in range(20):
            base, state = snaps.read()
            known = self._known(state).where(F.col("name") == name)
            fresh = hashed.select(F.col("__hash").alias("hash"), F.col(text).alias("text")).dropDuplicates(["hash"]).join(known.select("hash"), "hash", "left_anti")
            folder = snaps.new_folder("embeddings")
            embed(fresh, embedder).select(F.lit(name).alias("name"), "hash", "embedding").write.parquet(snaps.at(folder))
            try:
                if self.spark.read.schema(self.SCHEMA).parquet(snaps.at(folder)).limit(1).isEmpty():
                    break
                snaps.commit(base, {"folders": [*state.get("folders", []), folder]})
                break
            except Conflict:
                continue
        known = self._known(snaps.read()[1]).where(F.col("name") == name).select(F.col("hash").alias("__hash"), "embedding")
        return hashed.join(known, "__hash").drop("__hash")
