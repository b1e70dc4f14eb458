"""The persisted index: a growing set of immutable parts under snapshots, and postings that are made from them.

A part holds what a batch of segments brought: their terms (tokenised once), their ids and types, their vectors, and the
change of every term's document frequency. A segment that comes again replaces the one before: the part names the
older one as dead, and takes its terms off the document frequencies. So adding costs what is added (and the ids of the
parts before), frequencies of the whole are sums over the parts, and results are those of a rebuild.

Weights depend on the whole through idf and norms. They are made from the parts' terms, not from texts, once for each
version that is asked: postings in blocks of 256 neighbouring segments, a row for each term and block with the greatest weight in
it, made where a chunk of segments is weighed, so without a shuffle of their own. A posting holds small whole numbers, the places of
segments in their block and how often they have the term; norms are stored once for a block, and weights made where they score.
A batch of questions is answered in passes. What a block can reach at most for a question is a sum of those greatest weights; the
blocks that can reach most give the k-th score to beat; blocks that can't reach it are never scored. All questions share each
scan.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.operators import retrieval
from docloom.operators.vectors import VectorCells
from docloom.sources.files import delete_path, kept, narrowed, path_exists, write_small
from docloom.sources.snapshots import Snapshots

VECTORS, SEGMENTS = "seg_id long, embedding array<float>", "seg_id long, doc_type string"
FORWARD, FREQUENCIES, DEAD = "uid long, seg_id long, terms array<string>, tfs array<int>", "term string, df long", "seg_id long"
#: What is stored of terms takes about a third less space with it.
CODEC = "zstd"
#: Segments of a block; blocks that are scored first, for the score to beat; what rounding may add to a score.
BLOCK_ROWS, FIRST_BLOCKS, MARGIN = 256, 2, 2 * 10.0**-retrieval.DIGITS


@dataclass(frozen=True)
class IndexConfig:
    """What an index was built with. The embedding's name and size belong to it: vectors of another model don't fit."""

    ngram_max: int = 1
    min_df: int = 1
    embedding_model: str = ""
    embedding_size: int = 0


class RetrievalIndex:
    """An index under a root. A reader holds the version that it found when it was made or refreshed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.snapshots = spark, Snapshots(spark, root)
        self.root = root
        self.refresh()

    def refresh(self) -> int:
        """The latest version from now on; its number, -1 if there is none."""
        self.version, self.state = self.snapshots.read()
        return self.version

    @property
    def parts(self) -> list[dict]:
        return self.state.get("parts", [])

    def build(self, segments: DataFrame, vectors: DataFrame | None = None, config: IndexConfig | None = None) -> IndexConfig:
        """segments(seg_id, text, doc_type) and perhaps vectors(seg_id, embedding) -> an index of these alone."""
        config = config or IndexConfig()
        part = self._part(segments, vectors, config, [])
        self.snapshots.update(lambda _: {"config": asdict(config), "parts": [part]})
        self.refresh()
        return config

    def add(self, segments: DataFrame, vectors: DataFrame | None = None) -> int:
        """More segments, and vectors for them; those with ids that are there replace them. The version."""
        config, base = self.config(), (self.version, self.state)
        part = self._part(segments, vectors, config, self.parts)
        self.snapshots.commit(base[0], {**base[1], "parts": [*base[1]["parts"], part]})
        return self.refresh()

    def remove(self, ids: DataFrame) -> int:
        """Segments with these ids go."""
        part = self._part(None, None, self.config(), self.parts, ids)
        self.snapshots.commit(self.version, {**self.state, "parts": [*self.parts, part]})
        return self.refresh()

    def _part(self, segments: DataFrame | None, vectors: DataFrame | None, config: IndexConfig, before: list[dict], removed: DataFrame | None = None) -> dict:
        name = self.snapshots.new_folder("part")
        to = self.snapshots.at(name)
        try:
            n = 0
            frequencies = self.spark.createDataFrame([], FREQUENCIES)
            gone = removed.select(F.col("seg_id").cast("long")) if removed is not None else segments.select(F.col("seg_id").cast("long"))
            if segments is not None:
                retrieval.segment_terms(retrieval.spread(segments.select("seg_id", "text"), "seg_id"), config.ngram_max).write.parquet(f"{to}/forward", compression=CODEC)
                forward = self.spark.read.schema(FORWARD).parquet(f"{to}/forward")
                n = forward.count()
                frequencies = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
                segments.select("seg_id", "doc_type").write.parquet(f"{to}/segments")
            if vectors is not None:
                VectorCells.build(vectors.select("seg_id", F.col("embedding").cast("array<float>")), f"{to}/vectors")
            n_dead = 0
            if before:
                self._live("segments", SEGMENTS, before).select("seg_id").join(gone.distinct(), "seg_id", "left_semi").distinct().write.parquet(f"{to}/dead")
                dead = self.spark.read.schema(DEAD).parquet(f"{to}/dead")
                if not dead.limit(1).isEmpty():
                    lost = kept(self._live("forward", FORWARD, before).join(dead, "seg_id", "left_semi").select("terms"))
                    n_dead = lost.count()
                    minus = lost.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
                    frequencies = frequencies.unionByName(minus).groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") != 0)
            frequencies.write.parquet(f"{to}/frequencies")
            return {"name": name, "n": n, "dead": n_dead}
        except BaseException:
            delete_path(self.spark, to)
            raise

    def _files(self, part: dict, what: str) -> str | None:
        path = f"{self.snapshots.at(part['name'])}/{what}"
        return path if path_exists(self.spark, path) else None

    def _live(self, what: str, schema: str, parts: list[dict]) -> DataFrame:
        """Rows of all parts but those of segments that a later part replaced or removed."""
        out = self.spark.createDataFrame([], schema)
        for k, part in enumerate(parts):
            if path := self._files(part, what):
                rows = self.spark.read.schema(schema).parquet(path)
                later = [self.spark.read.schema(DEAD).parquet(p) for later in parts[k + 1 :] if later["dead"] and (p := self._files(later, "dead"))]
                for dead in later:
                    rows = rows.join(dead, "seg_id", "left_anti")
                out = out.unionByName(rows)
        return out

    def config(self) -> IndexConfig:
        if self.version < 0 or not self.state:
            raise FileNotFoundError(f"no index in {self.root}")
        return IndexConfig(**self.state["config"])

    def segments(self) -> DataFrame:
        return self._live("segments", SEGMENTS, self.parts)

    def size(self) -> int:
        return sum(p["n"] - p["dead"] for p in self.parts)

    def frequencies(self) -> DataFrame:
        """(term, df) of the live segments: the parts' changes summed."""
        paths = [p for part in self.parts if (p := self._files(part, "frequencies"))]
        rows = self.spark.read.schema(FREQUENCIES).parquet(*paths) if paths else self.spark.createDataFrame([], FREQUENCIES)
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") > 0)

    def vocabulary(self) -> DataFrame:
        """(term, df, idf)."""
        return retrieval.with_idf(self.frequencies(), self.size(), self.config().min_df)

    def prepare(self) -> str:
        """Makes the postings of this version, unless they are there: vocabulary and postings. Their folder."""
        to = f"{self.snapshots.at('derived-' + str(self.version))}"
        if not path_exists(self.spark, f"{to}/READY"):
            self.vocabulary().write.mode("overwrite").parquet(f"{to}/vocabulary")
            forward = self._live("forward", FORWARD, self.parts)
            buckets, min_df = retrieval.buckets_for(forward), self.config().min_df
            chunks = kept(retrieval.coded_terms(forward, buckets), CODEC)
            retrieval.postings(chunks, retrieval.frequencies(chunks, min_df=min_df), self.size(), BLOCK_ROWS, min_df).write.mode("overwrite").parquet(f"{to}/postings", compression=CODEC)
            write_small(self.spark, f"{to}/READY", "")
        return to

    def _asked(self, questions: DataFrame, folder: str) -> DataFrame:
        counts = retrieval.question_terms(questions, self.config().ngram_max)
        return kept(retrieval.weigh(counts, self.spark.read.parquet(f"{folder}/vocabulary"), "query_id"))

    def _scored(self, pairs: DataFrame, asked: DataFrame, postings: DataFrame, wholes: DataFrame, k: int) -> DataFrame:
        """The scores of the segments of pairs(query_id, block), the k best of each question at least. What the asked terms have
        in a block meets the block's segments and questions in one task."""
        blocks = kept(pairs.groupBy("block").agg(F.collect_list("query_id").alias("queries")))
        needed = narrowed(postings.unionByName(wholes), blocks, "block").select("block", "term", "df", "seg_ids", "tfs", "segs", "norms")
        rows = needed.unionByName(blocks, allowMissingColumns=True)
        return retrieval.score_blocks(rows.repartition("block").sortWithinPartitions("block"), asked, k, self.size())

    def sparse_topk(self, questions: DataFrame, k: int = 20) -> DataFrame:
        return self._pruned(questions, k)[0]

    def sparse_report(self, questions: DataFrame, k: int = 20) -> DataFrame:
        """One row: the (question, block) pairs that have a common term, and those whose segments were scored."""
        _, bounds, chosen = self._pruned(questions, k)
        return bounds.agg(F.count(F.lit(1)).alias("pairs")).crossJoin(chosen.agg(F.count(F.lit(1)).alias("scored")))

    def _pruned(self, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        folder = self.prepare()
        asked = self._asked(questions, folder)
        postings = self.spark.read.schema(retrieval.POSTINGS).parquet(f"{folder}/postings")
        wholes = postings.where("segs IS NOT NULL").select("block", "segs", "norms", *[F.lit(None).cast(kind).alias(name) for name, kind in postings.dtypes if name not in ("block", "segs", "norms")])
        postings = narrowed(postings, kept(asked.select("term").distinct()), "term")
        # What each block can reach: from terms, blocks and greatest weights alone.
        ahead = postings.select("term", "block", "most").join(asked, "term")
        bounds = kept(ahead.groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("most")).alias("bound")))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block"))
        first = bounds.withColumn("place", place).where(F.col("place") <= FIRST_BLOCKS).select("query_id", "block")
        begun = retrieval.top_k(self._scored(first, asked, postings, wholes, k), k)
        to_beat = begun.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).select("query_id", F.when(F.col("n") >= k, F.col("low")).otherwise(0.0).alias("to_beat"))
        chosen = kept(bounds.join(to_beat, "query_id", "left").where(F.col("bound") + MARGIN >= F.coalesce("to_beat", F.lit(0.0))).select("query_id", "block"))
        return retrieval.filled(self._scored(chosen, asked, postings, wholes, k), self.segments(), questions, k), bounds, chosen

    def cells(self) -> list[VectorCells]:
        return [VectorCells(self.spark, path) for part in self.parts if (path := self._files(part, "vectors"))]

    def vectors(self) -> DataFrame:
        """(seg_id, embedding) of the live segments."""
        out = self.spark.createDataFrame([], VECTORS)
        for k, part in enumerate(self.parts):
            if path := self._files(part, "vectors"):
                out = out.unionByName(self._without_dead(VectorCells(self.spark, path).vectors(), k))
        return out

    def _without_dead(self, rows: DataFrame, k: int) -> DataFrame:
        for later in self.parts[k + 1 :]:
            if later["dead"] and (path := self._files(later, "dead")):
                rows = rows.join(self.spark.read.schema(DEAD).parquet(path), "seg_id", "left_anti")
        return rows

    def dense_topk(self, question_vectors: DataFrame, k: int = 8, probes: int | None = None) -> DataFrame:
        """Exact by default; with probes, of so many cells of each part alone."""
        size = self.config().embedding_size
        if size and not question_vectors.where(F.size("embedding") != size).limit(1).isEmpty():
            raise ValueError(f"question vectors must have the index' {size} numbers")
        hits = self.spark.createDataFrame([], retrieval._HITS)
        for n, part in enumerate(self.parts):
            if path := self._files(part, "vectors"):
                cells = VectorCells(self.spark, path)
                dead = [p for later in self.parts[n + 1 :] if later["dead"] and (p := self._files(later, "dead"))]
                gone = self.spark.read.schema(DEAD).parquet(*dead) if dead else None
                hits = hits.unionByName(cells.topk(question_vectors, k, probes, without=gone).drop("rank"))
        return retrieval.top_k(hits, k)

    def retrieve(self, questions: DataFrame, question_vectors: DataFrame | None = None, config: EngineConfig | None = None) -> DataFrame:
        """(query_id, seg_id, score, rank) through the channels that the index has."""
        config = config or EngineConfig()
        sparse = self.sparse_topk(questions, config.k_sparse)
        dense = self.dense_topk(question_vectors, config.k_dense) if question_vectors is not None else sparse.limit(0)
        return retrieval.boost(retrieval.fuse(dense, sparse, config), self.segments(), config)

    def compact(self) -> int:
        """One part instead of all, from the parts' terms: dead segments and their traces go. Readers keep their version."""
        if len(self.parts) < 2:
            return self.version
        name = self.snapshots.new_folder("part")
        to = self.snapshots.at(name)
        try:
            forward = self._live("forward", FORWARD, self.parts)
            forward.select(F.monotonically_increasing_id().alias("uid"), "seg_id", "terms", "tfs").write.parquet(f"{to}/forward", compression=CODEC)
            self.segments().write.parquet(f"{to}/segments")
            self.frequencies().write.parquet(f"{to}/frequencies")
            if self.cells():
                VectorCells.build(self.vectors(), f"{to}/vectors")
            self.snapshots.commit(self.version, {**self.state, "parts": [{"name": name, "n": self.size(), "dead": 0}]})
        except BaseException:
            delete_path(self.spark, to)
            raise
        return self.refresh()

    def vacuum(self, keep: int = 1) -> list[str]:
        """What versions but the last `keep` alone needed goes; no reader may be on those."""
        needed = [f"derived-{v}" for v in self.snapshots.versions()[-keep:]]
        return self.snapshots.vacuum(lambda state: [*needed, *(p["name"] for p in state.get("parts", []))], keep)

    def info(self) -> DataFrame:
        """One row: exists, n_segments, n_terms, n_vectors, n_bytes."""
        schema = "exists boolean, n_segments long, n_terms long, n_vectors long, n_bytes long"
        if not self.parts:
            return self.spark.createDataFrame([(bool(self.state), 0, 0, 0, 0)], schema)
        paths = [self.snapshots.at(p["name"]) for p in self.parts]
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(paths)
        n_bytes = files.select("length").agg(F.sum("length")).first()[0] or 0
        return self.spark.createDataFrame([(True, self.segments().count(), self.vocabulary().count(), self.vectors().count(), n_bytes)], schema)

    def clear(self) -> None:
        delete_path(self.spark, self.root)
        self.refresh()
