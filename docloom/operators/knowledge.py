"""The two-tier knowledge base: historical and realtime chunks as Parquet datasets, sources as a log."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.operators.index import RetrievalIndex
from docloom.sources.files import delete_path
from docloom.sources.snapshots import Conflict, Snapshots

CHUNK_SCHEMA = "seg_id string, source string, chunk_index int, chunk string"
TIERS = ("historical", "realtime")


def status(chunks: DataFrame) -> DataFrame:
    """chunks(tier, source, ...) -> per tier the number of sources and chunks and their characters."""
    return chunks.groupBy("tier").agg(F.countDistinct("source").alias("n_sources"), F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


def merge_tiers(chunks: DataFrame) -> DataFrame:
    """All realtime chunks appended to the historical ones, without removing duplicates."""
    return chunks.withColumn("tier", F.lit("historical"))


SOURCE_SCHEMA = "source string, type string, tier string, added_at timestamp, n_chunks long"


@dataclass
class KnowledgeBase:
    """Both tiers and the log of their sources, as snapshots: a version names the folders of each tier, so an addition, a
    replacement and a merge are one step that happens whole or not at all. A merge moves names, no rows. Readers keep the
    folders they began with; what no version needs goes with vacuum().

    Chunks may bring a column metadata (map of strings), which is stored with them."""

    spark: SparkSession
    root: str

    @property
    def snapshots(self) -> Snapshots:
        return Snapshots(self.spark, self.root)

    @staticmethod
    def _known(tier: str) -> str:
        if tier not in TIERS:
            raise ValueError(f"unknown tier {tier}")
        return tier

    def _folders(self, kind: str, tier: str, state: dict | None = None) -> list[str]:
        state = self.snapshots.read()[1] if state is None else state
        return [self.snapshots.at(f) for f in state.get(kind, {}).get(self._known(tier), [])]

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def exists(self, tier: str) -> bool:
        return self._known(tier) in self.snapshots.read()[1].get("chunks", {})

    def read(self, tier: str, metadata: bool = False, state: dict | None = None) -> DataFrame:
        return self._read(self._folders("chunks", tier, state), CHUNK_SCHEMA + ", metadata map<string,string>" * metadata)

    def sources(self) -> DataFrame:
        state = self.snapshots.read()[1]
        both = [self._read(self._folders("sources", t, state), SOURCE_SCHEMA).withColumn("tier", F.lit(t)) for t in TIERS]
        return both[0].unionByName(both[1])

    def add(self, chunks: DataFrame, tier: str, kind: str = "file", replace: bool = False, new_only: bool = False, at: datetime | None = None) -> int:
        """Append, or replace the tier; how many chunks were written. Nothing to add is an error. new_only leaves out
        chunks whose seg_id the tier has, so that the same chunks may come again; it looks again if another writer was first.
        The rows are written before a version names them, so they are evaluated once, and a replaced tier may be read for
        them."""
        self._known(tier)
        for _ in range(20):
            base, state = self.snapshots.read()
            meta = F.col("metadata") if "metadata" in chunks.columns else F.lit(None)
            rows = chunks.select("seg_id", "source", F.col("chunk_index").cast("int"), "chunk", meta.cast("map<string,string>").alias("metadata"))
            if new_only and not replace:
                rows = rows.dropDuplicates(["seg_id"]).join(self.read(tier, state=state).select("seg_id"), "seg_id", "left_anti")
            folders = {"chunks": self.snapshots.new_folder("chunks"), "sources": self.snapshots.new_folder("sources")}
            try:
                rows.write.parquet(self.snapshots.at(folders["chunks"]))
                made = self.spark.read.schema(CHUNK_SCHEMA).parquet(self.snapshots.at(folders["chunks"]))
                when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
                per_source = made.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"))
                per_source.select("source", F.lit(kind).alias("type"), F.lit(tier).alias("tier"), when.alias("added_at"), "n_chunks").write.parquet(self.snapshots.at(folders["sources"]))
                n = made.count()
                if not n and not new_only:
                    raise ValueError("no chunks to add")

                def change(now: dict, folders=folders) -> dict:
                    return {k: {**now.get(k, {}), tier: [*([] if replace and k == "chunks" else now.get(k, {}).get(tier, [])), f]} for k, f in folders.items()}

                if not n:
                    self._discard(folders)
                elif new_only:
                    self.snapshots.commit(base, change(state))
                else:
                    self.snapshots.update(change)
                return n
            except Conflict:
                self._discard(folders)
            except BaseException:
                self._discard(folders)
                raise
        raise Conflict("other writers were always first")

    def _discard(self, folders: dict[str, str]) -> None:
        for folder in folders.values():
            delete_path(self.spark, self.snapshots.at(folder))

    def clear(self, tier: str) -> None:
        """An empty tier; its sources leave the log."""
        self._known(tier)
        self.snapshots.update(lambda now: {k: {**now.get(k, {}), tier: []} for k in ("chunks", "sources")})

    def merge(self) -> bool:
        """Realtime chunks and their sources go to the historical tier, duplicates and all; False if there are none."""
        moved = []

        def change(now: dict) -> dict | None:
            moved[:] = now.get("chunks", {}).get("realtime", [])
            if not moved or self.read("realtime", state=now).limit(1).isEmpty():
                moved.clear()
                return None
            return {k: {"historical": [*now.get(k, {}).get("historical", []), *now.get(k, {}).get("realtime", [])], "realtime": []} for k in ("chunks", "sources")}

        self.snapshots.update(change)
        return bool(moved)

    def compact(self, tier: str) -> None:
        """One folder instead of many (a stream leaves one for each batch)."""
        base, state = self.snapshots.read()
        folders = {"chunks": self.snapshots.new_folder("chunks"), "sources": self.snapshots.new_folder("sources")}
        try:
            self.read(tier, metadata=True, state=state).write.parquet(self.snapshots.at(folders["chunks"]))
            self._read(self._folders("sources", tier, state), SOURCE_SCHEMA).write.parquet(self.snapshots.at(folders["sources"]))
            self.snapshots.commit(base, {k: {**state.get(k, {}), tier: [f]} for k, f in folders.items()})
        except BaseException:
            self._discard(folders)
            raise

    def vacuum(self, keep: int = 1) -> list[str]:
        return self.snapshots.vacuum(lambda state: [f for kinds in state.values() for tier in kinds.values() for f in tier], keep)

    def status(self, state: dict | None = None) -> DataFrame:
        both = [self.read(t, state=state).withColumn("tier", F.lit(t)).withColumnRenamed("chunk", "text") for t in TIERS]
        return status(both[0].unionByName(both[1]))

    def info(self) -> DataFrame:
        """(tier, exists, n_sources, n_chunks, n_chars, last_updated, n_bytes) of both tiers, all of one version."""
        state = self.snapshots.read()[1]
        sizes = []
        for tier in TIERS:
            folders = self._folders("chunks", tier, state)
            files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folders).select("length") if folders else None
            sizes.append((tier, tier in state.get("chunks", {}), (files.agg(F.sum("length")).first()[0] or 0) if folders else 0))
        rows = self.spark.createDataFrame(sizes, "tier string, exists boolean, n_bytes long")
        log = [self._read(self._folders("sources", t, state), SOURCE_SCHEMA).withColumn("tier", F.lit(t)) for t in TIERS]
        updated = log[0].unionByName(log[1]).groupBy("tier").agg(F.max("added_at").alias("last_updated"))
        counted = rows.join(self.status(state), "tier", "left").join(updated, "tier", "left")
        return counted.select("tier", "exists", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sources", "n_chunks", "n_chars")], "last_updated", "n_bytes")

    def statistics(self, config: EngineConfig | None = None, index: RetrievalIndex | None = None) -> DataFrame:
        """One row on all of it: sources, chunks, characters, bytes and the last change of both tiers, the index' size, and
        the settings as JSON."""
        whole = self.info().agg(F.sum("n_sources").alias("n_sources"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_chars").alias("n_chars"), F.sum("n_bytes").alias("n_bytes"), F.max("last_updated").alias("last_updated"))
        found = index.info().first() if index else None
        return whole.select("*", F.lit(found.n_segments if found else 0).alias("indexed_segments"), F.lit(found.n_bytes if found else 0).alias("index_bytes"), F.lit(json.dumps(asdict(config or EngineConfig()))).alias("config"))
