"""The outbox: what a batch of questions led to, written once and read by all that follows.

A batch has an id of its own. Its rows are written to a folder, then its manifest is published under the batch's id, which
no second writer can do; so a batch that comes again, after a failure or from a stream, finds its manifest and adds nothing, and
of two writers of one batch the later one's rows go. Task ids are reserved by range from a counter, a short log
whose entries are published in the same way: they never repeat, whatever fails; a range whose batch wasn't published stays unused.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from docloom.sources.files import delete_path, names_in, path_exists, publish, read_small

#: A batch's rows; the ids have the type that the requests give them (these are for an empty outbox).
DRAFTS = {
    "request_id": "long", "seq": "long", "user_id": "string", "ts": "timestamp", "query": "string", "len": "int", "abstract": "string", "unsuitable": "string", "hits": "long",
    "top_score": "double", "external": "boolean", "used": "int", "draft": "string", "task_id": "long",
}
EVIDENCE = "query_id long, ord int, title string, url string, text string, expires_at timestamp"


@dataclass
class Outbox:
    spark: SparkSession
    root: str

    def _manifest(self, batch: str) -> str:
        return f"{self.root}/batches/{hashlib.sha256(batch.encode()).hexdigest()}.json"

    def manifest(self, batch: str) -> dict | None:
        path = self._manifest(batch)
        return json.loads(read_small(self.spark, path)) if path_exists(self.spark, path) else None

    def manifests(self) -> list[dict]:
        """Of all batches that were published, in order of their task ids. A row of metadata for each batch."""
        folder = f"{self.root}/batches"
        return sorted((json.loads(read_small(self.spark, f"{folder}/{n}")) for n in names_in(self.spark, folder)), key=lambda m: m["first"])

    def reserve(self, n: int) -> int:
        """The first of n task ids that no one else gets."""
        folder = f"{self.root}/reserved"
        while True:
            names = names_in(self.spark, folder)
            first = 1
            if names:
                last = json.loads(read_small(self.spark, f"{folder}/{names[-1]}"))
                first = last["first"] + last["n"]
            number = int(names[-1].removesuffix(".json")) + 1 if names else 0
            if publish(self.spark, f"{folder}/{number:020d}.json", json.dumps({"first": first, "n": n})):
                for old in names[:-1]:  # the last two are enough to go on from
                    delete_path(self.spark, f"{folder}/{old}")
                return first

    def new_folder(self) -> str:
        return f"{self.root}/data-{uuid.uuid4().hex}"

    @staticmethod
    def drafts_columns(requests: DataFrame) -> list[tuple[str, str]]:
        given = dict(requests.dtypes)
        return [(name, given[name] if name in ("request_id", "seq", "user_id") else kind) for name, kind in DRAFTS.items()]

    def commit(self, batch: str, folder: str, first: int, n: int) -> dict:
        """Publishes a folder as the batch's; if another one has been, that counts and this one goes."""
        made = {"batch": batch, "folder": folder.rpartition("/")[2], "first": first, "n": n}
        if not publish(self.spark, self._manifest(batch), json.dumps(made)):
            delete_path(self.spark, folder)
        return self.manifest(batch)

    def _read(self, manifests: list[dict], part: str, schema: str) -> DataFrame:
        paths = [p for m in manifests if path_exists(self.spark, p := f"{self.root}/{m['folder']}/{part}")]
        return self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def drafts(self, batch: str | None = None) -> DataFrame:
        """A batch's rows, or those of all batches."""
        chosen = self.manifests() if batch is None else [m for m in (self.manifest(batch),) if m]
        return self._read(chosen, "drafts", ", ".join(map(" ".join, DRAFTS.items())))

    def evidence(self, batch: str | None = None) -> DataFrame:
        chosen = self.manifests() if batch is None else [m for m in (self.manifest(batch),) if m]
        return self._read(chosen, "evidence", EVIDENCE)

    def expire_evidence(self, now: datetime) -> int:
        """Evidence is kept for its time only: folders of batches all of whose evidence has expired go; how many."""
        gone = 0
        for m in self.manifests():
            path = f"{self.root}/{m['folder']}/evidence"
            if path_exists(self.spark, path):
                last = self.spark.read.parquet(path).agg({"expires_at": "max"}).first()[0]
                if last is None or last < now:
                    delete_path(self.spark, path)
                    gone += 1
        return gone
