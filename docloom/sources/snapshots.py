"""Snapshots of a data set: a version is one small file that names all folders the data set consists of then.

Data is written to folders that no version names yet; a commit publishes the next version's file, whole or not at all, so a
failure at any step leaves the version before, and readers keep the folders of the version they began with. Two
writers that start from one version can't both commit; the later one starts again from what is there then. Folders that no
kept version names go with vacuum() alone, when no reader can need them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from docloom.sources.files import delete_path, file_system, names_in, publish, read_small


class Conflict(Exception):
    """Another writer has committed the version."""


@dataclass
class Snapshots:
    spark: SparkSession
    root: str

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.root}/_versions")]

    def _path(self, version: int) -> str:
        return f"{self.root}/_versions/{version:020d}.json"

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """A version and its state, the latest by default; -1 and {} where there is none."""
        if version is None:
            version = max(self.versions(), default=-1)
        return (version, json.loads(read_small(self.spark, self._path(version)))) if version >= 0 else (-1, {})

    def commit(self, base: int, state: dict) -> int:
        if not publish(self.spark, self._path(base + 1), json.dumps(state)):
            raise Conflict(f"version {base + 1} is there already")
        return base + 1

    def update(self, change: Callable[[dict], dict | None], attempts: int = 20) -> int:
        """Commits change(state) on top of the latest version, again on what is latest then if another writer was first.
        None: nothing to commit."""
        for _ in range(attempts):
            base, state = self.read()
            made = change(state)
            if made is None:
                return base
            try:
                return self.commit(base, made)
            except Conflict:
                continue
        raise Conflict(f"no version could be committed in {attempts} attempts")

    def new_folder(self, kind: str) -> str:
        """The name of a folder under the root, for data that a version will name."""
        return f"{kind}-{uuid.uuid4().hex}"

    def at(self, folder: str) -> str:
        return f"{self.root}/{folder}"

    def vacuum(self, folders_of: Callable[[dict], list[str]], keep: int = 1) -> list[str]:
        """Versions but the last `keep` go, and the folders that only they named, or no version; their names. Writers
        that are at work have folders that no version names, too, so none may be."""
        versions = self.versions()
        for old in versions[:-keep]:
            delete_path(self.spark, self._path(old))
        needed = {f for v in versions[-keep:] for f in folders_of(self.read(v)[1])}
        system, at = file_system(self.spark, self.root)
        found = [x.getPath().getName() for x in system.listStatus(at) if x.isDirectory()] if system.exists(at) else []
        gone = [f for f in found if f not in needed and not f.startswith("_")]
        for folder in gone:
            delete_path(self.spark, self.at(folder))
        return gone
