"""Folders of data that change in one step.

A store keeps data folders and numbered manifests side by side. A manifest is a small JSON document that names the folders
which make up one version. A change writes new folders first and then creates the next manifest, which only one writer
can do; until then readers see the version before, and a writer that dies leaves nothing but folders that the next expiry
removes. Readers that have begun on a version finish on it as long as it is kept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has made this version."""


class Store:
    """A folder of manifests and data under ``root``, which all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, files = self._path(folder), self._files()
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n.partition(".")[0]) for n in self._names("manifests") if n.endswith(".json"))

    def read(self, version: int) -> dict[str, Any] | None:
        """The document of a version; None for one whose writer did not finish it, or that has been removed."""
        try:
            lines = self.spark.read.text(str(self._path("manifests", f"{version:020d}.json").toString()), wholetext=True)
            return json.loads(lines.first()[0])
        except (PySparkException, ValueError, TypeError):
            return None

    def _finished(self) -> Iterator[tuple[int, dict[str, Any]]]:
        """Finished versions, newest first."""
        for version in reversed(self.versions()):
            document = self.read(version)
            if document is not None:
                yield version, document

    def current(self) -> tuple[int, dict[str, Any]] | None:
        return next(self._finished(), None)

    def fresh(self) -> str:
        """A new data folder that no version names yet."""
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def commit(self, document: dict[str, Any], before: int | None) -> int:
        """Make ``document`` the version after ``before``; fails with ``Conflict`` if there is one already."""
        known = self.versions()
        newest = known[-1] if known else None
        found = self.current()
        if (found[0] if found else None) != before:
            raise Conflict(f"{self.root}: version {before} is no longer the last")
        version = 0 if newest is None else newest + 1
        try:
            out = self._files().create(self._path("manifests", f"{version:020d}.json"), False)
        except Exception as fault:
            raise Conflict(f"{self.root}: version {version} exists") from fault
        try:
            out.write(bytearray(json.dumps(document).encode()))
        finally:
            out.close()
        return version

    def expire(self, keep: int = 2) -> list[str]:
        """Remove all versions but the last ``keep``, and the data folders that none of these names; what was removed."""
        kept, files, removed = [], self._files(), []
        for version, document in self._finished():
            if len(kept) < keep:
                kept.append((version, json.dumps(document)))
        oldest = kept[-1][0] if kept else 0
        for version in self.versions():
            if version < oldest:
                files.delete(self._path("manifests", f"{version:020d}.json"), False)
        for name in self._names("data"):
            if not any(name in text for _, text in kept):
                files.delete(self._path("data", name), True)
                removed.append(name)
        return removed

    def drop(self) -> None:
        """Remove everything."""
        self._files().delete(self._path(), True)
