"""Versions of a table: which folders make it up, as small JSON documents.

A writer puts its files beside the current ones, then commits the next version;
readers see the version that they opened. A commit creates a numbered file and
fails if another writer was first, so nothing is overwritten unseen. A crash
before the commit leaves files that no version names, and one during it an
incomplete document, which readers pass over.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class LostRace(RuntimeError):
    """Another writer committed the version that this one was about to write."""


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = f"{self.root}/_manifest"

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        fs, folder = self._fs(), self._path(self.folder)
        if not fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self) -> tuple[int, dict | None]:
        """The last number in use and the newest complete document (None before the first)."""
        versions = self._versions()
        for v in reversed(versions):
            stream = self._fs().open(self._path(f"{self.folder}/{v:09d}.json"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return versions[-1], json.loads(text)
            except ValueError:  # its writer did not finish
                continue
        return (versions[-1] if versions else 0), None

    def commit(self, seen: int, state: dict) -> int:
        """Write ``state`` as the version after ``seen``, the number that ``read`` gave."""
        version = seen + 1
        try:
            out = self._fs().create(self._path(f"{self.folder}/{version:09d}.json"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                raise LostRace(f"version {version} of {self.root} was written by another job") from None
            raise
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        return version

    def prune(self, keep: int = 5) -> None:
        """Drop all but the last documents (the folders that only they name may go then too)."""
        for v in self._versions()[:-keep]:
            self._fs().delete(self._path(f"{self.folder}/{v:09d}.json"), False)

    def delete(self, path: str) -> None:
        self._fs().delete(self._path(path), True)

    def folders(self, path: str) -> list[str]:
        fs, p = self._fs(), self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []
