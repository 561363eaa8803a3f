"""Snapshots of an output folder: all tables of a run appear together, or none does.

A run writes its tables into a folder of its own, `runs/<name>`. It is published by one small manifest file,
`manifests/<number>`, that is written under another name and renamed: a rename to a name that exists fails, so of two
runs that end at once each gets a number of its own. Readers follow the highest number. A run that fails, or tables
that are still being written, are in no manifest.
"""

from __future__ import annotations

import json
import logging
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: Published runs that stay for readers that have just begun; older ones are removed.
KEEP = 2
_DIGITS = 12

log = logging.getLogger(__name__)


class Folder:
    """The few file operations that snapshots need, on any file system Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def names(self, *parts: str) -> list[str]:
        path = self._path(self.at(*parts))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, *parts: str) -> str:
        stream = self._fs.open(self._path(self.at(*parts)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, text: str, *parts: str) -> bool:
        """Write a whole file under a new name; False if the name is taken."""
        target = self._path(self.at(*parts))
        draft = self._path(self.at(*parts[:-1], f".{uuid.uuid4().hex}"))
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.exists(target) and self._fs.rename(draft, target):
            return True
        self._fs.delete(draft, False)
        return False

    def remove(self, *parts: str) -> None:
        self._fs.delete(self._path(self.at(*parts)), True)


@dataclass(frozen=True)
class Run:
    """A folder that only this run writes to."""

    folder: Folder
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def path(self, table: str) -> str:
        return self.folder.at("runs", self.name, table)

    def drop(self, table: str) -> None:
        self.folder.remove("runs", self.name, table)

    def discard(self) -> None:
        self.folder.remove("runs", self.name)


def begin(spark: SparkSession, output_dir: str) -> Run:
    return Run(Folder(spark, output_dir))


def _manifests(folder: Folder) -> list[str]:
    return [name for name in folder.names("manifests") if name.isdigit()]


def publish(run: Run, tables: list[str], keep: int = KEEP) -> int:
    """Make the run's tables the ones that readers see; returns the number of the manifest."""
    text = json.dumps({"run": run.name, "tables": tables})
    while True:
        known = _manifests(run.folder)
        number = int(known[-1]) + 1 if known else 1
        if run.folder.create(text, "manifests", f"{number:0{_DIGITS}d}"):
            break
    for old in _manifests(run.folder)[:-keep]:
        name = json.loads(run.folder.read("manifests", old))["run"]
        run.folder.remove("manifests", old)
        run.folder.remove("runs", name)
    return number


def current(spark: SparkSession, output_dir: str) -> dict[str, str]:
    """Paths of the published tables, all of one run; empty where nothing is published."""
    folder = Folder(spark, output_dir)
    known = _manifests(folder)
    if not known:
        return {}
    manifest = json.loads(folder.read("manifests", known[-1]))
    return {table: folder.at("runs", manifest["run"], table) for table in manifest["tables"]}
