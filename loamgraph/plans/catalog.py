"""Immutable revisions of a graph as Parquet.

A commit writes a whole folder aside and then renames it to ``revision=<n>``; the highest number is current. The rename
fails if that folder is there, so of two writers that build on one revision one fails, and a crash at any moment leaves
the revisions as they were. There is no pointer to keep in step. Edges are written sorted by source and by target, the
two ways in which traversals read them. All file operations go through Hadoop's file systems; on one whose renames copy
(most object stores) commits need a table format with its own log instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.schema import Graph

REVISION, STAGED = "revision=", "staged-"


class StaleRevision(RuntimeError):
    """The catalog moved on since the revision that a commit builds on."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def revisions(self) -> list[int]:
        """The revisions that are there, in rising order."""
        root = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(n.removeprefix(REVISION)) for n in names if n.startswith(REVISION))

    def revision(self) -> int:
        """The current revision; 0 before the first commit."""
        return max(self.revisions(), default=0)

    def has(self, name: str, revision: int | None = None) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{REVISION}{revision or self.revision()}/{name}"))

    def table(self, name: str, revision: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{REVISION}{revision or self.revision()}/{name}")

    def graph(self, revision: int | None = None, by: str = "source") -> Graph:
        revision = revision or self.revision()
        return Graph(self.table("nodes", revision), self.table(f"edges_by_{by}", revision))

    def commit(self, tables: dict[str, DataFrame], based_on: int) -> int:
        """Write ``tables`` (``edges`` twice, by source and by target) as the next revision, which is then current."""
        if self.revision() != based_on:
            raise StaleRevision(f"built on revision {based_on}, current is {self.revision()}")
        new = based_on + 1
        staged = f"{self.root}/{STAGED}{uuid.uuid4().hex}"
        for name, df in tables.items():
            if name == "edges":
                for by in ("source", "target"):
                    df.repartition(by).sortWithinPartitions(by, "type").write.parquet(f"{staged}/edges_by_{by}")
            else:
                df.write.parquet(f"{staged}/{name}")
        self._publish(staged, new)
        for old in self.revisions():
            if old <= new - self.keep:
                self._fs.delete(self._path(f"{self.root}/{REVISION}{old}"), True)
        return new

    def _publish(self, staged: str, new: int) -> None:
        """Rename a folder to a revision, unless that is there already."""
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        qualified = self._fs.makeQualified
        try:
            files.rename(qualified(self._path(staged)), qualified(self._path(f"{self.root}/{REVISION}{new}")), options)
        except Exception as e:
            self._fs.delete(self._path(staged), True)
            if "FileAlreadyExists" in str(e) or self.revision() >= new:
                raise StaleRevision(f"revision {new} was committed by someone else") from e
            raise

    def clean(self) -> None:
        """Delete the revisions and what unfinished commits have left, nothing else."""
        for status in self._fs.listStatus(self._path(self.root)):
            if status.getPath().getName().startswith((REVISION, STAGED)):
                self._fs.delete(status.getPath(), True)


def file_changes(stored: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed or new paths, and deleted ones, of (path, hash) tables."""
    old = live.join(stored.select("path", F.col("hash").alias("_old")), "path", "left")
    changed = old.where(~F.col("_old").eqNullSafe(F.col("hash"))).select("path")
    return changed, stored.join(live, "path", "left_anti").select("path")
