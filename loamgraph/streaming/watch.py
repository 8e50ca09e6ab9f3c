"""Incremental indexing, also from a stream of file changes.

What a file declares, imports and uses is kept with each revision. A change parses the changed files alone; names are
then resolved by joins over the declarations of all files, old and new. So a revision is the graph that indexing all
files at once would give, whatever was edited, added or deleted, and in whatever batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.plans.catalog import Catalog, file_changes
from loamgraph.plans.storage import forget, store
from loamgraph.schema import Graph

FILE_COLUMNS = ["path", "hash", "language", "bytes", "lines", "content", "manifest"]


@dataclass(frozen=True)
class Language:
    """How files (path, language, content, manifest) are parsed, one by one (``declare``: rows with a ``file``), and how
    the declarations of all of them become a graph (``resolve``)."""

    declare: Callable[[DataFrame], DataFrame]
    resolve: Callable[[DataFrame], Graph]

    def extract(self, files: DataFrame) -> Graph:
        return self.resolve(self.declare(files))


def index(catalog: Catalog, files: DataFrame, language: Language, whole: bool = True, deleted: DataFrame | None = None, progress: Callable[[str, int], None] = lambda phase, n: None) -> int:
    """Bring the catalog up to ``files`` (``FILE_COLUMNS``); its revision.

    With ``whole`` the table is all there is, so missing files are deleted; else it is a batch of changes, and
    ``deleted`` (path) names the files that went. Nothing is written if nothing changed. Of rows that repeat a path the
    one of the greatest hash holds. ``progress`` is told each phase as it begins, with the number of files concerned.
    """
    progress("discover", 0)
    revision = catalog.revision()
    once = files.groupBy("path").agg(F.max_by(F.struct(*FILE_COLUMNS[1:]), "hash").alias("f")).select("path", "f.*")
    if not revision:
        progress("analyze", once.count())
        declared = store(language.declare(once), "declared")
        graph = language.resolve(declared)
        progress("persist", 0)
        done = catalog.commit({"files": once.select(FILE_COLUMNS), "declared": declared, "nodes": graph.nodes, "edges": graph.edges}, 0)
        forget(declared)
        progress("complete", done)
        return done
    stored, known = catalog.table("files", revision), catalog.table("declared", revision)
    changed, missing = file_changes(stored, once)
    gone = missing if whole else (stored.select("path").join(deleted.select("path"), "path", "left_semi") if deleted is not None else stored.select("path").where("false"))
    changed, gone = store(changed, "changed"), store(gone.distinct(), "gone")
    if changed.isEmpty() and gone.isEmpty():
        forget(changed, gone)
        return revision
    touched = changed.unionByName(gone).distinct()
    fresh = store(once.join(changed, "path", "left_semi").join(gone, "path", "left_anti").select(FILE_COLUMNS), "fresh")
    progress("analyze", fresh.count())
    kept = known.join(touched.withColumnRenamed("path", "file"), "file", "left_anti").select(known.columns)
    declared = store(kept.unionByName(language.declare(fresh).select(known.columns)), "declared")
    graph = language.resolve(declared)
    progress("persist", 0)
    left = stored.join(touched, "path", "left_anti").select(FILE_COLUMNS)
    done = catalog.commit({"files": left.unionByName(fresh), "declared": declared, "nodes": graph.nodes, "edges": graph.edges}, revision)
    forget(changed, gone, fresh, declared)
    progress("complete", done)
    return done


def watch(spark: SparkSession, root: str, catalog: Catalog, language: Language, prepare: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = False):
    """Start a query that indexes files as they come under ``root``; ``prepare`` makes the rows of ``index`` of them."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            index(catalog, prepare(rows), language, whole=False)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
