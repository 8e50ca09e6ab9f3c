"""Git-style signals, freshness, hunks and before/after comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgraph.schema import DEPENDENCY_TYPES, Graph

BULK = 30  # files of a commit from which its pairs are not counted


def frequency(commits: DataFrame) -> DataFrame:
    """(file, n, signal): commits of each file, and their share of the most frequent file's."""
    counts = commits.groupBy("file").agg(F.count("*").alias("n"))
    most = counts.agg(F.greatest(F.max("n"), F.lit(1)).alias("most"))  # one row
    return counts.crossJoin(F.broadcast(most)).select("file", "n", F.round(F.col("n") / F.col("most"), 6).alias("signal"))


def last_commit(commits: DataFrame) -> DataFrame:
    """(file, commit): the first commit of each file in log order (the least ``commit_idx``)."""
    return commits.groupBy("file").agg(F.min_by("commit", "commit_idx").alias("commit"))


def cochange(commits: DataFrame, bulk: int = BULK) -> DataFrame:
    """(a, b, n): how often two files changed together, in commits of at most ``bulk`` files; both orders."""
    sizes = commits.groupBy("commit").agg(F.count("*").alias("size")).where(F.col("size") <= bulk).select("commit")
    small = commits.join(sizes, "commit", "left_semi").select("commit", "file").distinct()
    x, y = small.withColumnRenamed("file", "a"), small.withColumnRenamed("file", "b")
    return x.join(y, "commit").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def freshness(stored: DataFrame, live: DataFrame) -> DataFrame:
    """(path, status): modified, new or deleted files; (path, hash) on both sides."""
    a, b = stored.select("path", F.col("hash").alias("old")), live.select("path", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def fingerprint(files: DataFrame, group: str | None = None) -> DataFrame:
    """SHA-256 of all ``path:hash`` lines in order, per group; one text per group, as the definition has it."""
    line = F.concat_ws(":", "path", "hash")
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint")
    return files.groupBy(group).agg(digest) if group else files.agg(digest)


def changed_declarations(hunks: DataFrame, spans: DataFrame, size: int = 64) -> DataFrame:
    """(file, hunk_no, id): the smallest declarations that a hunk touches.

    hunks: (file, hunk_no, new_start, new_count); a pure deletion (count 0) lies between two lines and touches what
    holds both. Of overlapping declarations those that hold another overlapping one are left out.
    """
    first = F.col("new_start")
    last = F.when(F.col("new_count") > 0, first + F.col("new_count") - 1).otherwise(first + 1)
    h = hunks.select("file", "hunk_no", first.alias("_a"), last.alias("_b"), (F.col("new_count") == 0).alias("_gone"))
    laid = h.select("*", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor(F.col("_b") / size))).alias("_strip"))
    strips = F.explode(F.sequence(F.floor(F.col("start_line") / size), F.floor(F.col("end_line") / size)))
    s = spans.select("file", "id", "start_line", "end_line", strips.alias("_strip"))
    touch = F.when(F.col("_gone"), (F.col("start_line") <= F.col("_a")) & (F.col("end_line") >= F.col("_b"))).otherwise((F.col("start_line") <= F.col("_b")) & (F.col("end_line") >= F.col("_a")))
    near = laid.join(s, ["file", "_strip"]).where(touch).select("file", "hunk_no", "id", "start_line", "end_line").distinct()
    inner = near.select("file", "hunk_no", F.col("id").alias("_i"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    holds = (near.file == inner.file) & (near.hunk_no == inner.hunk_no) & (F.col("start_line") <= F.col("_s")) & (F.col("end_line") >= F.col("_e"))
    strict = (F.col("end_line") - F.col("start_line") > F.col("_e") - F.col("_s"))
    return near.join(inner, holds & strict, "left_anti").select("file", "hunk_no", "id")


#: The order of changes in a report.
CHANGE_ORDER = ("removed", "signature", "rename", "move", "modified", "added")


def compare_declarations(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, qualified_name, change) of two snapshots (file, qualified_name, hash, header); equal ones are left out.

    Names that a side has more than once are compared by hash alone.
    """
    key = ["file", "qualified_name"]
    side = lambda df, p: df.groupBy(key).agg(F.count("*").alias(f"{p}n"), F.min("hash").alias(f"{p}hash"), F.min("header").alias(f"{p}header"), F.array_sort(F.collect_list("hash")).alias(f"{p}all"))
    both = side(before, "b").join(side(after, "a"), key, "full_outer")
    change = F.when(F.col("bn").isNull(), "added").when(F.col("an").isNull(), "removed").when(F.col("ball") == F.col("aall"), None)
    change = change.when((F.col("bn") == 1) & (F.col("an") == 1) & (F.col("bheader") != F.col("aheader")), "signature").otherwise("modified")
    return both.select(*key, change.alias("change")).where("change is not null")


def move_candidates(removed: DataFrame, added: DataFrame, by: str = "hash") -> DataFrame:
    """(before, after): declarations (id, kind, hash) gone and come with an equal kind and hash, both alone in theirs."""
    one = lambda df, name: df.groupBy("kind", by).agg(F.count("*").alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")
    return one(removed, "before").join(one(added, "after"), ["kind", by]).select("before", "after")


def change_page(changes: DataFrame, id: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """``changes`` in report order with ``position`` from 0; one page of them."""
    order = F.array_position(F.array(*[F.lit(c) for c in CHANGE_ORDER]), F.col("change"))
    page = changes.orderBy(order, id).offset(offset).limit(limit)
    return page.withColumn("position", F.row_number().over(Window.orderBy(order, id)) - 1 + offset)


def uncovered(spans: DataFrame, group: str, first: str, last: str) -> DataFrame:
    """(group, gap_start, gap_end): stretches between sorted intervals that none of them covers."""
    order = Window.partitionBy(group).orderBy(first, last)
    reached = F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = spans.select(group, F.col(first).alias("_f"), reached.alias("_r")).where("_r + 1 < _f")
    return gaps.select(group, (F.col("_r") + 1).alias("gap_start"), (F.col("_f") - 1).alias("gap_end")).distinct()


def merge_consumers(before: DataFrame, after: DataFrame) -> DataFrame:
    """(target, node, signature, hash, dispatch, path, snapshot): consumers of two snapshots; one that is equal in all of
    these on both sides is ``both``."""
    key = ["target", "node", "signature", "hash", "dispatch", "path"]
    side = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    a, b = side(before, "_b").alias("b"), side(after, "_a").alias("a")
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in key]
    joined = a.join(b, same, "full_outer")
    snapshot = F.when(F.col("_b") & F.col("_a"), "both").when(F.col("_b"), "before").otherwise("after")
    return joined.select(*[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in key], snapshot.alias("snapshot"))


def review(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, file, qualified_name, from_file, from_name): what became of the declarations of two snapshots (file,
    qualified_name, kind, hash, masked, header).

    One that went and one that came are a move if their sources are equal, else a rename if they are equal but for the
    name (``masked``), each only if both are the only ones of their kind and source.
    """
    changes = compare_declarations(before, after)
    name = F.struct("file", "qualified_name").alias("id")
    side = lambda df, change: df.join(changes.where(F.col("change") == change).select("file", "qualified_name"), ["file", "qualified_name"], "left_semi").select(name, "kind", "hash", "masked")
    gone, come = side(before, "removed"), side(after, "added")
    moved = move_candidates(gone, come)
    left = gone.join(moved.select(F.col("before").alias("id")), "id", "left_anti"), come.join(moved.select(F.col("after").alias("id")), "id", "left_anti")
    paired = moved.withColumn("change", F.lit("move")).unionByName(move_candidates(*left, by="masked").withColumn("change", F.lit("rename")))
    none = F.lit(None).cast("string")
    used = paired.select(F.lit("removed").alias("change"), "before.file", "before.qualified_name").unionByName(paired.select(F.lit("added").alias("change"), "after.file", "after.qualified_name"))
    rest = changes.join(used, ["change", "file", "qualified_name"], "left_anti").select("change", "file", "qualified_name", none.alias("from_file"), none.alias("from_name"))
    return rest.unionByName(paired.select("change", "after.file", "after.qualified_name", F.col("before.file").alias("from_file"), F.col("before.qualified_name").alias("from_name")))


def consumers(before: Graph, after: Graph, targets: DataFrame, depth: int = 3, most: int = 8) -> DataFrame:
    """``merge_consumers`` of what depends on each target (target) within ``depth`` steps, in either snapshot's graph; of
    each snapshot the first ``most`` by distance and id, as a report."""
    from loamgraph.operators.traversal import reach, steps

    def side(graph: Graph) -> DataFrame:
        found = reach(targets.select(F.col("target").alias("seed")), steps(graph, DEPENDENCY_TYPES), depth, paths=True).where("distance > 0")
        first = F.row_number().over(Window.partitionBy("seed").orderBy("distance", "node"))
        has = lambda c: F.col(c) if c in graph.nodes.columns else F.lit(None).cast("string")
        nodes = graph.nodes.select(F.col("id").alias("node"), has("signature").alias("signature"), has("source_hash").alias("hash"))
        return found.withColumn("_n", first).where(F.col("_n") <= most).withColumnRenamed("seed", "target").join(nodes, "node").select("target", "node", "signature", "hash", "dispatch", "path")

    return merge_consumers(side(before), side(after))
