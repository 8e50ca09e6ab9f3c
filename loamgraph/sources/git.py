"""Git as tables. ``git`` runs on the driver, where the repository is; its listings are parsed with expressions."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
MARK = "\x01"


def run_git(root: str, *args: str, limit: int = 100_000_000) -> str:
    """The output of a read-only git command, without the user's own configuration taking effect on its format."""
    out = subprocess.run(["git", "-c", "core.quotePath=false", "-C", root, *args], capture_output=True, check=True, timeout=120).stdout
    if len(out) > limit:
        raise ValueError("the listing is too large")
    return out.decode("utf-8", "replace")


def commit_files(spark: SparkSession, root: str, most: int = 500) -> DataFrame:
    """(commit_idx, commit, file) of the last commits, newest first."""
    rows, index, commit = [], -1, ""
    for line in run_git(root, "log", f"-n{most}", "--name-only", f"--pretty=format:{MARK}%H", "--no-renames").splitlines():
        if line.startswith(MARK):
            index, commit = index + 1, line[1:]
        elif line:
            rows.append((index, commit, line))
    return spark.createDataFrame(rows, "commit_idx int, commit string, file string")


def diff_arguments(mode: str, base: str | None = None) -> list[str]:
    if mode == "working":
        return ["HEAD"]
    if mode == "staged":
        return ["--cached"]
    if mode == "branch" and base and not base.startswith("-"):
        return [f"{base}...HEAD"]
    raise ValueError("the mode is working, staged or branch with a base")


def change_hunks(spark: SparkSession, root: str, mode: str = "working", base: str | None = None, most: int = 1000) -> DataFrame:
    """(file, hunk_no, old_start, old_count, new_start, new_count) of a diff without context."""
    text = run_git(root, "diff", "--unified=0", "--no-color", "--no-ext-diff", "--no-renames", *diff_arguments(mode, base))
    return parse_hunks(spark.createDataFrame([(i, x) for i, x in enumerate(text.split("\n"))], "at long, line string"), most)


def parse_hunks(lines: DataFrame, most: int = 1000) -> DataFrame:
    """Hunks of the lines (at, line) of one unified diff; a removed file keeps its old name."""
    from pyspark.sql.window import Window

    order = Window.orderBy("at")  # one diff, read by one git call
    old = F.when(F.col("line").startswith("--- a/"), F.substring("line", 7, 1 << 20))
    new = F.when(F.col("line").startswith("+++ b/"), F.substring("line", 7, 1 << 20)).when(F.col("line") == "+++ /dev/null", F.lit("\x00"))
    marked = lines.withColumn("old", F.last(old, True).over(order)).withColumn("new", F.last(new, True).over(order))
    hunks = marked.where(F.col("line").rlike(HUNK))
    number = lambda i, default: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("line", HUNK, i), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(default))
    file = F.when(F.col("new") == "\x00", F.col("old")).otherwise(F.col("new"))
    rows = hunks.select("at", file.alias("file"), number(1, 0).alias("old_start"), number(2, 1).alias("old_count"), number(3, 0).alias("new_start"), number(4, 1).alias("new_count"))
    rows = rows.withColumn("hunk_no", F.row_number().over(Window.partitionBy("file").orderBy("at")))
    first = rows.select("file").distinct().orderBy("file").limit(most)
    return rows.join(first, "file", "left_semi").select("file", "hunk_no", "old_start", "old_count", "new_start", "new_count")


def changed_files(spark: SparkSession, root: str, most: int = 1000) -> DataFrame:
    """(file, status) of staged, unstaged and untracked changes against the last commit."""
    tracked = [x.split("\t", 1) for x in run_git(root, "diff", "--name-status", "--no-renames", "HEAD").splitlines() if "\t" in x]
    untracked = run_git(root, "ls-files", "--others", "--exclude-standard").splitlines()
    rows = sorted([(f, s) for s, f in tracked] + [(f, "?") for f in untracked])[:most]
    return spark.createDataFrame(rows, "file string, status string")


def snapshot(spark: SparkSession, root: str, revision: str, max_bytes: int = 10_000_000, max_total: int = 100_000_000, max_files: int = 5000, accept=None) -> DataFrame:
    """(file, oid, content) of the text blobs of a revision that ``accept`` (a test of paths) admits; each blob is read
    once, however many files have it, and all of them by one process. Limits bound what the driver holds."""
    if revision.startswith("-"):
        raise ValueError("not a revision")
    names, sizes = [], {}
    for line in run_git(root, "ls-tree", "-r", "-l", "-z", revision).split("\0"):
        head, _, name = line.partition("\t")
        if not name:
            continue
        mode, kind, oid, size = head.split()
        if kind == "blob" and mode != "120000" and int(size) <= max_bytes and (accept is None or accept(name)):
            names.append((name, oid))
            sizes[oid] = int(size)
    if len(names) > max_files or sum(sizes.values()) > max_total:
        raise ValueError("the snapshot is too large")
    asked = "".join(f"{o}\n" for o in sizes).encode()
    data = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input=asked, capture_output=True, check=True, timeout=120).stdout
    blobs, at = [], 0
    for _ in sizes:
        end = data.index(b"\n", at)
        oid, _, size = data[at:end].decode().split()
        content = data[end + 1 : end + 1 + int(size)]
        at = end + 2 + int(size)
        if b"\0" not in content:
            blobs.append((oid, content.decode("utf-8", "replace")))
    kept = spark.createDataFrame(blobs, "oid string, content string")
    return spark.createDataFrame(names, "file string, oid string").join(kept, "oid").select("file", "oid", "content")


def snapshot_identity(root: str, revision: str) -> str:
    """SHA-256 of a revision's listing."""
    import hashlib

    return hashlib.sha256(run_git(root, "ls-tree", "-r", revision).encode()).hexdigest()
