"""Projections and filters of nodes: what is listed, shown, compared and left out, and rendered packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgraph.schema import Graph

# Kinds that are compared between snapshots, the ones compared if exported, and those never in a context.
COMPARED = ("function", "method", "constructor", "class", "service", "controller", "interface", "type", "enum", "route", "event_handler", "queue_handler")
COMPARED_IF_EXPORTED = ("constant", "variable")
NOT_IN_CONTEXT = ("file", "package", "repository", "directory", "variable", "constant")
LABEL, DETAIL = 200, 1000


def nodes_in_files(graph: Graph, files: DataFrame | None = None) -> DataFrame:
    """Nodes of files (path), or of all, with their place among those of the file by id, from 1."""
    rows = graph.nodes.where("file is not null")
    if files is not None:
        rows = rows.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select(graph.nodes.columns)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("file").orderBy("id")))


def comparable(kind: Column, exported: Column, visibility: Column, file: Column) -> Column:
    """Whether a declaration takes part when snapshots are compared."""
    listed = kind.isin(*COMPARED) | (kind.isin(*COMPARED_IF_EXPORTED) & exported)
    member = (kind == "property") & (F.coalesce(visibility, F.lit("")) != "private")
    return file.isNotNull() & F.coalesce(listed | member, F.lit(False))


def compact(nodes: DataFrame) -> DataFrame:
    """(id, symbol, kind, at, signature): a node as tools print it."""
    at = F.when(F.col("file").isNotNull() & F.col("start_line").isNotNull(), F.concat("file", F.lit(":"), "start_line", F.lit("-"), "end_line"))
    return nodes.select("id", F.col("qualified_name").alias("symbol"), "kind", at.alias("at"), "signature")


def explorer_nodes(nodes: DataFrame, root: Column) -> DataFrame:
    """(id, label, kind, root_id, symbol_id, detail): nodes of a view over several roots, texts cut to its limits."""
    first = F.coalesce(F.substring("signature", 1, DETAIL), F.col("kind"))
    detail = F.concat(first, F.lit("\n"), F.col("prov_source"), F.lit(": "), F.col("evidence"))
    return nodes.select(F.to_json(F.array(root, F.col("id"))).alias("id"), F.substring("qualified_name", 1, LABEL).alias("label"), "kind", root.alias("root_id"), F.col("id").alias("symbol_id"), detail.alias("detail"))


def omission(kind: Column, name: Column, file: Column, exact: Column, terms: Column, task: Column, scope: Column) -> Column:
    """Why a candidate is left out of a task's context; null if it is not. ``terms`` are the task's own words."""
    no = ~F.coalesce(exact, F.lit(False))
    asked = F.array_contains(terms, F.lower(name))
    inside = scope.isNull() | (scope == ".") | F.coalesce(file.startswith(F.concat(F.regexp_replace(scope, "/$", ""), F.lit("/"))), F.lit(False))
    reason = F.when(no & kind.isin(*NOT_IN_CONTEXT), "declaration kind excluded from context")
    reason = reason.when((kind == "constructor") & no & ~F.lower(task).contains("constructor"), "constructor not requested")
    return reason.when((kind == "property") & no & ~asked, "property does not match task").when(~inside, "outside scope")


def valid_paths(paths: DataFrame, failed: DataFrame) -> DataFrame:
    """Paths (path_id, steps: an array of (from, to) struct of projects) none of whose steps touches a failed project."""
    touched = paths.select("path_id", F.explode("steps").alias("s")).select("path_id", F.explode(F.array("s.from", "s.to")).alias("project"))
    bad = touched.join(failed.select("project").distinct(), "project", "left_semi").select("path_id").distinct()
    return paths.join(bad, "path_id", "left_anti")


def render_context(packages: DataFrame, symbols: DataFrame) -> DataFrame:
    """(request_id, markdown) of packages (request_id, task, strategy, tokens, budget) and their symbols (request_id,
    position, symbol_id, first_line, last_line, representation, reason, text)."""
    head = F.concat(F.lit("## "), "symbol_id", F.lit(" [lines "), "first_line", F.lit("-"), "last_line", F.lit("; "), "representation", F.lit("]"))
    one = F.concat_ws("\n", head, F.concat(F.lit("Selected: "), "reason"), "text")
    listed = symbols.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("position", one.alias("text")))).alias("all"))
    title = F.concat(F.lit("Strategy: "), "strategy", F.lit(" | Tokens: "), "tokens", F.lit("/"), "budget")
    body = F.array_join(F.transform("all", lambda s: s["text"]), "\n\n")
    return packages.join(listed, "request_id", "left").select("request_id", F.concat_ws("\n\n", F.lit("# Context"), "task", title, body).alias("markdown"))
