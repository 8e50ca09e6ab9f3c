"""The tool surface: every operation by name, with checked arguments, over one graph."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators import adjacency as A
from loamgraph.operators import history as H
from loamgraph.operators import search as S
from loamgraph.operators import traversal as V
from loamgraph.operators.budget import serialize_within
from loamgraph.operators.context import context
from loamgraph.operators.cycles import cycles
from loamgraph.schema import Graph
from loamgraph.sources.config import bounded
from loamgraph.sources.files import function_bindings, repository_checks

TOOLS = (
    "workflow", "review_changes", "context", "excerpt", "symbol", "search", "callers", "callees", "references",
    "implementations", "dependencies", "dependents", "skeleton", "tests", "impact", "slice", "file_slice", "path",
    "architecture", "feature", "status",
)
ESSENTIAL = ("workflow", "context", "symbol", "search", "impact", "file_slice")


class Ambiguous(ValueError):
    """A name that fits several nodes."""


@dataclass
class Workbench:
    """A graph with its files (path, hash, content) and, for changes, hunks and semantic facts."""

    spark: SparkSession
    graph: Graph
    files: DataFrame | None = None
    live: DataFrame | None = None
    hunks: DataFrame | None = None
    facts: DataFrame | None = None

    def seeds(self, *names: str) -> DataFrame:
        """The nodes that names stand for, as seeds; a name of several nodes is an error, and so is one of none."""
        found = A.resolve(self.graph, self.spark.createDataFrame([(n,) for n in names], "query string"), 2).collect()
        out = []
        for name in names:
            hits = sorted((r for r in found if r["query"] == name), key=lambda r: r["match"])
            hits = [h for h in hits if h["match"] == hits[0]["match"]]
            if not hits:
                raise KeyError(f"no node is named {name}")
            if len(hits) > 1:
                raise Ambiguous(f"{name} may be {', '.join(h['id'] for h in hits)}")
            out.append((hits[0]["id"],))
        return self.spark.createDataFrame(out, "seed string")

    def call(self, tool: str, **given) -> DataFrame:
        """The result of a tool as a DataFrame."""
        if tool not in TOOLS:
            raise KeyError(f"no tool is named {tool}")
        return getattr(self, f"do_{tool}")(**given)

    def text(self, tool: str, max_tokens: int = 2000, **given) -> str:
        """The result as JSON within a token budget; the driver gets at most 2000 rows."""
        bounded(max_tokens, 128, 32_000, "max_tokens")
        rows = [r.asDict(True) for r in self.call(tool, **given).limit(2000).collect()]
        return serialize_within(rows, max_tokens, lambda t: len(t) // 4 + 1)

    def do_symbol(self, name: str) -> DataFrame:
        return self.graph.nodes.join(self.seeds(name).withColumnRenamed("seed", "id"), "id", "left_semi")

    def do_search(self, query: str, kinds: list[str] | None = None, scope: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        bounded(limit, 1, 500, "limit")
        bounded(offset, 0, 1_000_000, "offset")
        nodes = self.graph.nodes if kinds is None else self.graph.nodes.where(F.col("kind").isin(kinds))
        if scope:
            nodes = nodes.where((F.col("file") == scope) | F.col("file").startswith(scope.rstrip("/") + "/"))
        if not query.strip():
            return nodes.orderBy("qualified_name", "id").offset(offset).limit(limit)
        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        fields = {n: c for n, c in (("identity", "qualified_name"), ("signature", "signature"), ("documentation", "documentation")) if c in nodes.columns}
        found = S.stemmed_search(S.stemmed_index(nodes, "id", fields), asked, limit + offset)
        if offset == 0 and found.isEmpty():
            return nodes.where(F.lower("name").contains(query.lower())).orderBy("id").limit(limit)
        return found.where(F.col("rank") > offset).join(nodes, "id").orderBy("rank")

    def do_callers(self, name: str) -> DataFrame:
        return A.callers(self.graph, self.seeds(name), 200)

    def do_callees(self, name: str) -> DataFrame:
        return A.callees(self.graph, self.seeds(name), 200)

    def do_references(self, name: str) -> DataFrame:
        return A.references(self.graph, self.seeds(name), 200)

    def do_implementations(self, name: str) -> DataFrame:
        return A.implementations(self.graph, self.seeds(name), 200)

    def do_dependencies(self, name: str) -> DataFrame:
        return A.dependencies(self.graph, self.seeds(name), 200).orderBy("id").limit(200)

    def do_dependents(self, name: str) -> DataFrame:
        return A.dependents(self.graph, self.seeds(name), 200).orderBy("id").limit(200)

    def do_skeleton(self, name: str) -> DataFrame:
        return A.skeleton(self.graph, self.seeds(name))

    def do_tests(self, name: str, depth: int = 4) -> DataFrame:
        bounded(depth, 1, 8, "depth")
        return V.test_paths(self.graph, self.seeds(name), depth).orderBy("dispatch", "distance", "node")

    def do_impact(self, name: str, depth: int = 3, limit: int = 100) -> DataFrame:
        bounded(depth, 1, 10, "depth")
        bounded(limit, 1, 500, "limit")
        return V.impact(self.graph, self.seeds(name), depth).orderBy("distance", "node").limit(limit)

    def do_path(self, source: str, target: str, depth: int = 8) -> DataFrame:
        bounded(depth, 1, 20, "depth")
        goal = self.seeds(target).withColumnRenamed("seed", "node")
        return V.shortest_paths(self.graph, self.seeds(source), depth).join(goal, "node", "left_semi")

    def do_architecture(self, scope: str | None = None) -> DataFrame:
        nodes = self.graph.nodes if scope is None else self.graph.nodes.where((F.col("file") == scope) | F.col("file").startswith(scope.rstrip("/") + "/"))
        return A.architecture(Graph(nodes, self.graph.edges)).limit(100)

    def do_feature(self, concept: str) -> DataFrame:
        found = self.do_search(concept, limit=40).select("id")
        if self.facts is not None:
            near = self.facts.where(F.exists("concepts", lambda c: F.lower(c).contains(concept.lower()))).select(F.col("symbol_id").alias("id"))
            found = found.unionByName(near)
        return found.distinct().join(self.graph.nodes, "id").orderBy("id").limit(100)

    def do_status(self) -> DataFrame:
        return A.stats(self.graph)

    def do_context(self, task: str, max_tokens: int = 2000) -> DataFrame:
        bounded(max_tokens, 128, 32_000, "max_tokens")
        return context(self.graph, self.spark.createDataFrame([(0, task, max_tokens)], "request_id int, task string, max_tokens int"))

    def do_excerpt(self, name: str, query: str, max_lines: int = 40) -> DataFrame:
        bounded(max_lines, 1, 400, "max_lines")
        return S.excerpt_window(self._source(name), "id", "source", query, max_lines)

    def _source(self, name: str) -> DataFrame:
        span = self.do_symbol(name).select("id", "file", "start_line", "end_line").join(self.files.withColumnRenamed("path", "file"), "file")
        lines = F.split("content", "\n", -1)
        return span.select("id", "file", F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("source"))

    def do_slice(self, name: str) -> DataFrame:
        return self._source(name)

    def do_file_slice(self, file: str, start: int, end: int) -> DataFrame:
        rows = self.files.where(F.col("path") == file)
        if self.live is None:
            return S.file_slice(rows, "path", "content", start, end)
        fresh = rows.join(self.live.select("path", F.col("hash").alias("_live")), "path")
        return S.file_slice(fresh, "path", "content", start, end, expected="_live")

    def do_review_changes(self, depth: int = 3) -> DataFrame:
        """Impact of all changed declarations, nearest first, each node by the declaration that reaches it first."""
        changed = self.changed().select(F.col("id").alias("seed")).distinct()
        found = V.impact(self.graph, changed, depth).where("distance > 0")
        return found.groupBy("node", "kind").agg(F.min(F.struct("distance", "seed")).alias("b")).select("node", "kind", "b.distance", F.col("b.seed").alias("via")).orderBy("distance", "node").limit(100)

    def changed(self) -> DataFrame:
        spans = self.graph.nodes.where("kind <> 'file' and start_line is not null").select("file", "id", "start_line", "end_line")
        return H.changed_declarations(self.hunks, spans)

    def do_workflow(self, action: str, **given) -> DataFrame:
        return {
            "health": lambda: H.freshness(self.files, self.live),
            "text": lambda query, **more: S.text_search(self.files, "path", "content", query, **more),
            "trace": lambda trace: S.trace_frames(self.spark.createDataFrame([(0, trace)], "id int, trace string"), "id", "trace"),
            "file": lambda file: A.file_overview(self.graph).where(F.col("file") == file),
            "cycles": lambda: cycles(A.dependent_files(self.graph), "dependent", "file"),
            "changes": self.changed,
            "change_impact": self.do_review_changes,
            "test_gaps": self.test_gaps,
            "checks": lambda: repository_checks(self.files.where("manifest")),
            "connections": self.connections,
        }[action](**given)

    def connections(self) -> DataFrame:
        """What the declared endpoints need: their settings as missing, since a graph holds no values of them, or fixed."""
        from loamgraph.operators.topology import readiness

        found = function_bindings(self.files.where("manifest"))
        status = F.when(F.col("setting").isNull(), "configured").otherwise("missing")
        folder = F.when(F.col("file").contains("/"), F.regexp_replace("file", r"/[^/]*$", "")).otherwise(".")
        return readiness(found.select(folder.alias("service"), F.col("protocol").alias("kind"), F.coalesce("setting", F.lit("")).alias("setting"), status.alias("status"), F.col("file").alias("place")))

    def test_gaps(self) -> DataFrame:
        """(id, tests): changed callables with the number of tests that may reach them."""
        changed = self.changed().join(self.graph.nodes.where("kind in ('function', 'method', 'constructor')").select("id"), "id", "left_semi")
        seeds = changed.select(F.col("id").alias("seed")).distinct()
        tests = V.test_paths(self.graph, seeds, 4).groupBy("seed").agg(F.count("*").alias("tests"))
        return seeds.join(tests, "seed", "left").select(F.col("seed").alias("id"), F.coalesce("tests", F.lit(0)).alias("tests"))


def main(arguments: list[str] | None = None) -> int:
    """``python -m loamgraph.tools <catalog> [--root folder] <tool> [json arguments]``: the result as JSON.

    ``index`` brings the catalog up to the folder. With a folder, the files in it as they are and git's changes there are
    compared with the indexed ones.
    """
    import argparse
    import os

    from loamgraph.plans.catalog import Catalog
    from loamgraph.sources import files, git
    from loamgraph.sources.typescript import LANGUAGE
    from loamgraph.streaming.watch import index

    parser = argparse.ArgumentParser(prog="loamgraph.tools")
    parser.add_argument("catalog")
    parser.add_argument("--root")
    parser.add_argument("tool", choices=["index", *TOOLS])
    parser.add_argument("arguments", nargs="?", default="{}", type=json.loads)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    catalog = Catalog(spark, given.catalog)
    live = files.discover(spark, given.root) if given.root else None
    if given.tool == "index":
        if live is None:
            parser.error("index needs --root")
        print(json.dumps({"revision": index(catalog, live, LANGUAGE)}))
        return 0
    hunks = git.change_hunks(spark, given.root) if given.root and os.path.exists(os.path.join(given.root, ".git")) else None
    bench = Workbench(spark, catalog.graph(), catalog.table("files"), live, hunks)
    print(bench.text(given.tool, **given.arguments))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
