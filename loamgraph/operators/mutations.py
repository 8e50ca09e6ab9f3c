"""Changes of stored tables as DataFrame to DataFrame functions: upserts, deletions and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgraph.schema import Graph

EDGE_KEY = ["source", "target", "type", "owner"]


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys; the columns are those of ``old``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def put_files(files: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(files, new, ["path"])


def put_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(nodes, new, ["id"])


def put_edges(edges: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Upsert by the four-part key, the last of equal new ones by ``order``.

    An edge of type CALLED_BY, or of a confidence outside 0 to 1, is an error.
    """
    bad = (F.col("type") == "CALLED_BY") | ~F.col("confidence").between(0, 1) | F.col("confidence").isNull()
    checked = new.withColumn("type", F.when(bad, F.raise_error(F.concat(F.lit("Invalid edge: "), "type"))).otherwise(F.col("type")))
    last = Window.partitionBy(*EDGE_KEY).orderBy(F.col(order).desc() if order else F.lit(1))
    return upsert(edges, checked.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n"), EDGE_KEY)


def remove_files(graph: Graph, files: DataFrame, paths: DataFrame) -> tuple[DataFrame, Graph]:
    """Files, nodes and edges without those of ``paths`` (path): owned edges go, and all edges of removed nodes."""
    gone = paths.select("path").distinct()
    nodes = graph.nodes.join(gone.withColumnRenamed("path", "file"), "file", "left_anti").select(graph.nodes.columns)
    lost = graph.nodes.join(gone.withColumnRenamed("path", "file"), "file", "left_semi").select("id")
    edges = graph.edges.join(gone.withColumnRenamed("path", "owner"), "owner", "left_anti")
    for end in ("source", "target"):
        edges = edges.join(lost.withColumnRenamed("id", end), end, "left_anti")
    return files.join(gone, "path", "left_anti"), Graph(nodes, edges.select(graph.edges.columns))


def remove_owned_edges(edges: DataFrame, owners: DataFrame) -> DataFrame:
    return edges.join(owners.select("owner").distinct(), "owner", "left_anti").select(edges.columns)


def prune_nodes(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """Nodes without those of the files in ``kept`` (file, id) that are not listed there."""
    touched = nodes.join(kept.select("file").distinct(), "file", "left_semi")
    gone = touched.join(kept.select("file", "id"), ["file", "id"], "left_anti").select("id")
    return nodes.join(gone, "id", "left_anti").select(nodes.columns)


def latest(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows by ``order``: retention of runs and records."""
    return rows.orderBy(F.desc(order)).limit(n)


def semantic_dependencies(facts: DataFrame) -> DataFrame:
    """(fact_id, path) of facts (id, hashes map)."""
    return facts.select(F.col("id").alias("fact_id"), F.explode(F.map_keys("hashes")).alias("path"))


def invalidate_semantic(facts: DataFrame, paths: DataFrame) -> DataFrame:
    """Facts none of whose files changed."""
    hit = semantic_dependencies(facts).join(paths.select("path").distinct(), "path", "left_semi").select(F.col("fact_id").alias("id")).distinct()
    return facts.join(hit, "id", "left_anti").select(facts.columns)


def current_facts(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Facts all of whose hashes are those of the files as they are."""
    pairs = facts.select("id", F.explode("hashes").alias("path", "want"))
    stale = pairs.join(files.select("path", F.col("hash").alias("have")), "path", "left").where(~F.col("want").eqNullSafe(F.col("have"))).select("id").distinct()
    return facts.join(stale, "id", "left_anti").select(facts.columns)


def parse_facts(replies: DataFrame) -> DataFrame:
    """(symbol_id, summary, concepts, constraints, confidence) of valid replies (symbol_id, reply), JSON perhaps fenced."""
    schema = "summary string, concepts array<string>, constraints array<string>, confidence double"
    bare = F.regexp_replace(F.regexp_replace(F.trim("reply"), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    d = replies.where(F.length("reply") <= 20_000).select("symbol_id", F.from_json(bare, schema).alias("d")).select("symbol_id", "d.*")
    plain = lambda c, most: (F.size(c) <= most) & F.forall(c, lambda s: s.isNotNull() & (F.length(s) <= 200) & ~s.rlike(r"[\x00-\x1f]"))
    return d.where((F.length("summary") <= 1200) & plain("concepts", 12) & plain("constraints", 8) & F.col("confidence").between(0, 1))
