"""One-hop operators: every operator answers for all seeds at once.

``seeds`` has a column ``seed`` (a node id). Results are keyed by seed. ``cap`` keeps the first neighbours by (type,
id), the order in which capped traversals see them; without it whole neighbourhoods are returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgraph.schema import DEPENDENCY_TYPES, Graph


def neighbors(graph: Graph, seeds: DataFrame, direction: str, types: tuple[str, ...] | list[str] | None = None, cap: int | None = None) -> DataFrame:
    """(seed, id, type, owner) of the nodes one edge away, ``in`` or ``out``."""
    near, far = ("target", "source") if direction == "in" else ("source", "target")
    edges = graph.edges_of(types).select(F.col(near).alias("seed"), F.col(far).alias("id"), "type", "owner")
    found = edges.join(seeds.select("seed").distinct(), "seed", "left_semi")
    if cap is not None:
        rank = F.row_number().over(Window.partitionBy("seed").orderBy("type", "id", "owner"))
        found = found.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")
    return found


def adjacent(graph: Graph, seeds: DataFrame, direction: str, types: tuple[str, ...] | list[str], cap: int | None = None) -> DataFrame:
    """Distinct (seed, id, kind, name) one edge away."""
    near = neighbors(graph, seeds, direction, types, cap).select("seed", "id").distinct()
    return near.join(graph.nodes.select("id", "kind", "name"), "id").select("seed", "id", "kind", "name")


def callers(graph: Graph, seeds: DataFrame, cap: int | None = None) -> DataFrame:
    return adjacent(graph, seeds, "in", ["CALLS"], cap)


def callees(graph: Graph, seeds: DataFrame, cap: int | None = None) -> DataFrame:
    return adjacent(graph, seeds, "out", ["CALLS"], cap)


def references(graph: Graph, seeds: DataFrame, cap: int | None = None) -> DataFrame:
    return adjacent(graph, seeds, "in", ["REFERENCES", "ACCEPTS", "RETURNS"], cap)


def implementations(graph: Graph, seeds: DataFrame, cap: int | None = None) -> DataFrame:
    return adjacent(graph, seeds, "in", ["IMPLEMENTS"], cap)


def with_members(graph: Graph, seeds: DataFrame) -> DataFrame:
    """(root, seed): each seed and the nodes it contains."""
    own = seeds.select(F.col("seed").alias("root"), "seed").distinct()
    inside = neighbors(graph, seeds, "out", ["CONTAINS"]).select(F.col("seed").alias("root"), F.col("id").alias("seed"))
    return own.unionByName(inside).distinct()


def tests_for(graph: Graph, seeds: DataFrame) -> DataFrame:
    """(seed, id): tests of each seed or its members, by TESTED_BY or by calling or referencing them."""
    members = with_members(graph, seeds)
    tested = neighbors(graph, members, "out", ["TESTED_BY"]).select("seed", "id")
    tests = graph.nodes.where("kind = 'test'").select("id")
    used = neighbors(graph, members, "in", ["CALLS", "REFERENCES"]).select("seed", "id").join(tests, "id", "left_semi")
    return members.join(tested.unionByName(used), "seed").select(F.col("root").alias("seed"), "id").distinct()


def aggregate(graph: Graph, seeds: DataFrame, direction: str, cap: int | None = None) -> DataFrame:
    """(seed, id): dependencies (``out``) or dependents (``in``) of each seed with its members, those inside aside."""
    members = with_members(graph, seeds)
    found = neighbors(graph, members, direction, DEPENDENCY_TYPES, cap).select("seed", "id")
    found = members.join(found, "seed").select("root", "id").distinct()
    inside = members.select("root", F.col("seed").alias("id"))
    return found.join(inside, ["root", "id"], "left_anti").select(F.col("root").alias("seed"), "id")


def dependencies(graph: Graph, seeds: DataFrame, cap: int | None = None) -> DataFrame:
    return aggregate(graph, seeds, "out", cap)


def dependents(graph: Graph, seeds: DataFrame, cap: int | None = None) -> DataFrame:
    return aggregate(graph, seeds, "in", cap)


def dependent_files(graph: Graph) -> DataFrame:
    """(file, dependent): files from whose nodes edges lead into a file, itself aside."""
    files = graph.nodes.where("file is not null").select("id", "file")
    ends = graph.edges.select("source", "target").distinct().join(files.withColumnRenamed("id", "target"), "target")
    ends = ends.join(files.select(F.col("id").alias("source"), F.col("file").alias("dependent")), "source")
    return ends.where("file <> dependent").select("file", "dependent").distinct()


def file_overview(graph: Graph) -> DataFrame:
    """Per file: declarations, files it depends on and files that depend on it, as counts."""
    pairs = dependent_files(graph)
    declared = graph.nodes.where("file is not null").groupBy("file").agg(F.count("*").alias("declarations"))
    out = pairs.groupBy(F.col("dependent").alias("file")).agg(F.count("*").alias("depends_on"))
    into = pairs.groupBy("file").agg(F.count("*").alias("dependents"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return declared.join(out, "file", "left").join(into, "file", "left").select("file", "declarations", zero("depends_on"), zero("dependents"))


def skeleton(graph: Graph, seeds: DataFrame) -> DataFrame:
    """(seed, members, outline): the signatures of contained nodes (names where there are none) by their place in the
    source, else by name, under the seed's own."""
    has = set(graph.nodes.columns)
    place = F.col("start_offset") if "start_offset" in has else F.lit(None).cast("int")
    text = F.coalesce("signature", "name") if "signature" in has else F.col("name")
    rows = graph.nodes.select("id", place.alias("at"), text.alias("text"))
    inside = neighbors(graph, seeds, "out", ["CONTAINS"]).join(rows, "id")
    listed = inside.groupBy("seed").agg(F.count("*").alias("members"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("all"))
    own = rows.select(F.col("id").alias("seed"), F.col("text").alias("own"))
    outline = F.concat(F.col("own"), F.lit(" { "), F.array_join(F.transform("all", lambda m: m["text"]), "; "), F.lit(" }"))
    return listed.join(own, "seed").select("seed", "members", outline.alias("outline"))


def architecture(graph: Graph, entry_points: int = 30, per_entry: int = 10) -> DataFrame:
    """The first entry points by id with their first outgoing edges, both capped as a report."""
    entry = graph.nodes.where("entry_point").orderBy("id").limit(entry_points).select(F.col("id").alias("seed"))
    return neighbors(graph, entry, "out", None, per_entry).select("seed", "type", "id")


def stats(graph: Graph) -> DataFrame:
    """(metric, n): numbers of files, nodes and edges."""
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
    files = graph.nodes.where("file is not null").select("file").distinct()
    return one("files", files).unionByName(one("nodes", graph.nodes)).unionByName(one("edges", graph.edges))


def resolve(graph: Graph, names: DataFrame, limit: int = 20) -> DataFrame:
    """(query, id, match, rank): nodes whose id (0), qualified name (1) or name (2) is ``query``, best first."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("match"), F.col(c).alias("query")) for i, c in enumerate(("id", "qualified_name", "name"))]))
    keyed = graph.nodes.select("id", keys.alias("k")).select("id", "k.match", "k.query")
    hits = keyed.join(names.select("query").distinct(), "query").groupBy("query", "id").agg(F.min("match").alias("match"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("match", "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit)


def edges_with_nodes(graph: Graph) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = graph.nodes.select("id")
    kept = graph.edges.join(ids, graph.edges.source == ids.id, "left_semi")
    return kept.join(ids, kept.target == ids.id, "left_semi")
