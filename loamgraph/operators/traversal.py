"""Bounded traversals from many seeds at once, level by level.

A level is one join of the frontier with the steps and one anti-join with what was seen; its result is a written
table, so the plan of a level never holds those before it. Loops end at the depth or when a frontier is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.plans.storage import forget, store
from loamgraph.schema import DEPENDENCY_TYPES, Graph

PATH_TYPES = ("CALLS", "IMPORTS", "DEPENDS_ON", "CREATES", "HANDLES")


def steps(graph: Graph, into: tuple[str, ...] = (), out: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, dispatch): edges of types ``into`` against their direction and ``out`` along it."""
    possible = (F.col("type") == "IMPLEMENTS").alias("dispatch")
    against = graph.edges_of(into).select(F.col("target").alias("src"), F.col("source").alias("dst"), possible)
    along = graph.edges_of(out).select(F.col("source").alias("src"), F.col("target").alias("dst"), possible)
    return against.unionByName(along).distinct()


def reach(seeds: DataFrame, step: DataFrame, depth: int | None, paths: bool = False, stop: DataFrame | None = None) -> DataFrame:
    """(seed, node, dispatch, distance[, path]) of all nodes within ``depth`` steps of each seed.

    ``dispatch`` is false if some path without a dispatch step is short enough; then the distance is the least of those,
    else that of any path. ``path`` is the first of the shortest in the order of its ids. Nodes of ``stop`` (id) are
    reached but not left. Without a depth the whole closure is taken.
    """
    step = store(step.repartition("src"), "steps")  # every level reads it
    start = seeds.select("seed", F.col("seed").alias("node"), F.lit(False).alias("dispatch"), F.lit(0).alias("distance")).distinct()
    if paths:
        start = start.withColumn("path", F.array("node"))
    frontier = store(start, "frontier")
    levels, distance = [frontier], 0
    while depth is None or distance < depth:
        distance += 1
        leaving = frontier if stop is None else frontier.join(stop.select(F.col("id").alias("node")), "node", "left_anti")
        near = leaving.join(step.withColumnRenamed("dispatch", "_d"), F.col("node") == F.col("src"))
        dispatch = (F.col("dispatch") | F.col("_d")).alias("dispatch")
        columns = ["seed", F.col("dst").alias("node"), dispatch, *([F.concat("path", F.array("dst")).alias("path")] if paths else [])]
        new = near.select(*columns)
        new = new.groupBy("seed", "node", "dispatch").agg(F.min("path").alias("path")) if paths else new.distinct()
        seen = levels[0].select("seed", "node", "dispatch")
        for level in levels[1:]:
            seen = seen.unionByName(level.select("seed", "node", "dispatch"))
        sure = seen.where("not dispatch").select("seed", "node")
        new = new.join(seen, ["seed", "node", "dispatch"], "left_anti").join(sure, ["seed", "node"], "left_anti")
        frontier = store(new.withColumn("distance", F.lit(distance)), "frontier")
        if frontier.isEmpty():
            forget(frontier)
            break
        levels.append(frontier)
    forget(step)
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    first = F.struct(F.col("dispatch").cast("int").alias("flag"), "distance", *(["path"] if paths else []))
    best = whole.groupBy("seed", "node").agg(F.min(first).alias("b"))
    return best.select("seed", "node", (F.col("b.flag") == 1).alias("dispatch"), "b.distance", *(["b.path"] if paths else []))


def impact(graph: Graph, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """What may change with each seed: (seed, node, kind, distance, score, dispatch, surface).

    ``surface`` sorts a node into test, route, module, api or other, in that order of preference.
    """
    step = steps(graph, DEPENDENCY_TYPES, ("TESTED_BY", "IMPLEMENTS"))
    found = reach(seeds, step, depth).join(graph.nodes.select(F.col("id").alias("node"), "kind", "exported", "entry_point"), "node")
    surface = F.when(F.col("kind") == "test", "test").when((F.col("kind") == "route") | F.col("entry_point"), "route")
    surface = surface.when(F.col("kind").isin("module", "file", "package"), "module").when(F.col("exported"), "api").otherwise("other")
    score = F.round(1 / (F.col("distance") + 1), 3).alias("score")
    return found.select("seed", "node", "kind", "distance", score, "dispatch", surface.alias("surface"))


def shortest_paths(graph: Graph, seeds: DataFrame, depth: int = 8, types: tuple[str, ...] = PATH_TYPES) -> DataFrame:
    """(seed, node, distance, path) along directed dependency edges; filter on ``node`` for a goal."""
    return reach(seeds, steps(graph, (), types).withColumn("dispatch", F.lit(False)).distinct(), depth, paths=True).drop("dispatch")


def test_paths(graph: Graph, seeds: DataFrame, depth: int = 4) -> DataFrame:
    """(seed, node, distance, dispatch) of the tests that reach each seed; paths end at tests."""
    tests = graph.nodes.where("kind = 'test'").select("id")
    step = steps(graph, ("CALLS", "REFERENCES", "IMPLEMENTS"), ("TESTED_BY", "IMPLEMENTS"))
    found = reach(seeds, step, depth, stop=tests)
    return found.join(tests.withColumnRenamed("id", "node"), "node", "left_semi").select("seed", "node", "distance", "dispatch")


def relationships(graph: Graph, seeds: DataFrame, depth: int = 1, types: tuple[str, ...] | None = None) -> DataFrame:
    """(seed, source, target, type): the edges among the nodes within ``depth`` steps, in either direction."""
    every = graph.edges_of(types)
    both = every.select(F.col("source").alias("src"), F.col("target").alias("dst")).unionByName(every.select(F.col("target").alias("src"), F.col("source").alias("dst")))
    found = reach(seeds, both.withColumn("dispatch", F.lit(False)).distinct(), depth).select("seed", "node")
    inside = every.select("source", "target", "type").distinct().join(found.withColumnRenamed("node", "source"), "source")
    return inside.join(found.withColumnRenamed("node", "target"), ["seed", "target"]).select("seed", "source", "target", "type")


def reverse_closure(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): everything that depends on each seed, however far, over (file, dependent) pairs; without caps."""
    step = pairs.select(F.col("file").alias("src"), F.col("dependent").alias("dst"), F.lit(False).alias("dispatch")).distinct()
    return reach(seeds, step, None).select("seed", "node")


def capped_order(edges: DataFrame, seed: str, depth: int, limit: int, cap: int = 200) -> DataFrame:
    """(position, node, distance): the order in which a first-in-first-out search meets nodes, up to ``limit``.

    A level is ordered by (parent's position, type, id), keeps each node's first place and at most ``cap`` edges of each
    parent, and is cut where the limit is met: the queue's order without a queue. ``edges`` is (src, dst, type).
    """
    from pyspark.sql.window import Window

    spark = edges.sparkSession
    edges = store(edges.repartition("src"), "steps")
    seen = store(spark.createDataFrame([(0, seed, 0)], "position long, node string, distance int"), "capped")
    frontier, size = seen, 1
    for distance in range(1, depth + 1):
        near = frontier.join(edges, F.col("node") == F.col("src"))
        rank = F.row_number().over(Window.partitionBy("node").orderBy("type", "dst"))
        near = near.withColumn("_r", rank).where(F.col("_r") <= cap)
        first = near.groupBy("dst").agg(F.min(F.struct("position", "_r")).alias("at"))
        new = first.withColumnRenamed("dst", "node").join(seen.select("node"), "node", "left_anti")
        new = new.orderBy("at").limit(limit - size)  # bounded by the limit of the search
        place = F.row_number().over(Window.orderBy("at")) - 1 + size
        frontier = store(new.select(place.cast("long").alias("position"), "node", F.lit(distance).alias("distance")), "capped")
        n = frontier.count()
        if not n:
            break
        size += n
        seen = seen.unionByName(frontier)
        if size >= limit:
            break
    return seen
