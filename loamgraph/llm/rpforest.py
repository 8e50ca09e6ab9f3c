"""Near-duplicate vectors by a forest of random-projection trees with spill.

Each tree splits its vectors at the median of a random projection, again and again; vectors within a margin of the
split go to both sides. The margin is half the standard deviation of the projected difference of two unit vectors
at the threshold, so such a pair is parted at a node with a chance of about 2 %: by one tree of depth 20 with a chance
of a third, by all ``TREES`` trees with one of 0.5 %, and pairs nearer than that far less. A node ends as a leaf when it
is expected to hold ``LEAF`` rows, or when its vectors lie so close that a split would part near-duplicates.

The upper nodes of the trees are fitted on a bounded sample (``SAMPLE`` rows, the first by a seeded hash of the id) and
every row is dropped through them. Leaves that hold more than ``MOST`` rows grow further: a subtree is fitted on a
sample of each such leaf's own rows, all leaves at a time, and its rows are dropped through it in blocks; this goes on
until every leaf fits or cannot be split. So the rows of a leaf, and the work a row, do not grow with the table.

Every row is compared with all rows of its leaves by exact cosine in double precision, and linked pairs are united. A
pair that shares several leaves counts in the first of them only, so numbers of links are exact over the pairs found. A
leaf over ``BLOCK`` rows (one that cannot be split) is compared block by block, two blocks to a task.

Vectors that are equal component by component are one class with a weight; they link with one another and are
compared once.

Defined results: vectors that are null, zero or hold a null or non-finite component link with nothing; the others are
compared with those of their own length; rows with a null id link with nothing and have a null component; rows that
repeat an id are rows of their own, and a component has its smallest id; an empty table gives an empty table; ties
do not arise, since every pair found is counted; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm.common import forget, store, table
from loamgraph.llm.components import components
from loamgraph.llm.vectors import bounded_sample, cosines, lengths, matrix, unit, usable

THRESHOLD = 0.95
TREES = 5
LEAF = 256
MOST = 1024  # rows from which a leaf grows further
BLOCK = 1024
SAMPLE = 32_768
LEAST_SAMPLED = 16  # sampled rows in a leaf
GROWN_SAMPLE = 4096  # rows of a leaf on which its subtree is fitted, about
DROP = 8192  # rows of a leaf dropped through its subtree by a task, about


class Forest:
    """Trees as nested tuples: a node has a direction, a split and two children, or is a leaf with a number."""

    def __init__(self, sample: np.ndarray, rows: int, threshold: float = THRESHOLD, trees: int = TREES, leaf: int | None = None, seed: int | list[int] = 29):
        rng = np.random.default_rng(seed)
        d = max(1, sample.shape[1])
        self.spread = np.sqrt(2 * (1 - threshold) / d)
        self.margin = self.spread / 2
        self.leaves = 0
        share = max(1, rows) / max(1, len(sample))
        least = max(LEAST_SAMPLED, (leaf or LEAF) / share)
        self.roots = [self._grow(sample, np.arange(len(sample)), least, rng, 0) for _ in range(trees)]

    def _grow(self, x: np.ndarray, at: np.ndarray, least: float, rng: np.random.Generator, depth: int) -> tuple:
        if len(at) > least and depth < 40:
            way = rng.standard_normal(x.shape[1])
            way /= np.linalg.norm(way)
            p = x[at] @ way
            if p.std() > 2 * self.spread:
                split = float(np.median(p))
                left, right = at[p < split + self.margin], at[p >= split - self.margin]
                if max(len(left), len(right)) < 0.95 * len(at):
                    return (way.astype(np.float32), split, self._grow(x, left, least, rng, depth + 1), self._grow(x, right, least, rng, depth + 1))
        self.leaves += 1
        return (self.leaves - 1,)

    def drop(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves of each row, by row and in rising order."""
        return fall(self.roots, self.margin, x)


def fall(roots: list[tuple], margin: float, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, leaves = [], []
    stack = [(root, np.arange(len(x))) for root in roots]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        if len(node) == 1:
            rows.append(at)
            leaves.append(np.full(len(at), node[0]))
            continue
        p = x[at] @ node[0]
        stack.append((node[2], at[p < node[1] + margin]))
        stack.append((node[3], at[p >= node[1] - margin]))
    rows, leaves = np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*leaves, np.zeros(0, np.int64)])
    order = np.lexsort((leaves, rows))
    return rows[order].astype(np.int64), leaves[order].astype(np.int64)


def links_in_block(ids: np.ndarray, x: np.ndarray, weight: np.ndarray, side: np.ndarray, owner: np.ndarray, leaves: np.ndarray, leaf: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, links counted here, smallest id reached here) of the rows that link.

    ``side`` is 0 or 1; with both there, only pairs across sides are counted. ``owner`` and ``leaves`` are the other
    leaves of the rows, as pairs.
    """
    thin = x.astype(np.float32)
    near = thin @ thin.T
    sure = near >= threshold + 1e-4  # single precision tells all but what lies at the threshold
    edge = np.abs(near - threshold) < 1e-4
    if side.any() and not side.all():
        across = side[:, None] != side[None, :]
        sure &= across
        edge &= across
    a, b = np.nonzero(edge)
    for at in range(0, len(a), 100_000):
        i, j = a[at : at + 100_000], b[at : at + 100_000]
        sure[i, j] = cosines(x[i], x[j]) >= threshold
    near = sure
    np.fill_diagonal(near, False)
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return rows, rows, rows
    near = near[np.ix_(rows, rows)]
    place = np.full(len(ids), -1)
    place[rows] = np.arange(len(rows))
    mine = (leaves < leaf) & (place[owner] >= 0)
    if mine.any():
        used, number = np.unique(leaves[mine], return_inverse=True)
        there = np.zeros((len(rows), len(used)), np.float32)
        there[place[owner[mine]], number] = 1
        count = (near & ~(there @ there.T > 0)) @ weight[rows]
    else:
        count = near @ weight[rows]
    label = ids[rows].copy()
    while True:
        reached = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (reached == label).all():
            return rows, count, label
        label = reached


def first_leaves(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(first, v, weight, leaves), stored, of ``classes`` (first, v, weight): the leaves of trees fitted on a sample."""
    forest = Forest(bounded_sample(classes, "first", "v", SAMPLE, 31)[1], n, threshold)

    def drop(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                row, leaf = forest.drop(unit(matrix(part.column(1))))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf))], names=["first", "v", "weight", "leaves"])

    schema = f"first bigint, v {classes.schema['v'].dataType.simpleString()}, weight bigint, leaves array<bigint>"
    return store(classes.select("first", "v", "weight").mapInArrow(drop, schema), "leaves")


def _fitter(depth: int, threshold: float):
    leaf_rows = LEAF

    def fit(t: pa.Table) -> pa.Table:
        leaf = t.column("leaf")[0].as_py()
        forest = Forest(unit(matrix(t.column("v"))), t.column("n")[0].as_py(), threshold, 1, leaf_rows, [abs(leaf), depth])
        tree = pickle.dumps((forest.roots, forest.margin)) if forest.leaves > 1 else None
        return pa.table([pa.array([leaf], pa.int64()), pa.array([tree], pa.binary())], names=["leaf", "tree"])

    return fit


def grow(dropped: DataFrame, threshold: float) -> DataFrame:
    """``dropped`` (first, v, weight, leaves), stored, once every leaf holds at most ``MOST`` rows or cannot be split.

    A round takes all crowded leaves at a time. A subtree is a row of a table, fitted on a bounded sample of its leaf.
    """
    kind = dropped.schema["v"].dataType.simpleString()
    stuck = None
    for depth in range(60):
        sizes = dropped.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > MOST)
        if stuck is not None:
            sizes = sizes.join(stuck, "leaf", "left_anti")
        crowded = store(sizes, "crowded")
        if crowded.isEmpty():
            forget(crowded)
            return dropped
        rows = dropped.select("first", "v", F.explode("leaves").alias("leaf")).join(crowded, "leaf")
        chosen = rows.where(F.pmod(F.xxhash64(F.lit(depth), "first", "leaf"), F.col("n")) < GROWN_SAMPLE)

        trees = store(chosen.groupBy("leaf").applyInArrow(_fitter(depth, threshold), "leaf bigint, tree binary"), "trees")
        lost = store(trees.where("tree is null").select("leaf"), "stuck")
        stuck = lost if stuck is None else stuck.unionByName(lost)
        parts = crowded.select("leaf", F.ceil(F.col("n") / DROP).cast("int").alias("parts"))
        block = F.pmod(F.xxhash64("first"), F.col("parts").cast("long")).alias("block")
        split = trees.where("tree is not null").join(parts, "leaf").select("leaf", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("block"))
        moving = rows.select("first", "v", "leaf").join(parts, "leaf").select("first", "v", "leaf", block)

        def sink(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            first, old, new = [], [], []
            if mine.num_rows and theirs.num_rows:
                roots, margin = pickle.loads(theirs.column("tree")[0].as_py())
                row, leaf = fall(roots, margin, unit(matrix(mine.column("v"))))
                first, old = mine.column("first").to_numpy()[row], mine.column("leaf").to_numpy()[row]
                new = leaf
            return pa.table([pa.array(first, pa.int64()), pa.array(old, pa.int64()), pa.array(new, pa.int64())], names=["first", "leaf", "part"])

        key = ["leaf", "block"]
        sunk = moving.groupBy(key).cogroup(split.groupBy(key)).applyInArrow(sink, "first bigint, leaf bigint, part bigint")
        # a leaf's number tells its order among a row's leaves and nothing else
        moved = sunk.groupBy("first").agg(F.collect_set("leaf").alias("old"), F.collect_set(F.xxhash64(F.lit(depth), "leaf", "part")).alias("new"))
        joined = dropped.join(moved, "first", "left")
        leaves = F.when(F.col("old").isNull(), F.col("leaves")).otherwise(F.array_sort(F.concat(F.array_except("leaves", "old"), F.col("new"))))
        after = store(joined.select("first", "v", "weight", leaves.alias("leaves")), "leaves")
        forget(dropped, crowded, trees)
        dropped = after
    return dropped


def compared(dropped: DataFrame, threshold: float) -> DataFrame:
    """(first, links, root), stored: for each class and block, the links counted there and the smallest id reached."""
    placed = dropped.select("*", F.explode("leaves").alias("leaf"))
    sizes = dropped.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")).where("n > 1")
    block = F.pmod(F.xxhash64("first", "leaf"), F.col("n")).cast("int")
    dealt = placed.join(sizes, "leaf", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("first", "v", "weight", "leaves", "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))

    def compare(t: pa.Table) -> pa.Table:
        ids = t.column("first").to_numpy()
        r = count = label = np.zeros(0, np.int64)
        if len(ids) > 1:
            lists = t.column("leaves").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            owner = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
            r, count, label = links_in_block(ids, unit(matrix(t.column("v"))), t.column("weight").to_numpy(), t.column("side").to_numpy(), owner, lists.flatten().to_numpy(), t.column("leaf")[0].as_py(), threshold)
        return pa.table([pa.array(ids[r], pa.int64()), pa.array(count, pa.int64()), pa.array(label, pa.int64())], names=["first", "links", "root"])

    return store(dealt.groupBy("leaf", "i", "j").applyInArrow(compare, "first bigint, links bigint, root bigint"), "links")


def near_duplicate_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: id, ``n_links``, ``component_id`` and ``kept``."""
    rows = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))
    takes = usable("v") & F.col("id").isNotNull()
    # a class is named by its number, since rows that share an id may differ
    classes = rows.where(takes).groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    classes = store(classes.select(F.monotonically_increasing_id().alias("first"), "*"), "classes")
    found = []
    for d in lengths(classes, "v"):
        part = store(classes.where(F.size("v") == d), "part")
        dropped = grow(first_leaves(part, part.count(), threshold), threshold)
        found.append(compared(dropped, threshold))
        forget(part, dropped)
    if not found:
        return rows.select(F.col("id").alias(id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")).withColumn("kept", F.lit(True))
    links = reduce(DataFrame.unionByName, found)
    counts = links.groupBy("first").agg(F.sum("links").alias("links"))
    joined = components(links.select("first", "root").distinct(), "first", "root")
    named = classes.join(joined.withColumnRenamed("node", "first"), "first", "left").withColumn("component", F.coalesce("component", "first"))
    least = named.groupBy("component").agg(F.min("least").alias("smallest"))
    named = named.join(least, "component").join(counts, "first", "left")
    named = named.select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "smallest")
    out = rows.withColumn("key", F.when(takes, F.col("v"))).join(named.withColumnRenamed("v", "key"), "key", "left")
    out = out.select(F.col("id").alias(id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("smallest", "id").alias("component_id"))
    return out.withColumn("kept", F.col(f"`{id}`").eqNullSafe(F.col("component_id")))


def op5_rpforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all vectors at a cosine of 0.95."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
