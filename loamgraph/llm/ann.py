"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by pseudo-random rotations (three rounds of random signs and a fast Hadamard transform,
after zero padding to a power of two) and assigned to the nearest signed axis, of one rotation or of two, which makes
smaller cells. Each of ``TABLES`` tables has its own rotations. A query visits, in every table, the ``probes`` cells
whose axes lie nearest to it, and all candidates are reranked by exact cosine in double precision.

How many axes, tables and probes are used is measured. The true nearest rows of ``SAMPLE_QUERIES`` queries are found by
one exact scan of the whole table; of all settings whose cells hold ``TARGET`` of these, the cheapest is taken: rows
compared, by the shares of a bounded sample (``SAMPLE`` rows) in the visited cells, and copies of a query, each as dear
as ``COPY`` rows. Where no setting is cheaper, a single table is used and all its cells are visited, which is exact. So
recall is measured against brute force on the table in hand, and the target holds at every size.

A crowded cell is cut into blocks of ``BLOCK`` rows and its queries into blocks of ``QUERY_BLOCK``; a task holds
one block of each, whatever the size of the cell.

Defined results: vectors that are null, zero or hold a null or non-finite component take no part; the others are
compared with those of their own length; repeated ids are rows like any other but each neighbour id is returned once
per query, with its best score; ties go to the smaller id; rows with a null id take no part; a table of one vector has
no neighbours; an empty table gives an empty result; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgraph.llm.common import forget, store, table
from loamgraph.llm.vectors import bounded_sample, cosines, lengths, matrix, unit, usable

TABLES = 8
SAMPLE = 4096
SAMPLE_QUERIES = 200
TARGET = 0.98
PROBES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
AXES = (1, 2)
COPY = 150  # rows that can be compared in the time that a copy of a query takes, about
BLOCK = 1024
QUERY_BLOCK = 256
BROADCAST_CELLS = 262_144  # cells of all tables, 24 bytes each; more are joined by a shuffle


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """``tables`` hashes, each of ``axes`` rotations, of vectors of ``dimension`` components."""

    def __init__(self, dimension: int, tables: int = TABLES, axes: int = 1, seed: int = 17):
        self.width = 1 << max(1, (dimension - 1).bit_length())
        self.tables, self.axes = tables, axes
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, axes, 3, self.width))
        self.cells = (2 * self.width) ** axes

    def rotated(self, x: np.ndarray, table: int, axis: int) -> np.ndarray:
        """Agreement of each row with each signed axis; shape (rows, 2 * width)."""
        y = np.zeros((len(x), self.width))
        y[:, : x.shape[1]] = x
        for signs in self.signs[table, axis]:
            y = hadamard(y * signs)
        return np.concatenate([y, -y], axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row in each table, numbered across tables."""
        out = np.empty((len(x), self.tables), np.int64)
        for t in range(self.tables):
            code = np.zeros(len(x), np.int64)
            for k in range(self.axes):
                code = code * 2 * self.width + self.rotated(x, t, k).argmax(axis=1)
            out[:, t] = code + t * self.cells
        return out

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest cells of each row in each table, nearest first; shape (rows, tables, count)."""
        count = min(count, self.cells)
        out = np.empty((len(x), self.tables, count), np.int64)
        rows = np.arange(len(x))[:, None]
        for t in range(self.tables):
            cost = np.zeros((len(x), 1))
            code = np.zeros((len(x), 1), np.int64)
            for k in range(self.axes):
                s = self.rotated(x, t, k)
                away = s.max(axis=1, keepdims=True) - s
                best = np.argsort(away, axis=1, kind="stable")[:, :count]
                cost = (cost[:, :, None] + (away[rows, best] ** 2)[:, None, :]).reshape(len(x), -1)
                code = (code[:, :, None] * 2 * self.width + best[:, None, :]).reshape(len(x), -1)
                keep = np.argsort(cost, axis=1, kind="stable")[:, :count]
                cost, code = cost[rows, keep], code[rows, keep]
            out[:, t] = code + t * self.cells
        return out


def true_nearest(rows: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray]:
    """The unit vectors of the ``k`` nearest others of each of some queries, by an exact scan of ``rows`` (id, v).

    A task keeps ``k`` rows a query; they are reduced to ``k`` in all before the driver gets them.
    """
    kind = rows.schema["v"].dataType.simpleString()

    def scan(batches):
        best: dict[int, list] = {}
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                vectors = part.column(1)
                mine = part.column(0).to_numpy()
                sims = x @ unit(matrix(vectors)).T
                sims[ids[:, None] == mine[None, :]] = -np.inf
                top = np.argpartition(-sims, min(k, sims.shape[1]) - 1, axis=1)[:, :k]
                for q in range(len(ids)):
                    found = best.get(q, []) + [(-sims[q, j], int(mine[j]), vectors[int(j)]) for j in top[q] if sims[q, j] > -np.inf]
                    best[q] = sorted(found, key=lambda f: f[:2])[:k]
        flat = [(q, -s, i, v) for q, found in best.items() for s, i, v in found]
        if flat:
            q, s, i, v = zip(*flat, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(s, pa.float64()), pa.array(i, pa.int64()), pa.array([y.as_py() for y in v], vectors.type)], names=["q", "s", "id", "v"])

    found = rows.mapInArrow(scan, f"q bigint, s double, id bigint, v {kind}")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))
    got = found.withColumn("r", rank).where(F.col("r") <= k).select("q", "v").toArrow()  # k rows a query
    q, v = got.column(0).to_numpy(), unit(matrix(got.column(1)))
    return [v[q == i] if len(q) else x[:0] for i in range(len(ids))]


def choose_index(x: np.ndarray, rows: int, queries: np.ndarray, near: list[np.ndarray], target: float) -> tuple[CrossPolytope, int]:
    """The cheapest index, and its number of probes, whose visited cells hold ``target`` of the nearest rows ``near``
    of some queries of ``rows`` rows, of which ``x`` is a sample.

    A single table all of whose cells are visited stands where nothing costs less.
    """
    d = x.shape[1]
    whole = CrossPolytope(d, 1, 1)
    best, least = (whole, whole.cells), rows + COPY * whole.cells
    wanted = np.concatenate([*near, np.zeros((0, d))])
    owner = np.repeat(np.arange(len(near)), [len(v) for v in near])
    if not len(wanted):
        return best
    for axes in AXES:
        index = CrossPolytope(d, TABLES, axes)
        most = min(max(PROBES), index.cells)
        held, theirs, probes = index.codes(x), index.codes(wanted), index.probes(queries, most)
        # the place of each neighbour's cell among its query's probes, and the rows that each probe visits
        place = np.full((len(wanted), index.tables), most)
        visited = np.zeros((len(queries), most))
        for t in range(index.tables):
            hit = probes[owner, t] == theirs[:, t, None]
            place[:, t] = np.where(hit.any(axis=1), hit.argmax(axis=1), most)
            cells, counts = np.unique(held[:, t], return_counts=True)
            at = np.minimum(np.searchsorted(cells, probes[:, t]), len(cells) - 1)
            visited += np.where(cells[at] == probes[:, t], counts[at], 0)
        cost = np.cumsum(visited.mean(axis=0)) / len(x)
        for tables in range(1, index.tables + 1):
            first = place[:, :tables].min(axis=1)
            for count in PROBES:
                if count > most:
                    break
                if (first < count).mean() >= target:
                    work = tables * (rows * cost[count - 1] / index.tables + COPY * count)
                    if work < least:
                        best, least = (CrossPolytope(d, tables, axes), count), work
                    break
    return best


def best_in_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
    """The ``k`` best rows of a block for each query: query ids, row ids and exact cosines."""
    sims = q @ x.T
    sims[query_ids[:, None] == ids[None, :]] = -np.inf
    out_q, out_v, out_s = [], [], []
    kth = max(0, len(ids) - k)
    floor = np.partition(sims, kth, axis=1)[:, kth] - 1e-9
    for row, least in enumerate(floor):
        near = np.flatnonzero((sims[row] >= least) & (sims[row] > -np.inf))
        score = cosines(q[row][None, :], x[near])
        best = np.lexsort((ids[near], -score))[:k]
        out_q.append(np.full(len(best), query_ids[row]))
        out_v.append(ids[near][best])
        out_s.append(score[best])
    return out_q, out_v, out_s


def nearest(df: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 5, chosen: tuple[CrossPolytope, int] | None = None) -> DataFrame:
    """(query_id, rank, ``id``, score): the ``k`` nearest rows of ``df`` found for each row of ``queries``, itself aside."""
    take = lambda t: t.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).where(usable("v") & F.col("id").isNotNull())
    rows, asked = store(take(df), "vectors"), take(queries)
    found = None
    for d in lengths(rows, "v"):
        part = _found(rows.where(F.size("v") == d), asked.where(F.size("v") == d), k, chosen)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.sparkSession.createDataFrame([], f"query_id bigint, rank int, `{id}` bigint, score double")
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("int")
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id), "score")


def _found(rows: DataFrame, asked: DataFrame, k: int, chosen: tuple[CrossPolytope, int] | None) -> DataFrame:
    """(query_id, id, score) of the best rows of each pair of blocks; all vectors (id, v) are of one length."""
    asked = store(asked.dropDuplicates(["id", "v"]), "asked")
    if chosen is None:
        sample = bounded_sample(rows, "id", "v", SAMPLE, 23)[1]
        ids, x = bounded_sample(asked, "id", "v", SAMPLE_QUERIES, 37)
        chosen = choose_index(sample, rows.count(), x, true_nearest(rows, ids, x, k) if len(ids) else [], TARGET)
    index, probes = chosen
    kind = rows.schema["v"].dataType.simpleString()

    def cells_of(visit):
        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    cells = visit(unit(matrix(part.column(1))))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(cells.reshape(len(cells), -1)), pa.list_(pa.int64()))], names=["id", "v", "cells"])

        return run

    schema = f"id bigint, v {kind}, cells array<bigint>"
    held = store(rows.mapInArrow(cells_of(index.codes), schema), "cells")
    seeking = store(asked.mapInArrow(cells_of(lambda x: index.probes(x, probes)), schema), "probes")
    forget(asked)
    size = lambda t, block: t.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    blocks = size(held, BLOCK).withColumnRenamed("n", "nv").join(size(seeking, QUERY_BLOCK).withColumnRenamed("n", "nq"), "cell")
    if index.tables * index.cells <= BROADCAST_CELLS:
        blocks = F.broadcast(blocks)

    def dealt(t: DataFrame, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id", "cell"), F.col(own)).alias("mine")
        t = t.select("id", "v", F.explode("cells").alias("cell")).join(blocks, "cell").select("id", "v", "cell", block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("theirs"))
        v, q = ("mine", "theirs") if own == "nv" else ("theirs", "mine")
        return t.select("id", "v", "cell", F.col(v).cast("int").alias("vb"), F.col(q).cast("int").alias("qb"))

    key = ["cell", "vb", "qb"]

    def compare(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        found = ([], [], [])
        if mine.num_rows and theirs.num_rows:
            q, v, s = best_in_block(mine.column("id").to_numpy(), unit(matrix(mine.column("v"))), theirs.column("id").to_numpy(), unit(matrix(theirs.column("v"))), k)
            found = (np.concatenate(q), np.concatenate(v), np.concatenate(s))
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "id", "score"])

    return dealt(held, "nv", "nq").groupBy(key).cogroup(dealt(seeking, "nq", "nv").groupBy(key)).applyInArrow(compare, "query_id bigint, id bigint, score double")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of each vector whose id is divisible by 50, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
