"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct word shingles. Documents with equal sets form a class, and one member,
that with the smallest id, stands for it. Of each representative, ``BANDS * ROWS`` minima are taken; bands of
``ROWS`` full minima give candidates; of each minimum only the ``BITS`` lowest bits are kept, packed into longs.
Two signatures agree at an expected rate of C + (1 - C) J with C = 2^-BITS, so J is estimated from the count of
equal lanes, corrected for chance, and pairs whose estimate lies ``SLACK`` below the threshold are let go (five
standard deviations). All others are confirmed on their full sets, as integers.

A pair at the threshold of 0.8 shares no band with a chance of (1 - 0.8^6)^48 < 5e-7.

Buckets are not expanded into pairs. A bucket's pivot is the member that shares the most buckets with others, which
in a group of edited copies is the original. First, each document meets the most central of its pivots; then, in
buckets that still hold several components, members meet the pivot across components; last, what is left of the
buckets is dealt into blocks, two blocks meet in a task, and there every pair across components that shares a band,
and whose sizes and signatures allow it, is confirmed. So no link that joins two components is lost, whatever a
bucket's size, and a group of copies costs rows in proportion to its size.

Rows are told apart by a number of their own, not by their ids, so rows that share an id and differ in text are
documents of their own.

Defined results: null or wordless texts have no shingles and link with nothing; shorter texts than a shingle are
one shingle; rows that repeat an id are documents each, and a component has its smallest id; rows with a null id
link like any other, their component has the smallest id that is not null (null if there is none) and ``kept`` is
false but for a component without ids; an empty table gives an empty table; of equally central pivots the one of the
smaller row number holds, which changes which pairs are tried and no component; further columns are not looked at,
and ``deduplicate`` passes them on, whatever their names. Texts are taken whole, at any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm.common import bounded_batches, forget, row_hash, store, table, unused
from loamgraph.llm.components import components

WORDS = 5
PERCENT = 80
BANDS, ROWS, BITS = 48, 6, 2
SLACK = 0.14
LANES = 64 // BITS
LONGS = BANDS * ROWS // LANES
BROADCAST_IDS = 500_000  # ids of 8 bytes; more are joined by a shuffle
SLICE_BYTES = 1 << 20
BLOCK = 512  # documents of a block, about
BLOCK_SHINGLES = 1_000_000  # and their shingles
COLUMNS = 8192


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of 64-bit shingle hashes of UTF-8 texts, by array operations over many texts at once.

    Words are runs between bytes 9 to 13 and 32; A to Z count as a to z.
    """

    def __init__(self, words: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.words = words
        self.value = rng.integers(0, 2**64, 256, np.uint64)
        self.value[65:91] = self.value[97:123]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.base = np.uint64(int(rng.integers(0, 2**63)) * 2 + 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.step = np.uint64(0x9E3779B97F4A7C15)
        self.up = self.down = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = np.ones(n, np.uint64), np.ones(n, np.uint64)
            self.up[1:], self.down[1:] = self.base, self.inverse
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)

    def words_of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hash and the text's number of every word, in order."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self._grow(len(data) + 1)
        space = self.space[data]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        starts, ends = edge[::2], edge[1::2]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[: len(data)], out=total[1:])
        words = _mix((total[ends] - total[starts]) * self.down[starts])
        lengths = np.array([len(t) + 1 for t in texts])
        return words, np.searchsorted(np.cumsum(lengths), starts, "right")

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        words, owner = self.words_of(texts)
        k = self.words
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        hashes = np.zeros(max(len(words) - k + 1, 0), np.uint64)
        for i in range(k):
            hashes = hashes * self.step + words[i : i + len(hashes)]
        hashes = _mix(hashes)
        out = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= k:
                out.append(np.unique(hashes[lo : hi - k + 1]))
            elif hi > lo:
                short = np.array([hi - lo], np.uint64)
                for w in words[lo:hi]:
                    short = short * self.step + w
                out.append(_mix(short + self.step))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts in UTF-8) of runs of rows of about ``size`` bytes; a longer text stands alone."""
    part: list[bytes] = []
    held = first = 0
    for row, value in enumerate(texts.cast(pa.binary())):
        b = value.as_py() or b""
        if part and held + len(b) > size:
            yield first, part
            part, held, first = [], 0, row
        part.append(b)
        held += len(b)
    if part:
        yield first, part


def minima(sets: list[np.ndarray], seed: int = 3) -> np.ndarray:
    """``BANDS * ROWS`` 32-bit minima of each (not empty) set; shape (minima, sets)."""
    rng = np.random.default_rng(seed)
    k = BANDS * ROWS
    a = (rng.integers(0, 2**31, k, np.uint32) * np.uint32(2)) + np.uint32(1)
    b = rng.integers(0, 2**32, k, np.uint32)
    out = np.empty((k, len(sets)), np.uint32)
    at = 0
    while at < len(sets):  # runs that stay in the processor's cache
        end, held = at + 1, len(sets[at])
        while end < len(sets) and held + len(sets[end]) <= 16_384:
            held += len(sets[end])
            end += 1
        x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        offsets = np.cumsum([0, *[len(s) for s in sets[at : end - 1]]])
        y = np.empty_like(x)
        for i in range(k):
            np.multiply(x, a[i], out=y)
            np.add(y, b[i], out=y)
            out[i, at:end] = np.minimum.reduceat(y, offsets)
        at = end
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    """The 64-bit key of each band of each set; shape (sets, BANDS)."""
    m = mins.reshape(BANDS, ROWS, -1).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = _mix(key ^ m[:, r]) + np.uint64(0x632BE59BD9B4E019)
    return key.T.view(np.int64)


def packed_bits(mins: np.ndarray) -> np.ndarray:
    """The low bits of all minima, ``LANES`` to a long; shape (sets, LONGS)."""
    low = (mins & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(LONGS, LANES, -1)
    shift = (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))[:, None]
    return np.bitwise_or.reduce(low << shift, axis=1).T.view(np.int64)


def equal_lanes(a: str, b: str) -> Column:
    """How many lanes of two packed signatures are equal, by bit counts."""
    lows = sum(1 << (BITS * i) for i in range(LANES))
    lows -= (lows >> 63) << 64
    terms = []
    for i in range(LONGS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        folded = x
        for s in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        terms.append(F.bit_count(folded.bitwiseAND(F.lit(lows))))
    return F.lit(BANDS * ROWS) - sum(terms[1:], terms[0])


def estimate(a: str, b: str) -> Column:
    """Jaccard similarity from packed signatures, corrected for lanes that are equal by chance."""
    chance = 2.0**-BITS
    return (equal_lanes(a, b) / (BANDS * ROWS) - chance) / (1 - chance)


def plausible(percent: int, a: str, b: str) -> Column:
    """Whether sizes and signatures of two sides (columns n and sig) allow a link."""
    sizes = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent
    return sizes & (estimate(f"{a}.sig", f"{b}.sig") >= percent / 100 - SLACK)


def signatures(df: DataFrame, text: str, id: str, words: int) -> DataFrame:
    """(id, row, n, f1, f2, bands, sig) of each row: ``row`` hashes all its columns, ``f1`` and ``f2`` its whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            for first, texts in slices(b.column(2)):
                sets = shingler.sets(texts)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                sig: list = [None] * len(sets)
                f1, f2 = [0] * len(sets), [0] * len(sets)
                if full:
                    mins = minima([sets[i] for i in full])
                    for i, keys, bits in zip(full, band_keys(mins), packed_bits(mins), strict=True):
                        bands[i], sig[i] = keys, bits
                        f1[i] = int(_mix(sets[i]).sum().view(np.int64))
                        f2[i] = int(_mix(sets[i] ^ shingler.step).sum().view(np.int64))
                longs = pa.list_(pa.int64())
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(first, len(sets)) for c in (0, 1)), n, pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, longs), pa.array(sig, longs)], names=["id", "row", "n", "f1", "f2", "bands", "sig"])

    rows = df.select(F.col(f"`{id}`").cast("long").alias("id"), row_hash(df).alias("row"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "id long, row long, n long, f1 long, f2 long, bands array<long>, sig array<long>")


def _hash_sets(df: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            for first, texts in slices(b.column(1)):
                sets = [s.view(np.int64) for s in shingler.sets(texts)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(sets)), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    return df.mapInArrow(run, "node long, hashes array<long>")


@dataclass(frozen=True)
class Corpus:
    """Representatives (node, id, row, n, sig) and the texts (id, row, text) that they are of."""

    thin: DataFrame
    texts: DataFrame
    words: int
    percent: int

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, hashes), stored, of distinct ``nodes`` (node, stored)."""
        named = store(self.thin.join(nodes, "node", "left_semi").select("node", "id", "row"), "nodes")
        named = F.broadcast(named) if named.count() <= BROADCAST_IDS else named
        same = (self.texts.row == named.row) & self.texts.id.eqNullSafe(named.id)
        wanted = self.texts.join(named, same).select("node", "text")
        # rows that repeat in full have one set
        return store(_hash_sets(wanted, self.words).dropDuplicates(["node"]), "sets")


def confirm(pairs: DataFrame, corpus: Corpus) -> DataFrame:
    """Those of ``pairs`` (stored; a: a pivot, b) whose full sets reach the threshold."""
    nodes = store(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    sets = corpus.sets(nodes)
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("ha", "hb"))
    linked = store(both.where(common * 100 >= (F.size("ha") + F.size("hb") - common) * corpus.percent).select("a", "b"), "links")
    forget(nodes, sets)
    return linked


def _classes(df: DataFrame, text: str, id: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All rows (node, id, row, n, f1, f2) and their classes (f1, f2, component, least): ``component`` is a row's
    number, that of the row which stays, and ``least`` the smallest id."""
    signed = signatures(df, text, id, words).withColumn("node", F.monotonically_increasing_id())
    signed = store(signed, "signed")  # a row's number is fixed by being written
    some = signed.where("n > 0")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    firsts = some.groupBy("f1", "f2").agg(F.min(order).alias("r")).select(F.col("r.node").alias("node"))
    classes = store(some.join(firsts, "node", "left_semi"), "classes")
    thin = classes.select("node", "n", "sig")
    texts = df.select(F.col(f"`{id}`").cast("long").alias("id"), row_hash(df).alias("row"), F.col(f"`{text}`").alias("text"))
    corpus = Corpus(classes.select("node", "id", "row", "n", "sig"), texts, words, percent)

    banded = classes.select(F.explode("bands").alias("key"), "node").distinct()
    buckets = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = store(banded.join(buckets, "key"), "members")
    weighed = members.join(members.groupBy("node").agg(F.sum("size").alias("degree")), "node")
    central = weighed.groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("less"))).alias("best"))
    pivots = store(central.select("key", "best", (-F.col("best.less")).alias("pivot")), "pivots")

    # 1: every member meets the most central of its buckets' pivots
    own = members.join(pivots, "key").groupBy("node").agg(F.max_by("pivot", "best").alias("pivot"))
    tried = store(_allowed(own.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")), thin, percent), "pairs")
    joined = store(components(confirm(tried, corpus), "a", "b"), "joined")

    # 2: in buckets of several components, members meet the bucket's pivot if it is in another one
    rest = _mixed(members, joined)
    if not rest.isEmpty():
        met = rest.join(pivots.select("key", "pivot"), "key")
        met = met.join(rest.select("key", F.col("node").alias("pivot"), F.col("label").alias("other")), ["key", "pivot"])
        met = met.where("label <> other").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
        more = store(_allowed(met, thin, percent), "pairs")
        joined = _join_on(joined, confirm(more, corpus))
        forget(more)
        rest = _mixed(members, joined)

    # 3: in what is left, every pair across components that shares a band
    if not rest.isEmpty():
        links = _across_blocks(rest, corpus)
        joined = _join_on(joined, links)
        forget(links)
    forget(members, pivots, tried, rest)

    named = classes.select("f1", "f2", "id", "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("r")
    least = named.groupBy("component").agg(best).select("component", F.col("r.id").alias("least"), F.col("r.node").alias("stays"))
    named = store(named.join(least, "component").select("f1", "f2", F.col("stays").alias("component"), "least"), "named")
    forget(joined)
    return signed.select("node", "id", "row", "n", "f1", "f2"), named


def near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``df``: id, ``n_shingles``, ``component_id`` and ``kept``."""
    signed, named = _classes(df, text, id, words, percent)
    own = signed.select("id", "n", "f1", "f2").join(named, ["f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))
    out = own.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col(f"`{id}`").eqNullSafe(F.col("component_id")))


def deduplicate(df: DataFrame, text: str = "text", id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` that stay: of each component one, that of the smallest id, and every row without shingles.

    Of rows that are equal in every column one stays too. Rows that only share an id are told apart by their contents.
    """
    signed, named = _classes(df, text, id, words, percent)
    rows = signed.join(named.select("f1", "f2", "component"), ["f1", "f2"], "left")
    stays = (F.col("n") == 0) | (F.col("node") == F.col("component"))
    # a row's contents are its key; one of several equal rows is enough to keep the contents
    known = rows.groupBy("row", "id").agg(F.bool_or(stays).alias("stays"), F.count("*").alias("n"))
    marked = store(known.where("not stays or n > 1").select("row", F.coalesce("id", F.lit(-1)).alias("id"), "stays"), "marked")
    few = F.broadcast if marked.count() <= BROADCAST_IDS else lambda t: t
    row, own = unused(df, "_lm_row"), unused(df, "_lm_id")
    tagged = df.withColumns({row: row_hash(df), own: F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(-1))})
    keys = lambda t: few(t.select(F.col("row").alias(row), F.col("id").alias(own)))
    once = tagged.join(keys(marked), [row, own], "left_anti")
    again = tagged.join(keys(marked.where("stays")), [row, own], "left_semi").dropDuplicates([row, own])
    columns = [f"`{c}`" for c in df.columns]
    return once.select(*columns).unionByName(again.select(*columns))


def _across_blocks(rows: DataFrame, corpus: Corpus) -> DataFrame:
    """(a, b), stored: links across components among documents of buckets (key, node, label).

    Documents that buckets connect form a group, which is dealt into blocks of about ``BLOCK`` documents and
    ``BLOCK_SHINGLES`` shingles. Two blocks meet in a task: pairs of other components that share a bucket and whose
    sizes and signatures allow it have their full sets compared. Of a task's links one for each pair of components
    leaves it, so pairs are never rows. A group of several blocks costs a copy of each set for each block.
    """
    firsts = rows.groupBy("key").agg(F.min("node").alias("first"))
    groups = components(rows.select("key", "node").join(firsts, "key").select("node", "first").distinct(), "node", "first")
    keyed = rows.groupBy("node", "label").agg(F.collect_set("key").alias("keys"))  # BANDS at most
    grouped = keyed.join(groups.select("node", F.col("component").alias("group")), "node").join(corpus.thin.select("node", "n", "sig"), "node")
    grouped = store(grouped, "grouped")
    many = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    blocks = grouped.groupBy("group").agg(many.alias("blocks"))
    placed = grouped.join(blocks, "group").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sets = corpus.sets(store(grouped.select("node"), "nodes"))
    dealt = placed.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "label", "keys", "sig", "hashes", (F.col("own") > F.col("other")).alias("side"))
    percent = corpus.percent

    def compare(t: pa.Table) -> pa.Table:
        nodes, label = t.column("node").to_numpy(), t.column("label").to_numpy()
        side = np.array(t.column("side").to_pylist(), bool)
        lists = lambda c: [x.values.to_numpy() for x in t.column(c)]
        a, b = candidates(label, side, lists("keys"), np.stack(lists("sig")).view(np.uint64), np.array([len(x.values) for x in t.column("hashes")]), percent)
        if len(a):
            common = intersections(lists("hashes"), a, b)
            n = np.array([len(x.values) for x in t.column("hashes")])
            linked = 100 * common >= percent * (n[a] + n[b] - common)
            a, b = a[linked], b[linked]
        if len(a):  # one link for each pair of components
            _, first = np.unique(np.stack([np.minimum(label[a], label[b]), np.maximum(label[a], label[b])]), axis=1, return_index=True)
            a, b = a[first], b[first]
        return pa.table([pa.array(nodes[a], pa.int64()), pa.array(nodes[b], pa.int64())], names=["a", "b"])

    links = store(dealt.groupBy("group", "i", "j").applyInArrow(compare, "a long, b long"), "links")
    forget(grouped, sets)
    return links


def candidates(label: np.ndarray, side: np.ndarray, keys: list[np.ndarray], sig: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (a < b) of other labels, across sides if there are two, that share a key and are plausible."""
    rows = len(n)
    _, number, seen = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(rows), [len(k) for k in keys])
    used = seen[number] > 1
    owner, number = owner[used], np.unique(number[used], return_inverse=True)[1]
    meets = np.zeros((rows, rows), np.float32)
    for at in range(0, int(number.max()) + 1 if len(number) else 0, COLUMNS):
        here = (number >= at) & (number < at + COLUMNS)
        there = np.zeros((rows, min(COLUMNS, int(number.max()) + 1 - at)), np.float32)
        there[owner[here], number[here] - at] = 1
        meets += there @ there.T
    ok = (meets > 0) & (label[:, None] != label[None, :])
    if side.any() and not side.all():
        ok &= side[:, None] != side[None, :]
    a, b = np.nonzero(np.triu(ok, 1))
    sizes = np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent
    a, b = a[sizes], b[sizes]
    least = percent / 100 - SLACK
    kept = [np.flatnonzero(lane_estimate(sig[a[at : at + 100_000]], sig[b[at : at + 100_000]]) >= least) + at for at in range(0, len(a), 100_000)]
    kept = np.concatenate([*kept, np.zeros(0, int)]).astype(int)
    return a[kept], b[kept]


def lane_estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``estimate`` of rows of packed signatures."""
    differ = x ^ y
    for s in range(1, BITS):
        differ = differ | ((x ^ y) >> np.uint64(s))
    lows = np.uint64(sum(1 << (BITS * i) for i in range(LANES)))
    equal = BANDS * ROWS - np.bitwise_count(differ & lows).sum(axis=1, dtype=np.int64)
    chance = 2.0**-BITS
    return (equal / (BANDS * ROWS) - chance) / (1 - chance)


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of the sets of each pair of rows."""
    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = np.array([len(sets[i]) for i in used])
    _, number, seen = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), n)
    shared = seen[number] > 1
    row, number = row[shared], number[shared]
    _, number = np.unique(number, return_inverse=True)
    common = np.zeros((len(used), len(used)), np.float32)
    for at in range(0, int(number.max()) + 1 if len(number) else 0, COLUMNS):
        here = (number >= at) & (number < at + COLUMNS)
        there = np.zeros((len(used), min(COLUMNS, int(number.max()) + 1 - at)), np.float32)
        there[row[here], number[here] - at] = 1
        common += there @ there.T
    return common[place[: len(a)], place[len(a) :]].astype(np.int64)


def _mixed(members: DataFrame, joined: DataFrame) -> DataFrame:
    """(key, node, label), stored: the members of buckets that hold several components."""
    label = F.coalesce("component", "node").alias("label")
    labelled = members.select("key", "node").join(joined, "node", "left").select("key", "node", label)
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return store(labelled.join(mixed, "key", "left_semi"), "mixed")


def _join_on(joined: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component), stored, of earlier components and further links."""
    known = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return store(components(links.select("a", "b").unionByName(known), "a", "b"), "joined")


def _allowed(pairs: DataFrame, thin: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that sizes and signatures allow."""
    x = thin.select(F.col("node").alias("a"), F.struct("n", "sig").alias("x"))
    y = thin.select(F.col("node").alias("b"), F.struct("n", "sig").alias("y"))
    return pairs.join(y, "b").join(x, "a").where(plausible(percent, "x", "y")).select("a", "b")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents, on shingles of four words."""
    bounded_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
