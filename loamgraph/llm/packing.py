"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity.

Documents become pieces of at most ``capacity`` tokens. The packing needs piece lengths alone, of which there
are ``capacity`` many, so it is planned once from the exact count of pieces of each length, however many pieces
there are: a *pattern* is a list of lengths that share a sequence, and the plan says how many sequences have
each pattern. A pattern is made by filling greedily (the longest length left, then the longest that still fits,
and so on); then, if a gap stays, its smallest document is taken out and the two unpacked lengths whose sum
fits the expanded gap most tightly take its place, if that is tighter. A pattern is used for as many sequences
as the counts allow before the next one is made.

Each piece then finds its sequence from its rank among pieces of its length: the number of those in earlier parts of
the table of pieces, and of those before it in its part. So ids are written once and never shuffled, and no length or
document, however common, meets in one task.

Defined results: a null text is an empty document, which is its end token alone; texts are taken whole, at any length;
repeated rows are packed one by one; a null id is kept; of equally good lengths the longer one, and of equally tight
pairs the more uneven one, is taken; an empty table gives an empty result; further columns are not looked at, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgraph.llm.common import bounded_batches, forget, store, table

CAPACITY = 1024
END = 2
BROADCAST_FIRSTS = 1_000_000  # rows of 24 bytes; more are joined by a shuffle
PART, NTH = "_lp_part", "_lp_nth"  # a piece's part of the table, and its place there among pieces of its length
SEND = 1_000_000  # ids gathered before they are sent on


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe_encoder(path: str | None = None, ranks_path: str | None = None, special_as_text: bool = False) -> Callable[[str], np.ndarray]:
    """What gives the ids of a text by the byte-level BPE vocabulary at ``path``, a ``tokenizers`` file.

    No special token is added, but one that a text spells out is one, unless ``special_as_text``. If ``ranks_path`` names
    the same vocabulary as ranks, texts of Latin letters, digits and ASCII marks are encoded with it, which gives the same
    ids several times faster; all others, those that spell a special token, and those with longer runs of white space
    than it can take, go through ``tokenizers``.
    """
    import os
    import re

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(path or tokenizer_path())
    slow.encode_special_tokens = special_as_text
    exact = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    if ranks_path is None:
        return exact

    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [] if special_as_text else [t.content for t in slow.get_added_tokens_decoder().values()]
    other = re.compile("|".join(["[^\x00-\x7f¡-¬®-ɏ]", *map(re.escape, special)]))

    def encode(text: str) -> np.ndarray:
        if other.search(text):
            return exact(text)
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            return exact(text)

    return encode


def tokenize(df: DataFrame, text: str = "text", id: str = "doc_id", capacity: int = CAPACITY, encoder: Callable[[], Callable] | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, ``ids`` (an array of token ids), and what ``pack`` needs.

    ``encoder`` makes a function from a text to its ids, in the worker.
    """
    kind = df.schema[id].dataType.simpleString()
    make = encoder or (lambda: byte_bpe_encoder(ranks_path=tokenizer_path("byte_bpe_50k.tiktoken")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = None, TaskContext.get().partitionId()
        end = np.array([END], np.uint32)
        seen = np.zeros(capacity + 1, np.int64)

        def pieces(b: pa.RecordBatch, rows: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
            n = np.array([len(x) + 1 for x in found])
            cuts = -(-n // capacity)  # pieces of each text; all but the first are full
            row = np.repeat(np.arange(len(n)), cuts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            first = n - (cuts - 1) * capacity
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)  # pieces follow one another
            ids = np.concatenate([x for y in found for x in (y, end)]).astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
            nth = seen[length] + place_among_equals(length)
            seen[:] += np.bincount(length, minlength=capacity + 1)
            columns = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length)), out, pa.array(np.full(len(row), part), pa.int64()), pa.array(nth)]
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.array(rows)[row])), *columns], names=[id, "piece", "start", "length", "ids", PART, NTH])

        for b in batches:
            encode = encode or make()
            rows, found, held = [], [], 0
            for row, t in enumerate(b.column(1)):
                rows.append(row)
                found.append(encode(t.as_py() or ""))
                held += len(found[-1])
                if held > SEND:
                    yield pieces(b, rows, found)
                    rows, found, held = [], [], 0
            if rows:
                yield pieces(b, rows, found)

    return df.select(f"`{id}`", f"`{text}`").mapInArrow(run, f"`{id}` {kind}, piece int, start bigint, length bigint, ids array<int>, {PART} bigint, {NTH} bigint")


def place_among_equals(x: np.ndarray) -> np.ndarray:
    """How many equal values stand before each value."""
    order = np.argsort(x, kind="stable")
    new = np.flatnonzero(np.diff(x[order], prepend=-1))
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x))))
    return out


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, number of such sequences); every piece counted in ``counts`` is in one sequence."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens cannot be packed into {capacity}")
        left[length] += n
    plan = []
    while left.any():
        lengths, gap = [], capacity
        free = left.copy()
        while gap > 0 and (fits := np.flatnonzero(free[: gap + 1])).size:
            lengths.append(int(fits[-1]))
            free[lengths[-1]] -= 1
            gap -= lengths[-1]
        if gap and len(lengths) > 1:
            room = gap + lengths[-1]
            pair = _tightest_pair(free, room)
            if pair and sum(pair) > lengths[-1]:
                free[lengths[-1]] += 1
                lengths[-1:] = pair
        used = np.bincount(lengths, minlength=capacity + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        plan.append((lengths, times))
    return plan


def _tightest_pair(free: np.ndarray, room: int) -> list[int] | None:
    """The two available lengths with the largest sum within ``room``; the more uneven pair wins a tie."""
    there = np.flatnonzero(free[:room])
    best, pair = 0, None
    low, high = 0, len(there) - 1
    while low <= high:
        a, b = int(there[low]), int(there[high])
        if a + b > room or (a == b and free[a] < 2):
            high -= 1
        else:
            if a + b > best:
                best, pair = a + b, [b, a]
            low += 1
    return pair


def plan_slots(plan: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, offset) in rank order: where the pieces of that rank go."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            slots.setdefault(n, []).append((seen.get(n, 0), sequence, offset))
            seen[n] = seen.get(n, 0) + times
            offset += n
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in slots.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (of ``tokenize``, stored) with ``sequence_id`` and ``offset``.

    The driver gets one count for each length, as many rows as a sequence has tokens at most.
    """
    sizes = store(pieces.groupBy("length", PART).count(), "sizes")
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("count")).collect()}
    slots = plan_slots(plan_patterns(counts, capacity))
    before = Window.partitionBy("length").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    firsts = store(sizes.select("length", PART, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_lp_first")), "firsts")
    few = firsts.count() <= BROADCAST_FIRSTS
    forget(sizes)

    @F.arrow_udf("sequence_id bigint, offset bigint")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            table_of = slots[int(length[mine[0]])]
            k = np.searchsorted(table_of[:, 0], rank[mine], "right") - 1
            sequence[mine] = table_of[k, 1] + rank[mine] - table_of[k, 0]
            offset[mine] = table_of[k, 2]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    ranked = pieces.join(F.broadcast(firsts) if few else firsts, ["length", PART])
    placed = ranked.withColumn("_lp_place", place("length", F.col("_lp_first") + F.col(NTH)))
    columns = [f"`{c}`" for c in pieces.columns if c not in (PART, NTH)]
    return placed.select(*columns, "_lp_place.sequence_id", "_lp_place.offset")


def ids_crc32(ids: str) -> Column:
    """The CRC-32 of ids as little-endian unsigned words of 32 bits; null for null."""

    @F.arrow_udf("bigint")
    def crc(x: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
        flat = x.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        sums = [zlib.crc32(flat[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        return pa.array(sums, pa.int64(), mask=x.is_null().to_numpy(zero_copy_only=False))

    return crc(ids)


def pack_documents(df: DataFrame, text: str = "text", id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack all of ``df``; one row per piece, with its ids, their checksum and its place."""
    bounded_batches(df.sparkSession)
    pieces = store(tokenize(df, text, id, capacity), "pieces")
    return pack(pieces, capacity).withColumn("ids_crc32", ids_crc32("ids"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens; one row per piece, with a checksum of its ids."""
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
