"""Scoring by a Brown class-based bigram model with exchange clustering.

P(text) is the product over its tokens (words, then one end) of P(class | class before) P(word | class). Every word
of the training texts has one of ``k`` classes, where ``k`` is the cube root of their number, ``CLASSES`` at least
and ``MOST_CLASSES`` at most. The ``COMMON`` most frequent words (ties by hash) are *common*: exchange clustering deals
them to the classes. All others are then placed, each in the class that makes its contexts in the training texts most
likely. Unseen words are in one class of their own; the end is another, and the context before the first word.

Exchange: common words start in classes by turns of falling count. A pass over the training texts counts how often
each common word follows and precedes each class; then each in turn moves to the class that raises the likelihood of
the class bigrams most, against counts that follow every move. All words of a pass move
by contexts counted before it, so a pass may also lower the likelihood: passes go on until two have not raised the best
log-likelihood by ``STILL`` nats a token, or for ``ROUNDS`` passes, and the best classes are taken. Placing (``place``) compares the classes by transitions in
which all words not common are one class, so it is one job whatever the number of words; a last count takes transitions
between the final classes.

Texts are split twice: once to count words, once to be written as codes, which all later passes read: the numbers of
the ``HELD`` most frequent words, and the hashes of the others in order. The counts and classes of words are exact over
the whole corpus and live in a distributed table; a worker knows the held words, and counts ``COMMON * 2 * (k + 2)``
contexts; the driver gets as many. All other words of the texts meet their classes in a join.

Smoothing: transitions add ``ADD_CLASS``; words have their share of their class, and one unseen word has all of the
class of unseen ones, so probabilities sum to 1.

Defined results: a null text is empty, one end token; a null id counts as an empty one and so is held out; rows that
repeat are scored, and learnt from, each; with an empty table the result is empty; of equally good classes a word takes
the first; further columns are not looked at, whatever their names. Texts are taken whole, at any length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm.common import bounded_batches, forget, store, table
from loamgraph.llm.minhash import Shingler, slices

COMMON = 20_000
HELD = 200_000
CLASSES = 32
MOST_CLASSES = 250  # so that a class, the two special ones and OPEN fit a byte
OPEN = 255  # in a row of classes, a word whose class comes from the join
ROUNDS = 6
STILL = 0.03
ADD = 0.1
ADD_CLASS = 0.5
FOLDS = 10
FLUSH = 3_000_000  # words counted in memory before they are sent on
END, RARE = -2, -1  # codes of tokens that are no held words


def held_out(ids: pa.Array) -> np.ndarray:
    """Whether each id falls in the fold that is not learnt from."""
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % FOLDS == 0 for i in ids.to_pylist()], bool)


def word_counts(df: DataFrame, text: str, id: str) -> DataFrame:
    """(h, c): the hash and count of each distinct word of the training texts, and ``h`` null for their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(1)
        parts: list[np.ndarray] = []
        held = texts_seen = 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_counts=True)
            h = pa.array([*h.view(np.int64), None], pa.int64()) if not len(h) else pa.concat_arrays([pa.array(h.view(np.int64)), pa.nulls(1, pa.int64())])
            return pa.RecordBatch.from_arrays([h, pa.array(np.append(c, texts_seen).astype(np.int64))], names=["h", "c"])

        for b in batches:
            out = held_out(b.column(0))
            for first, texts in slices(b.column(1)):
                learn = ~out[first : first + len(texts)]
                texts_seen += int(learn.sum())
                words, owner = shingler.words_of(texts)
                parts.append(words[learn[owner]])
                held += len(parts[-1])
                if held > FLUSH:
                    yield flush()
                    parts, held, texts_seen = [], 0, 0
        yield flush()

    return df.select(f"`{id}`", f"`{text}`").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Held words (sorted hashes, counts, classes), class sizes and log10 transitions.

    Class ``k`` holds unseen words, and until they are placed the words not common; ``k + 1`` is the end.
    """

    held: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    number: np.ndarray  # among the common words, or -1
    tokens: int  # N
    distinct: int  # V
    texts: int
    k: int
    pairs: np.ndarray | None = None  # counts of class pairs in which words not common are class ``k``, smoothed
    sizes: np.ndarray | None = None  # training tokens of each of the ``k`` classes
    transitions: np.ndarray | None = None
    rounds: int = 0

    def find(self, words: np.ndarray) -> np.ndarray:
        """The number of each held word, or ``RARE``."""
        if not len(self.held):
            return np.full(len(words), RARE)
        at = np.minimum(np.searchsorted(self.held, words), len(self.held) - 1)
        return np.where(self.held[at] == words, at, RARE)

    def class_of(self, codes: np.ndarray) -> np.ndarray:
        """The class of each code; words not held are class ``k``."""
        return by_code(self.classes, self.k + 1, self.k)[codes]

    @property
    def common(self) -> np.ndarray:
        """The places of the common words among the held ones, by their number."""
        there = np.flatnonzero(self.number >= 0)
        return there[np.argsort(self.number[there])]


def by_code(held: np.ndarray, end: float, rare: float) -> np.ndarray:
    """A table to look codes up in, of which those below 0 count from its end."""
    return np.concatenate([held, [end, rare]]).astype(held.dtype)


def word_model(counts: DataFrame) -> Model:
    """The model of such a table of word counts before clustering; the driver gets ``HELD`` rows."""
    total = counts.agg(F.sum(F.when(F.col("h").isNull(), F.col("c"))), F.sum(F.when(F.col("h").isNotNull(), F.col("c"))), F.count("h")).first()
    texts, words, distinct = (int(x or 0) for x in total)
    best = counts.where("h is not null").orderBy(F.desc("c"), "h").limit(HELD).toArrow()
    h, c = best.column(0).to_numpy().view(np.uint64), best.column(1).to_numpy()
    rank = np.lexsort((h.view(np.int64), -c))
    h, c = h[rank], c[rank]
    k = min(MOST_CLASSES, max(CLASSES, round(distinct ** (1 / 3))))
    number = np.where(np.arange(len(h)) < COMMON, np.arange(len(h)), -1)
    classes = np.where(number >= 0, number % k, k)
    order = np.argsort(h)
    return Model(h[order], c[order], classes[order], number[order], words + texts, distinct + bool(texts), texts, k)


def coded(df: DataFrame, model: Model, text: str, id: str) -> DataFrame:
    """The stored table (row, id, held_out, codes, rare) of ``df``: a 32-bit code for each token, and the hashes of the
    words not common, both in order."""
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(1)
        for b in batches:
            out = held_out(b.column(0))
            for first, texts in slices(b.column(1)):
                n = len(texts)
                words, owner = shingler.words_of(texts)
                found = model.find(words)
                ends = np.searchsorted(owner, np.arange(n), "right")
                codes = np.insert(found, ends, END).astype("<i4")
                lengths = np.diff(np.concatenate([[0], ends])) + 1
                rare = found == RARE
                cuts = np.searchsorted(owner[rare], np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(words[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.array(out[first : first + n]), binaries(codes.view(np.uint8), lengths * 4), lists], names=["id", "held_out", "codes", "rare"])

    rows = df.select(f"`{id}`", f"`{text}`").mapInArrow(run, f"id {kind}, held_out boolean, codes binary, rare array<bigint>")
    return store(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "codes")


def codes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a column of them, and the number of each row's."""
    data, lengths = flat_bytes(column)
    return np.frombuffer(data.tobytes(), "<i4"), lengths // 4


def class_pairs(codes: DataFrame, model: Model) -> np.ndarray:
    """Counts of (class before, class) over the training rows of ``coded``."""
    k = model.k + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(k * k, np.int64)
        for b in batches:
            classes = model.class_of(codes_of(b.column(0))[0])
            if len(classes):
                counts += np.bincount(np.concatenate([[k - 1], classes[:-1]]) * k + classes, minlength=k * k)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["pair", "c"])

    total = codes.where("not held_out").select("codes").mapInArrow(run, "pair bigint, c bigint").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    result = np.zeros(k * k)
    result[total.column(0).to_numpy()] = total.column(1).to_numpy()
    return result.reshape(k, k)


def contexts_of(codes: DataFrame, model: Model) -> np.ndarray:
    """Counts of (common word, class before | class after) over the training rows of ``coded``.

    A task's counts travel as packed numbers, a row a word.
    """
    k = model.k + 2
    height, width = min(COMMON, len(model.held)), 2 * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(height * width, np.uint32)  # of one task
        number = by_code(model.number, -1, -1)
        for b in batches:
            found, _ = codes_of(b.column(0))
            if not len(found):
                continue
            classes = model.class_of(found)
            before = np.concatenate([[k - 1], classes[:-1]])  # a text follows the end of another
            word = number[found]
            there = np.flatnonzero(word >= 0)
            word = word[there] * width
            np.add.at(counts, word + before[there], 1)
            np.add.at(counts, word + k + classes[there + 1], 1)
        at = np.flatnonzero(counts)
        words, first = np.unique(at // width, return_index=True)
        lengths = np.diff(np.append(first, len(at)))
        place, count = binaries((at % width).astype("<u2").view(np.uint8), lengths * 2), binaries(counts[at].astype("<u4").view(np.uint8), lengths * 4)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), place, count], names=["word", "place", "count"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(height * width, np.int64)
        for b in batches:
            place, lengths = flat_bytes(b.column(1))
            count, _ = flat_bytes(b.column(2))
            at = np.repeat(b.column(0).to_numpy() * width, lengths // 2) + np.frombuffer(place.tobytes(), "<u2")
            np.add.at(counts, at, np.frombuffer(count.tobytes(), "<u4"))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], names=["cell", "c"])

    sent = codes.where("not held_out").select("codes").mapInArrow(run, "word bigint, place binary, count binary")
    total = sent.repartition("word").mapInArrow(add, "cell bigint, c bigint").toArrow()
    result = np.zeros(height * width)
    result[total.column(0).to_numpy()] = total.column(1).to_numpy()
    return result.reshape(height, width)


def exchange(classes: np.ndarray, counts: np.ndarray, contexts: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """Classes after every word, in order of falling count, has moved to its best class.

    ``contexts`` has each word's counts by class before and class after; ``bigrams`` the counts of class pairs.
    """
    k, plain = len(bigrams), len(bigrams) - 2
    n, classes = bigrams.copy(), classes.copy()
    g = lambda x: x * np.log(np.maximum(x, 1))
    for w in np.argsort(-counts, kind="stable"):
        before, after = contexts[w, :k], contexts[w, k:]
        a, f = classes[w], counts[w]
        n[a] -= after
        n[:, a] -= before
        np.maximum(n, 0, out=n)
        out, into = n.sum(axis=1)[:plain], n.sum(axis=0)[:plain]
        i, j = np.flatnonzero(before), np.flatnonzero(after)  # nothing changes elsewhere
        rows, columns = n[:plain, j], n[i, :plain]
        gain = (g(rows + after[j]) - g(rows)).sum(axis=1) + (g(columns + before[i, None]) - g(columns)).sum(axis=0)
        gain -= g(out + f) - g(out) + g(into + f) - g(into)
        best = int(gain.argmax())
        if gain[best] <= gain[a]:
            best = a
        classes[w] = best
        n[best] += after
        n[:, best] += before
    return classes


def likelihood(bigrams: np.ndarray) -> float:
    """The log-likelihood of class pairs, less what does not depend on the classes."""
    g = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return float(g(bigrams) - g(bigrams.sum(axis=0)) - g(bigrams.sum(axis=1)))


def cluster(codes: DataFrame, model: Model) -> None:
    """Give the common words of ``model`` their classes, and take the transitions between them."""
    k, common = model.k + 2, model.common
    counts = model.counts[common]
    best, kept, stale = -math.inf, model.classes, 0
    for model.rounds in range(ROUNDS + 1):
        contexts, classes = contexts_of(codes, model), model.classes[common]
        bigrams = np.zeros((k, k))
        np.add.at(bigrams, classes, contexts[:, k:])
        for special in (k - 2, k - 1):  # pairs of one common word, counted from its side
            bigrams[special, : model.k] = np.bincount(classes, contexts[:, special], model.k)[: model.k]
        now = likelihood(bigrams)
        stale = 0 if now - best >= STILL * model.tokens else stale + 1
        if now > best:
            best, kept = now, model.classes.copy()
        if stale == 2 or model.rounds == ROUNDS:
            break
        model.classes[common] = exchange(classes, counts, contexts, bigrams)
    model.classes = kept
    model.pairs = class_pairs(codes, model) + ADD_CLASS
    model.sizes = np.bincount(model.classes[common], counts, model.k)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and the length of each value."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[ends[0] : ends[-1]], np.diff(ends)


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The binary column of such bytes and lengths."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def place(codes: DataFrame, model: Model) -> DataFrame:
    """The stored table (h, c, class) of all training words that are not common; ``model`` takes up their numbers, and
    the classes of those it holds.

    Each goes to the class in which its classes before and after are most likely by the model's transitions, whose
    class ``k`` stands for a neighbour that is not common either. On a tie the first class wins. A word's contexts run
    through a task in order, so a word of any frequency needs one row of counts.
    """
    k = model.k + 2

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        kept = 0
        held, number = by_code(model.held.view(np.int64), 0, 0), by_code(model.number, 0, -1)

        def flush() -> pa.RecordBatch:
            h, around = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            h, first = np.unique(h[order], return_index=True)
            lengths = np.diff(np.append(first, len(order))) * 2
            return pa.RecordBatch.from_arrays([pa.array(h), binaries(around[order], lengths)], names=["h", "around"])

        for b in batches:
            found, _ = codes_of(b.column(0))
            if not len(found):
                continue
            classes = model.class_of(found)
            there = np.flatnonzero(number[found] < 0)
            before = np.concatenate([[k - 1], classes[:-1]])[there]
            words = held[found[there]]
            words[found[there] == RARE] = b.column(1).flatten().to_numpy()
            parts.append((words, np.stack([before, classes[there + 1]], axis=1).astype(np.uint8)))
            kept += len(there)
            if kept > FLUSH:
                yield flush()
                parts, kept = [], 0
        if kept:
            yield flush()

    pairs = model.pairs
    after_of = np.log(pairs / pairs.sum(axis=1, keepdims=True))[: model.k]  # (class, class after)
    before_of = np.log(pairs / pairs.sum(axis=0, keepdims=True))[:, : model.k]  # (class before, class)

    def chosen(h: np.ndarray, before: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
        best = (after @ after_of.T + before @ before_of).argmax(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(before.sum(axis=1)), pa.array(best)], names=["h", "c", "class"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.zeros((2, 1, k), np.int64)  # the word whose rows may go on
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                h, which = np.unique(b.column(0).to_numpy(), return_inverse=True)  # rows come in order
                data, lengths = flat_bytes(b.column(1))
                word = np.repeat(which, lengths // 2)
                around = data.reshape(-1, 2)
                n = len(h)
                counts = np.stack([np.bincount(word * k + around[:, i], minlength=n * k).reshape(n, k) for i in (0, 1)])
                if last is not None and h[0] == last:
                    counts[:, :1] += kept
                elif last is not None:
                    yield chosen(np.array([last]), *kept)
                if n > 1:
                    yield chosen(h[:-1], *counts[:, :-1])
                last, kept = int(h[-1]), counts[:, -1:]
        if last is not None:
            yield chosen(np.array([last]), *kept)

    around = codes.where("not held_out").select("codes", "rare").mapInArrow(seen, "h bigint, around binary")
    ordered = around.repartition("h").sortWithinPartitions("h")
    placed = store(ordered.mapInArrow(choose, "h bigint, c bigint, class bigint"), "placed")
    for number, tokens in placed.groupBy("class").agg(F.sum("c")).collect():  # at most one row a class
        model.sizes[number] += tokens
    mine = codes.sparkSession.createDataFrame(pa.table({"h": model.held[model.number < 0].view(np.int64)}))
    known = placed.join(F.broadcast(mine), "h").select("h", "class").toArrow()  # HELD rows at most
    model.classes[model.find(known.column(0).to_numpy().view(np.uint64))] = known.column(1).to_numpy()
    return placed


def resolve(codes: DataFrame, model: Model, placed: DataFrame) -> DataFrame:
    """The stored table of the rows of ``coded``: id, ``held_out``, ``n``, ``known``, ``own`` and ``base`` (sums of the
    logs of words' counts, plain and smoothed) and ``classes``, a byte for each token in order."""
    smooth = F.log10(F.coalesce("c", F.lit(0)) + ADD)
    words = codes.select("row", F.posexplode("rare").alias("at", "h")).join(placed, "h", "left")
    words = words.select("row", F.col("c").isNotNull().cast("int").alias("there"), smooth.alias("smooth"), F.coalesce(F.log10("c"), F.lit(0.0)).alias("log"), (F.col("at").cast("long") * 256 + F.coalesce("class", F.lit(model.k))).alias("code"))
    met = words.groupBy("row").agg(F.sum("smooth").alias("logs"), F.sum("log").alias("owns"), F.sum("there").alias("seen"), F.collect_list("code").alias("rest"))
    whole = codes.select("row", "id", "held_out", "codes").join(met, "row", "left")
    whole = whole.select("id", "held_out", "codes", *[F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (("logs", "double"), ("owns", "double"), ("seen", "long"))], F.coalesce("rest", F.array().cast("array<bigint>")).alias("rest"))
    own_of = by_code(np.log10(np.maximum(model.counts, 1)), 0, 0)
    base_of = by_code(np.log10(model.counts + ADD), math.log10(model.texts + ADD), 0)
    known_of = by_code(np.ones(len(model.held)), model.texts > 0, 0)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            found, lengths = codes_of(b.column(2))
            text_of = np.repeat(np.arange(n), lengths)
            known, own, base = (np.bincount(text_of, x[found], n) + b.column(c).to_numpy() for x, c in ((known_of, 5), (own_of, 4), (base_of, 3)))
            rest = b.column(6).flatten().to_numpy()
            order = np.lexsort((rest, np.repeat(np.arange(n), b.column(6).value_lengths().to_numpy())))
            classes = model.class_of(found)
            classes[found == RARE] = rest[order] & 255
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lengths), pa.array(known.astype(np.int64)), pa.array(own), pa.array(base), binaries(classes.astype(np.uint8), lengths)], names=["id", "held_out", "n", "known", "own", "base", "classes"])

    kind = codes.schema["id"].dataType.simpleString()
    return store(whole.mapInArrow(fill, f"id {kind}, held_out boolean, n bigint, known bigint, own double, base double, classes binary"), "tokens")


def transitions(tokens: DataFrame, model: Model) -> np.ndarray:
    """Log10 of the smoothed shares of class pairs over the training rows of ``resolve``."""
    k = model.k + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(k * k, np.int64)
        for b in batches:
            classes = flat_bytes(b.column(0))[0].astype(np.int64)
            if len(classes):
                counts += np.bincount(np.concatenate([[k - 1], classes[:-1]]) * k + classes, minlength=k * k)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["pair", "c"])

    total = tokens.where("not held_out").select("classes").mapInArrow(run, "pair bigint, c bigint").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    pairs = np.full(k * k, ADD_CLASS)
    pairs[total.column(0).to_numpy()] += total.column(1).to_numpy()
    pairs = pairs.reshape(k, k)
    return np.log10(pairs / pairs.sum(axis=1, keepdims=True))


def finish(tokens: DataFrame, model: Model, id: str) -> DataFrame:
    """The scores of the rows of ``resolve``."""
    k, steps = model.k + 2, model.transitions
    size_of = np.append(np.log10(np.maximum(model.sizes, 1)), [0.0, 0.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            classes, lengths = flat_bytes(b.column(6))
            before = np.concatenate([[k - 1], classes[:-1]])[: len(classes)].astype(np.int64)
            text_of = np.repeat(np.arange(b.num_rows), lengths)
            share = np.bincount(text_of, steps[before, classes] - size_of[classes], b.num_rows) + b.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:4], b.column(5), pa.array(share)], names=["id", "held_out", "n", "known", "base", "share"])

    kind = tokens.schema["id"].dataType.simpleString()
    whole = tokens.mapInArrow(run, f"id {kind}, held_out boolean, n bigint, known bigint, base double, share double")
    denominator = math.log10(model.tokens + ADD * (model.distinct + 1))
    return whole.select(
        F.col("id").alias(id),
        "held_out",
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n") * denominator).alias("base_score"),
        F.col("share").alias("score"),
    )


def class_scores(df: DataFrame, text: str = "text", id: str = "doc_id") -> tuple[DataFrame, Model, DataFrame]:
    """One row per row of ``df``: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score`` (log10), with the model and the table of placed words."""
    counts = store(word_counts(df, text, id), "words")
    model = word_model(counts)
    codes = coded(df, model, text, id)
    forget(counts)
    cluster(codes, model)
    placed = place(codes, model)
    tokens = resolve(codes, model, placed)
    forget(codes)
    model.transitions = transitions(tokens, model)
    return finish(tokens, model, id), model, placed


def op8_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and class-model scores of all whole documents."""
    bounded_batches(spark)
    return class_scores(table(spark, sf_dir, "documents"))[0]
