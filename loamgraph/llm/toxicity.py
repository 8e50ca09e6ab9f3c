"""Toxicity by a classifier chain.

Categories are predicted in turn by logistic models over the presence of words and word beginnings (3 to 8 bytes).
Each later model also sees the probabilities of all earlier categories; it is trained with out-of-fold ones, so what
it learns to expect of them is what it meets on new texts. A model that predicts a fold has seen nothing of it: its
features too are chosen from the other folds alone.

Training uses a bounded sample of labelled rows (``SAMPLE``, the first by a hash of the id) and, for each model, at most
``FEATURES`` features, those whose odds of the last category differ most surely from the rest's (by ``LEAST_SURPRISE``
standard errors at least, in ``LEAST_TEXTS`` texts); what tells of a category by language alone, as the language's common
words do, is left out so. Every document is scored, over its whole text.

Defined results: a null or empty text has no features and gets the models' base rates; rows whose labels are null are
not learnt from; of labels that repeat an id the largest counts, and of documents that do one is learnt from; without a
labelled row of both kinds a category has the probability of its base rate (0 without rows); an empty table gives an
empty table; rows that repeat are scored one by one and a null id is kept; of equally sure features the smaller hash is
taken; texts are taken whole, at any length; further columns travel along or are not looked at, whatever their names.

Texts are looked at in runs of about ``RUN_BYTES``, a longer text in parts that end where words do, so a task's Python
holds a few tens of MB besides the distinct features of one text and the longest word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm.common import bounded_batches, forget, store, table
from loamgraph.llm.minhash import Shingler, slices

SAMPLE = 10_000
FEATURES = 4096
BEGINNINGS = (3, 4, 5, 6, 7, 8)
LEAST_TEXTS = 5  # labelled texts that hold a feature
LEAST_SURPRISE = 3.0  # standard errors of a feature's log odds
FOLDS = 3
STEPS = 150
THRESHOLD = 0.25
RUN_BYTES = 1 << 18
EDGE = re.compile(rb"[\t-\r ]")

#: Categories in the order of the chain, as SQL over a labelled document: by language, then at all.
CATEGORIES = {
    "toxic_de": "toxic = 1 and lang = 'de'",
    "toxic_en": "toxic = 1 and lang = 'en'",
    "toxic_es": "toxic = 1 and lang = 'es'",
    "toxic_fr": "toxic = 1 and lang = 'fr'",
    "toxic": "toxic = 1",
}


def features_of(shingler: Shingler, texts: list[bytes], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the distinct features of each text, in order: hashes, or places in ``chosen`` (sorted).

    ``texts``: a run of ``slices``.
    """
    if len(texts) == 1 and len(texts[0]) > RUN_BYTES:
        f = union(features_of_run(shingler, [part], chosen)[1] for part in parts_of(texts[0]))
        return np.zeros(len(f), np.int64), f
    return features_of_run(shingler, texts, chosen)


def parts_of(text: bytes) -> Iterator[bytes]:
    """Parts of about ``RUN_BYTES`` that end where a word does."""
    at = 0
    while at < len(text):
        edge = EDGE.search(text, at + RUN_BYTES)
        end = edge.start() if edge else len(text)
        yield text[at:end]
        at = end


def union(parts: Iterator[np.ndarray], least: int = 1 << 18) -> np.ndarray:
    """The distinct values of all parts, sorted; holds no more than a few times as many, or ``least``."""
    held, more, count = np.zeros(0, np.uint64), [], 0
    for part in parts:
        more.append(part)
        count += len(part)
        if count > max(least, len(held)):
            held, more, count = np.unique(np.concatenate([held, *more])), [], 0
    return np.unique(np.concatenate([held, *more]))


def features_of_run(shingler: Shingler, texts: list[bytes], chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    shingler._grow(len(data) + 1)
    edge = np.flatnonzero(np.diff(shingler.space[data], prepend=True))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(shingler.value[data] * shingler.up[: len(data)], out=total[1:])
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    texts_of, found = [], []
    for n in (0, *BEGINNINGS):
        there = np.flatnonzero(ends - starts >= n)
        s = starts[there]
        e = ends[there] if n == 0 else s + n
        h = (total[e] - total[s]) * shingler.down[s] + np.uint64(n)
        who = owner[there]
        if chosen is not None:
            at = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1) if len(chosen) else np.zeros(0, int)
            hit = chosen[at] == h if len(chosen) else np.zeros(0, bool)
            h, who = at[hit].astype(np.uint64), who[hit] if len(chosen) else who[:0]
        texts_of.append(who)
        found.append(h)
    t, f = np.concatenate(texts_of), np.concatenate(found)
    order = np.lexsort((f, t))
    t, f = t[order], f[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (f[1:] != f[:-1])
    return t[new], f[new]


@dataclass
class Chain:
    """The chosen features (sorted hashes) and, per category, weights of features, of earlier categories, and a bias."""

    names: list[str]
    chosen: np.ndarray
    weights: list[np.ndarray]
    links: list[np.ndarray]
    biases: list[float]

    def predict(self, text_of: np.ndarray, feature: np.ndarray, texts: int) -> np.ndarray:
        """Probabilities; shape (texts, categories)."""
        out = np.zeros((texts, len(self.names)))
        for k in range(len(self.names)):
            z = np.bincount(text_of, self.weights[k][feature], texts)[:texts] + out[:, :k] @ self.links[k] + self.biases[k]
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        return out


def logistic(text_of: np.ndarray, feature: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of features and of the dense ``extra`` columns, and the bias; Adam on the whole sample."""
    n, e = extra.shape
    rate = (y.sum() + 0.5) / (n + 1) if y.any() else 1e-9
    theta = np.zeros(width + e + 1)
    theta[-1] = np.log(rate / (1 - rate))
    if not y.any() or y.all():
        return theta[:width], theta[width:-1], theta[-1]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = np.bincount(text_of, theta[feature], n)[:n] + extra @ theta[width:-1] + theta[-1]
        off = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        slope = np.concatenate([np.bincount(feature, off[text_of], width), off @ extra, [off.sum()]])
        slope[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:width], theta[width:-1], theta[-1]


def fit_chain(names: list[str], chosen: np.ndarray, text_of: np.ndarray, feature: np.ndarray, labels: np.ndarray, folds: np.ndarray | None = None, masks: np.ndarray | None = None) -> Chain:
    """Train the chain on a sample: (text, feature) pairs in order and labels of shape (texts, categories).

    ``folds`` has the fold of each text; ``masks`` tells which features the model without each fold may use, and in its
    last row which ones the final models may.
    """
    n, width = len(labels), len(chosen)
    folds = np.arange(n) % FOLDS if folds is None else folds
    masks = np.ones((FOLDS + 1, width), bool) if masks is None else masks
    earlier = np.zeros((n, len(names)))  # out of fold
    chain = Chain(names, chosen, [], [], [])
    for k in range(len(names)):
        y = labels[:, k].astype(float)
        for fold in range(FOLDS):
            inside = folds != fold
            if k == len(names) - 1 or not inside.any():
                continue
            place = np.cumsum(inside) - 1
            mine = inside[text_of] & masks[fold][feature]
            w, c, b = logistic(place[text_of[mine]], feature[mine], earlier[inside, :k], y[inside], width)
            theirs = ~inside[text_of]
            z = np.bincount(text_of[theirs], w[feature[theirs]], n)[:n] + earlier[:, :k] @ c + b
            earlier[~inside, k] = 1 / (1 + np.exp(-np.clip(z[~inside], -50, 50)))
        mine = masks[FOLDS][feature]
        w, c, b = logistic(text_of[mine], feature[mine], earlier[:, :k], y, width)
        chain.weights.append(w)
        chain.links.append(c)
        chain.biases.append(b)
    return chain


#: Texts that hold a feature, and those of them in the last category, by fold.
COUNTED = [f"{c}_{f}" for c in ("n", "hits") for f in range(FOLDS)]


def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, fold, 0 or 1): the hash and the counts of each feature, run by run."""
    shingler = Shingler(1)
    for b in batches:
        fold = b.column(1).to_numpy()
        of = [np.ones(b.num_rows), b.column(2).to_numpy()]
        for first, texts in slices(b.column(0), RUN_BYTES):
            t, f = features_of(shingler, texts)
            u, inverse = np.unique(f, return_inverse=True)
            there = first + t
            sums = [np.bincount(inverse[m], y[there[m]], len(u)).astype(np.int32) for y in of for m in (fold[there] == k for k in range(FOLDS))]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *map(pa.array, sums)], names=["h", *COUNTED])


def choose_features(told: DataFrame, totals: np.ndarray, positives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, sorted, that any model may use, and ``masks`` of ``fit_chain``.

    told: (h, n_<fold>, hits_<fold>), stored; ``totals`` texts and ``positives`` those of the last category, by fold.
    """
    sets = []
    for without in range(FOLDS + 1):
        folds = [f for f in range(FOLDS) if f != without]
        n, hits = (sum((F.col(f"{c}_{f}") for f in folds), F.lit(0)) for c in ("n", "hits"))
        yes = float(positives[folds].sum())
        no = float(totals[folds].sum()) - yes
        odds = F.log((hits + 0.5) / (yes + 1)) - F.log((n - hits + 0.5) / (no + 1))
        surprise = F.abs(odds) / F.sqrt(1 / (hits + 0.5) + 1 / (n - hits + 0.5))
        telling = told.where(n >= LEAST_TEXTS).withColumn("surprise", surprise).where(F.col("surprise") >= LEAST_SURPRISE)
        best = telling.orderBy(F.desc("surprise"), "h").limit(FEATURES).select("h").toArrow()
        sets.append(np.sort(best.column(0).to_numpy().view(np.uint64)))
    chosen = np.unique(np.concatenate(sets))
    return chosen, np.stack([np.isin(chosen, x) for x in sets])


def train(documents: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, text: str = "text", id: str = "doc_id", limit: int = SAMPLE) -> Chain:
    """Train on at most ``limit`` labelled documents (labels: ``id`` and ``toxic``, perhaps more columns)."""
    names = list(categories)
    known = labels.where(F.col("toxic").isNotNull() & F.col(id).isNotNull()).groupBy(id).agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64(id), id).limit(limit)
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    first = documents.select(id, F.col(text).alias("_text"), lang.alias("lang")).join(F.broadcast(known), id)  # ``limit`` rows at most
    first = first.dropDuplicates([id])  # of ``limit`` ids at most
    label_of = [F.coalesce(F.expr(e), F.lit(False)).cast("int").alias(f"_c{i}") for i, e in enumerate(categories.values())]
    sample = store(first.select("_text", F.pmod(F.xxhash64(F.lit(7), id), F.lit(FOLDS)).cast("int").alias("_fold"), *label_of), "labelled")
    last = f"_c{len(names) - 1}"
    sums = np.zeros((2, FOLDS))
    for row in sample.groupBy("_fold").agg(F.count("*"), F.sum(last)).collect():  # at most one row a fold
        sums[:, row[0]] = row[1:]
    told = sample.select("_text", "_fold", last).mapInArrow(tell, "h bigint, " + ", ".join(f"{c} int" for c in COUNTED)).groupBy("h").agg(*[F.sum(c).alias(c) for c in COUNTED])
    told = store(told.where(sum((F.col(f"n_{f}") for f in range(FOLDS)), F.lit(0)) >= LEAST_TEXTS), "told")
    chosen, masks = choose_features(told, sums[0], sums[1])
    forget(told)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(1)
        for b in batches:
            for first, texts in slices(b.column(0), RUN_BYTES):
                t, f = features_of(shingler, texts, chosen)
                cuts = np.searchsorted(t, np.arange(1, len(texts)))
                yield pa.RecordBatch.from_arrays([pa.array(np.split(f.astype(np.int64), cuts), pa.list_(pa.int64())), *[c.slice(first, len(texts)) for c in b.columns[1:]]], names=["at", *b.schema.names[1:]])

    rows = sample.mapInArrow(place, ", ".join(["at array<bigint>", "_fold int", *[f"_c{i} int" for i in range(len(names))]])).toArrow()
    at = rows.column(0).combine_chunks()
    at = at.chunk(0) if isinstance(at, pa.ChunkedArray) else at
    sizes = np.diff(at.offsets.to_numpy()) if len(at) else np.zeros(0, int)
    y = np.stack([rows.column(i + 2).to_numpy() for i in range(len(names))], axis=1) if len(at) else np.zeros((0, len(names)))
    forget(sample)
    return fit_chain(names, chosen, np.repeat(np.arange(len(at)), sizes), at.flatten().to_numpy().astype(np.int64), y, rows.column(1).to_numpy(), masks)


def predict(df: DataFrame, chain: Chain, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: the id and ``p_<category>`` for each category of the chain."""
    kind = df.schema[id].dataType.simpleString()
    names = [f"p_{n}" for n in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(1)
        for b in batches:
            for first, texts in slices(b.column(1), RUN_BYTES):
                t, f = features_of(shingler, texts, chain.chosen)
                p = chain.predict(t, f.astype(np.int64), len(texts))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), *[pa.array(p[:, k]) for k in range(p.shape[1])]], names=[id, *names])

    return df.select(id, text).mapInArrow(run, ", ".join([f"`{id}` {kind}", *[f"`{n}` double" for n in names]]))


def drop_toxic(df: DataFrame, chain: Chain, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` without the rows whose last category reaches ``threshold``; the rest are as they were."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(1)
        for b in batches:
            for first, texts in slices(b.column(at), RUN_BYTES):
                t, f = features_of(shingler, texts, chain.chosen)
                kept = chain.predict(t, f.astype(np.int64), len(texts))[:, -1] < threshold
                yield b.slice(first, len(texts)).filter(pa.array(kept))

    return df.mapInArrow(run, df.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of all documents and whether they are toxic."""
    bounded_batches(spark)
    documents = table(spark, sf_dir, "documents")
    scored = predict(documents, train(documents, table(spark, sf_dir, "labels")))
    return scored.withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
