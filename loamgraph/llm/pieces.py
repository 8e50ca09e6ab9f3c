"""SentencePiece encoding and decoding.

Encoding finds the segmentation of the highest total score. An Aho-Corasick automaton over all pieces reads the text
once; at each position its output links list every piece that ends there, longest first, and each relaxes the best
score of that position from the best score of the position where the piece begins (a single-pass Viterbi). A
character that is no piece by itself may also be taken alone, at ``UNKNOWN`` below the lowest score, and is then
written as byte pieces. Ties go to the longest last piece.

Spaces become U+2581 and one is put before the text; decoding undoes both. A model whose normalizer does anything else
is refused. Where pieces hold U+2581 only at their start or in runs of it, which is looked up in the vocabulary, the best
segmentation of a text is that of its space-led chunks end to end, and a worker remembers the chunks it has met, up to
``CACHE_BYTES`` of them; else a text is one chunk.

The scores are the model file's. For a vocabulary made by merges they are merge ranks, so ids are those of the best
path over ranks, not of merges in order; they decode to the same text.

Defined results: a null text is empty and has no ids; empty texts decode to empty ones; U+2581 in a text decodes to a
space; bytes that are no UTF-8 decode to U+FFFD; nulls in ids are passed over; rows are encoded one by one, whole, at any
length, repeated ones and null ids like any other; an empty table gives an empty table; columns named ``ids`` or
``decoded`` are replaced and all others travel along.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm.common import bounded_batches, table
from loamgraph.llm.packing import ids_crc32, tokenizer_path

CACHE_BYTES = 24 << 20  # chunks of text and their ids that a worker remembers, about
CACHED_CHUNK = 64  # characters; longer chunks are not remembered
SPACE = "▁"
UNKNOWN = 10.0
NORMAL, UNUSED, BYTE = "normal", "unused", "byte"


def read_model(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) of each id of a SentencePiece model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    for text in ("x", " x ", "a  b", "ﬁ Å①　\t\n"):  # what a normalizer other than the plain one would change
        if m.normalize(text) != SPACE + text.replace(" ", SPACE):
            raise ValueError("the model's normalizer does more than mark spaces")
    kind = lambda i: BYTE if m.is_byte(i) else UNUSED if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else NORMAL
    return [(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())]


class Segmenter:
    """The automaton over a vocabulary and the tables for decoding."""

    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.bytes: list[bytes] = []
        self.of_byte = [0] * 256
        scores = [s for _, s, k in vocabulary if k == NORMAL]
        self.unknown = min(scores, default=0.0) - UNKNOWN
        self.single = set()
        for i, (piece, score, kind) in enumerate(vocabulary):
            if kind == BYTE:
                value = int(piece[1:-1], 16)
                self.of_byte[value] = i
                self.bytes.append(bytes([value]))
            elif kind == NORMAL:
                self.automaton.add_word(piece, (len(piece), score, i))
                self.bytes.append(piece.replace(SPACE, " ").encode())
                if len(piece) == 1:
                    self.single.add(piece)
            else:
                self.bytes.append(b"")
        self.table = np.array(self.bytes, object)
        self.automaton.make_automaton()
        self.by_chunks = not any(k == NORMAL and SPACE in p.lstrip(SPACE) for p, _, k in vocabulary)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def best_path(self, text: str) -> list[int]:
        """Ids of the best segmentation of ``text``, in which spaces are U+2581 already."""
        n = len(text)
        best = [float("-inf")] * n + [0.0]  # by last character; the last place, also place -1, is the text's start
        back: list = [None] * n
        if self.single.issuperset(text):
            for end, piece in self.automaton.iter(text):
                s = best[end - piece[0]] + piece[1]
                if s > best[end]:
                    best[end] = s
                    back[end] = piece
        else:
            alone = [i for i, c in enumerate(text) if c not in self.single]
            done = 0
            for end, piece in self.automaton.iter(text):
                while done < len(alone) and alone[done] < end:
                    self._take(alone[done], best, back)
                    done += 1
                s = best[end - piece[0]] + piece[1]
                if s > best[end]:
                    best[end] = s
                    back[end] = piece
            for at in alone[done:]:
                self._take(at, best, back)
        ids: list[int] = []
        at = n - 1
        while at >= 0:
            length, _, i = back[at]
            if i >= 0:
                ids.append(i)
            else:
                ids += [self.of_byte[b] for b in reversed(text[at].encode())]
            at -= length
        return ids[::-1]

    def _take(self, at: int, best: list[float], back: list) -> None:
        s = best[at - 1] + self.unknown
        if s > best[at]:
            best[at] = s
            back[at] = (1, self.unknown, -1)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        if not text:
            return np.zeros(0, np.int32)
        if not self.by_chunks:
            return np.array(self.best_path(SPACE + text.replace(" ", SPACE)), np.int32)
        known, out = self.known, []
        lead = ""
        for chunk in text.split(" "):
            if not chunk:  # a further space in a run
                lead += SPACE
                continue
            unit = lead + chunk if lead else chunk
            lead = ""
            ids = known.get(unit)
            if ids is None:
                ids = array("i", self.best_path(SPACE + unit)).tobytes()
                if len(unit) <= CACHED_CHUNK:
                    self.held += 150 + len(ids) + 4 * len(unit)
                    if self.held > CACHE_BYTES:
                        known.clear()
                        self.held = 0
                    known[unit] = ids
            out.append(ids)
        if lead:
            out.append(array("i", self.best_path(lead)).tobytes())
        return np.frombuffer(b"".join(out), np.intc)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        whole = b"".join(self.table[np.asarray(ids, np.int64)].tolist())
        return whole.decode("utf-8", "replace").removeprefix(" ")


def encode(df: DataFrame, vocabulary: list[tuple[str, float, str]], text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array of int), the pieces of ``text``; a column of that name is replaced."""
    df = df.drop("ids")
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = None
        for b in batches:
            segmenter = segmenter or Segmenter(vocabulary)
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                ids = [segmenter.encode(t or "") for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names, "ids"])

    return df.mapInArrow(run, df.withColumn("ids", F.lit(None).cast("array<int>")).schema)


def decode(df: DataFrame, vocabulary: list[tuple[str, float, str]], ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of ``ids`` (null for null); a column of that name is replaced."""
    df = df.drop("decoded")
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = None
        for b in batches:
            segmenter = segmenter or Segmenter(vocabulary)
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                texts = [segmenter.decode(x.values.drop_null().to_numpy()) if x.is_valid else None for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return df.mapInArrow(run, df.withColumn("decoded", F.lit(None).cast("string")).schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents encoded and decoded again: numbers and checksums of ids, and whether the text came back."""
    bounded_batches(spark)
    vocabulary = read_model(tokenizer_path("piece_bpe_32k.model"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    done = decode(encode(rows, vocabulary), vocabulary)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        ids_crc32("ids").alias("ids_crc32"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
    )
