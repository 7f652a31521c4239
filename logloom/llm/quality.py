"""Quality classifier: logistic regression over hashed word n-grams, learnt by FTRL-proximal updates.

A text's features are its lower-cased words and word pairs, the pairs and
triples of its words' shapes (which kinds of characters a word holds), a mark
for each word that repeats the one before, and one for each word triple that
the text has had already.  Every feature is hashed to one of 2**BITS weights;
counts are scaled to unit length, so a score is one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import Place, column_of, extended, packed
from .runtime import shared_dir, ship, stored
from .textarrays import SPACED, Words, blocks, mix, words

BITS = 18
#: The documented bound: so many labelled rows, chosen by a hash of doc_id, train the model.
MAX_TRAINING_ROWS = 16_000
REJECT_BELOW = 0.3

_UPPER, _LOWER, _DIGIT, _MARK = (np.zeros(256, np.int64) for _ in range(4))
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_DIGIT[48:58] = 1
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = 1


def _shapes(w: Words, data: np.ndarray) -> np.ndarray:
    """A small number for each word: which kinds of characters it holds, and how many marks."""

    def held(kind):
        total = np.concatenate([[0], np.cumsum(kind[data])])
        return total[w.end] - total[w.start]

    marks = held(_MARK)
    long = np.minimum((w.end - w.start) // 8, 3)
    return (held(_UPPER) > 1) * 1 + (held(_LOWER) > 0) * 2 + (held(_DIGIT) > 0) * 4 + np.minimum(marks, 3) * 8 + (long == 3) * 32


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight numbers and values of a block of texts, and where each text's begin (one entry more)."""
    w = words(data, offsets, SPACED)
    n_texts = len(offsets) - 1
    text = w.text_of()
    h = w.hash
    kinds, owners = [h], [text]

    def add(value, owner, salt):
        kinds.append(mix(value * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)))
        owners.append(owner)

    shape = _shapes(w, data).astype(np.uint64)
    two = text[1:] == text[:-1]
    three = two[1:] & two[:-1]
    add((h[:-1] + h[1:] * np.uint64(31))[two], text[1:][two], 1)
    add((shape[:-1] * np.uint64(64) + shape[1:])[two], text[1:][two], 2)
    add((shape[:-2] * np.uint64(4096) + shape[1:-1] * np.uint64(64) + shape[2:])[three], text[2:][three], 3)
    same = two & (h[1:] == h[:-1])
    add(np.zeros(int(same.sum()), np.uint64), text[1:][same], 4)
    run = mix(h[:-2] + h[1:-1] * np.uint64(31) + h[2:] * np.uint64(961))[three]
    order = np.lexsort((run, text[2:][three]))
    own = text[2:][three][order]
    again = np.zeros(len(run), bool)
    again[1:] = (run[order][1:] == run[order][:-1]) & (own[1:] == own[:-1])
    add(np.zeros(int(again.sum()), np.uint64), own[again], 5)

    at = (np.concatenate(kinds) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.sort(np.concatenate(owners) << BITS | at)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(key))).astype(np.float64)
    key = key[begin]
    owner = key >> BITS
    first = np.searchsorted(owner, np.arange(n_texts + 1))
    square = np.concatenate([[0], np.cumsum(count * count)])
    norm = np.sqrt(square[first[1:]] - square[first[:-1]])
    return key & ((1 << BITS) - 1), count / np.maximum(norm, 1e-300)[owner], first


class Ftrl:
    """FTRL-proximal for logistic loss, with a learning rate for each weight."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, x: np.ndarray, label: int) -> None:
        """One example: features i (distinct) with values x; the last weight is the bias."""
        i, x = np.append(i, 1 << BITS), np.append(x, 1.0)
        w = self.weights(i)
        g = (_sigmoid(w @ x) - label) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


#: Features that a row of the training table holds at most; texts with more have several rows.
PIECE = 1 << 12


def examples(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, text: str = "text") -> DataFrame:
    """The training texts' features, in pieces: order, doc_id, label, piece, i, x.

    Chosen are at most about max_rows labelled doc_ids outside the held-out
    fifth, by a hash of doc_id; their ids travel as a broadcast that the same
    bound keeps small.  One text stands for a doc_id, of several that with the
    least hash, however many rows bear it.
    """
    able = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    able = able.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64(F.lit(9), "doc_id")
    rate = min(1.0, max_rows / max(1, able.count()))
    chosen = able.where(F.pmod(order, F.lit(1 << 40)) < int(rate * (1 << 40))).select("doc_id", "quality", order.alias("__order"))
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", value.alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "__order", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("order", T.LongType()), T.StructField("doc_id", id_type), T.StructField("label", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("i", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(3)):
                i, x, first = features(data, offsets)
                pieces = np.maximum(-(-np.diff(first) // PIECE), 1)
                row = np.repeat(np.arange(a, b), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                cuts = pa.array(np.append(np.repeat(first[:-1], pieces) + nth * PIECE, first[-1]), pa.int32())
                take = pa.array(row)
                label = pa.array((batch.column(2).to_numpy() == 1).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (i.astype(np.int32), x.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(0).take(take), label.take(take), pa.array(nth.astype(np.int32)), *lists], names=schema.names)

    return rows.select("doc_id", "__order", "quality", "text").mapInArrow(run, schema)


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, epochs: int = 3, text: str = "text") -> np.ndarray:
    """Weights (the bias last) learnt from at most about max_rows labelled texts outside the held-out fifth.

    Features are made in parallel and written in the order of a hash of doc_id;
    one task then reads them file by file, once for each epoch, and holds a few
    hundred rows at a time.  Held out: crc32(doc_id as text) mod 5 is 0.  Labels
    that are null or without a document are left out, and a null text counts as
    empty; of several labels for one doc_id the least counts; without any the
    model is all zero (scores 0.5).
    """
    spark = docs.sparkSession
    ship(spark)
    folder = f"{shared_dir(spark)}/examples"
    stored(examples(docs, labels, max_rows, text).repartitionByRange("order", "doc_id").sortWithinPartitions("order", "doc_id", "piece"), folder)

    def rows() -> Iterator[tuple]:
        """(order, doc_id), label, features and values of every piece, in order."""
        store, at = pafs.FileSystem.from_uri(folder)
        for path in sorted(f.path for f in store.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet")):
            with store.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(256, columns=["order", "doc_id", "label", "i", "x"]):
                    keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                    for r, (key, label) in enumerate(zip(keys, batch.column(2).to_pylist(), strict=True)):
                        yield key, label, batch.column(3)[r].values.to_numpy(), batch.column(4)[r].values.to_numpy()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            model = Ftrl()
            for _ in range(epochs):
                for (_, label), pieces in groupby(rows(), key=lambda r: r[:2]):
                    i, x = (np.concatenate(v) for v in list(zip(*pieces, strict=True))[2:])
                    model.learn(i, x.astype(np.float64), label)
            yield pa.RecordBatch.from_arrays([pa.array([model.weights(slice(None)).tobytes()], pa.binary())], names=["weights"])

    got = spark.range(1).coalesce(1).mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(got[0].weights)


def scored(docs: DataFrame, weights: np.ndarray, text: Place = "text", score: str = "score", drop: Sequence[str] = ()) -> DataFrame:
    """Adds the probability that a text is of good quality.

    Only the text counts; null is empty, which scores the bias.  Rows keep their
    number, repeated ones get one score, and a column that bears the score's
    name is replaced; columns in drop are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = sent.value

        def run(batch):
            out = []
            for _, _, data, offsets in blocks(column_of(batch, text)):
                i, x, first = features(data, offsets)
                total = np.zeros(len(first) - 1)
                some = first[1:] > first[:-1]  # each text's sum on its own: it doesn't depend on the texts around it
                total[some] = np.add.reduceat(w[i] * x, first[:-1][some]) if len(i) else 0.0
                out.append(_sigmoid(w[-1] + total))
            return [pa.array(np.concatenate(out))]

        return run

    return extended(docs, [T.StructField(score, T.DoubleType())], make, drop)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from REJECT_BELOW on)."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    found = scored(docs.select("doc_id", "text"), trained(docs, labels), drop=["text"])
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns they came with, whatever their names.

    Rows are judged by their texts alone, so null and empty ones go by the bias
    and repeated ones together; an empty table gives one.
    """
    rows, place = packed(docs)
    return scored(rows, trained(docs, labels), place, "__score").where(F.col("__score") >= REJECT_BELOW).select("__row.*")
