"""Stupid-backoff scores of every document against the rest of the corpus.

The corpus is dealt to pages of about a million words.  For each order of
n-grams every page sends its distinct n-grams with their counts, as sorted
blocks of hashes, to the partitions of that order's count table; there the
counts of all pages add up, and each page gets back the totals of what it
sent.  A page then joins its documents' n-grams to the totals, takes a
document's own counts off, and sums the scores of its words.

So what moves is one block per page and partition rather than one row per
n-gram: 8 bytes of hash shrink to five or six by differences, an n-gram that
fills the corpus is one entry of each page, and no count table has to fit into
one place.

Pages and partitions both grow with the corpus, so beyond MAX_PARTS partitions
blocks would hold but a few n-grams each and be as many as the square of the
corpus.  Then each distinct n-gram of a page is a row: count tables are an
aggregation by hash, and a join by hash gives the pages their totals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import shared_dir, ship, stored
from .textarrays import SPACED, blocks, mix, words

ORDER, BACKOFF = 3, 0.4
#: Words of a page, and n-grams that a partition of a count table gets on average.
PAGE_WORDS, PARTITION_GRAMS = 1 << 20, 1 << 20
#: Words of a page whose own counts are taken at once, up to the end of a document.
SLICE_WORDS = 1 << 17
#: Partitions of a count table up to which pages send blocks, a few hundred n-grams at least; beyond, rows.
MAX_PARTS = 4096
#: Count of a word that occurs nowhere else.
UNSEEN = 0.5


def _squeezed(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes; high planes of small numbers nearly vanish."""
    x = np.ascontiguousarray(x, "<u8")
    return zlib.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _spread(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)


def _pages(docs: DataFrame, page_words: int) -> DataFrame:
    schema = "page long, doc_ids array<long>, n_words array<int>, vocabulary binary, codes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        counts: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        seq = held = 0

        def page():
            vocabulary, codes = np.unique(np.concatenate(hashes), return_inverse=True)
            sizes = np.concatenate(counts).tolist()
            name = TaskContext.get().partitionId() << 32 | seq
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([_squeezed(np.diff(vocabulary, prepend=np.uint64(0)))], pa.binary()), pa.array([_squeezed(codes)], pa.binary())], names=["page", "doc_ids", "n_words", "vocabulary", "codes"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, data, offsets in blocks(batch.column(1)):
                w = words(data, offsets, SPACED)
                ids += keys[a:b]
                counts.append(w.counts)
                hashes.append(w.hash)
                held += len(w.hash)
                if held >= page_words:
                    yield page()
                    seq, held, ids, counts, hashes = seq + 1, 0, [], [], []
        if ids:
            yield page()

    return docs.mapInArrow(run, schema)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a page's words, and the document each belongs to."""
    h = np.cumsum(_spread(row["vocabulary"]), dtype=np.uint64)[_spread(row["codes"]).astype(np.int64)]
    return h, np.repeat(np.arange(len(row["n_words"])), row["n_words"])


def _grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams inside documents, and the place of each one's last word."""
    inside = doc[n - 1 :] == doc[: len(doc) - n + 1] if len(doc) >= n else np.empty(0, bool)
    at = np.flatnonzero(inside)
    g = np.zeros(len(at), np.uint64)
    for k in range(n):
        g = mix(g * np.uint64(0x9E3779B97F4A7C15) + h[at + k])
    return g, at + n - 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One page at a time, so that only one is unpacked."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _bounds(parts: int) -> np.ndarray:
    return np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)


def _totals(pages: DataFrame, n: int, parts: int) -> DataFrame:
    """Corpus-wide counts of each page's distinct n-grams, in ascending order of hash: page, part, counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            g, count = np.unique(_grams(*_read(row), n)[0], return_counts=True)
            cuts = [0, *np.searchsorted(g, _bounds(parts)).tolist(), len(g)]
            some = [k for k in range(parts) if cuts[k] < cuts[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["page"]] * len(some), pa.int64()), pa.array([_squeezed(np.diff(g[cuts[k] : cuts[k + 1]], prepend=np.uint64(0))) for k in some], pa.binary()), pa.array([_squeezed(count[cuts[k] : cuts[k + 1]]) for k in some], pa.binary())], names=["part", "page", "grams", "counts"])

    def add(table: pa.Table) -> pa.Table:
        grams = [np.cumsum(_spread(x.as_py()), dtype=np.uint64) for x in table.column("grams")]
        counts = np.concatenate([_spread(x.as_py()) for x in table.column("counts")])
        _, back = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.zeros(int(back.max()) + 1, np.uint64)
        np.add.at(total, back, counts)
        ends = np.cumsum([0, *map(len, grams)])
        sent = [_squeezed(total[back[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table([table.column("page"), table.column("part"), pa.array(sent, pa.binary())], names=["page", "part", "counts"])

    sent = pages.select("page", "n_words", "vocabulary", "codes").mapInArrow(send, "part int, page long, grams binary, counts binary")
    return sent.groupBy("part").applyInArrow(add, "page long, part int, counts binary")


def _row_totals(pages: DataFrame, n: int) -> DataFrame:
    """Corpus-wide counts of each page's distinct n-grams: page, n, g (the hash with its sign turned, so that it sorts as unsigned), total."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            g, count = np.unique(_grams(*_read(row), n)[0], return_counts=True)
            g = (g ^ np.uint64(1 << 63)).view(np.int64)
            for a in range(0, len(g), 1 << 16):
                part = g[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), row["page"])), pa.array(count[a : a + (1 << 16)])], names=["g", "page", "c"])

    sent = pages.select("page", "n_words", "vocabulary", "codes").mapInArrow(send, "g long, page long, c long")
    totals = sent.groupBy("g").agg(F.sum("c").alias("total"))
    return sent.select("g", "page").join(totals, "g").select("page", F.lit(n).alias("n"), "g", "total")


def scored(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, doc_id: str = "doc_id", text: str = "text", page_words: int = PAGE_WORDS, partition_grams: int = PARTITION_GRAMS, max_parts: int = MAX_PARTS) -> DataFrame:
    """One row per document: doc_id, n_words, n_backoff (words scored below the highest order their place allows), log_score.

    log_score is the sum over the words of the natural logarithm of their
    stupid-backoff score: with c the counts over all other documents' words, the
    longest n-gram up to ``order`` that ends in the word, lies in the document
    and has c > 0 scores c(n-gram) / c(n-gram without the word), times
    ``backoff`` for every order left out; a single word scores c / N, with c at
    least UNSEEN and N (at least 1) the number of words of all other documents.
    Words are runs of anything but ASCII white space, A-Z lower-cased.  Texts
    without words (null, empty, blank) have log_score null.  Counts cover every
    row, repeated ones too; each row is a document of its own.  doc_id is read
    as a long; further columns are left out; no rows give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    pages = stored(_pages(source, page_words), f"{folder}/pages")
    n_all = pages.agg(F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    parts = max(1, -(-n_all // partition_grams))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_backoff", T.LongType()), T.StructField("log_score", T.DoubleType())])

    answers = None
    if parts > max_parts:
        for n in range(1, order + 1):
            own = _row_totals(pages, n)
            answers = own if answers is None else answers.unionByName(own)

        def join(page: pa.Table, totals: pa.Table) -> pa.Table:
            row = page.to_pylist()[0]
            n, g, total = (totals.column(c).to_numpy() for c in ("n", "g", "total"))
            by = {}
            for k in range(1, order + 1):
                own = np.flatnonzero(n == k)
                by[k] = total[own[np.argsort(g[own], kind="stable")]].astype(np.int64)
            return pa.Table.from_batches([_page_scores(row, by, n_all, order, backoff)])

        return pages.groupBy("page").cogroup(stored(answers, f"{folder}/totals").groupBy("page")).applyInArrow(join, schema)
    for n in range(1, order + 1):
        own = stored(_totals(pages, n, parts), f"{folder}/totals-{n}").withColumn("n", F.lit(n))
        answers = own if answers is None else answers.unionByName(own)
    answers = answers.groupBy("page").agg(F.collect_list(F.struct("n", "part", "counts")).alias("totals"))  # at most max_parts for each order

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            blocks_of = {n: sorted((t for t in row["totals"] or () if t["n"] == n), key=lambda t: t["part"]) for n in range(1, order + 1)}
            yield _page_scores(row, {n: np.concatenate([_spread(x["counts"]) for x in ts] or [np.empty(0, np.uint64)]).astype(np.int64) for n, ts in blocks_of.items()}, n_all, order, backoff)

    return pages.join(answers, "page", "left").mapInArrow(score, schema)


def _others(h: np.ndarray, doc: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """The count over other documents of the n-gram that ends at each word; -1 where none does."""
    g, at = _grams(h, doc, n)
    _, code = np.unique(g, return_inverse=True)
    del g
    out = np.full(len(h), -1, np.int64)
    a = 0
    while a < len(at):  # some documents at a time
        b = int(np.searchsorted(at, at[a] + SLICE_WORDS))
        b = int(np.searchsorted(at, np.searchsorted(doc, doc[at[b - 1]], "right")))
        _, same, own = np.unique(doc[at[a:b]] * max(1, len(total)) + code[a:b], return_inverse=True, return_counts=True)
        out[at[a:b]] = total[code[a:b]] - own[same]
        a = b
    return out


def _page_scores(row: dict, totals: dict[int, np.ndarray], n_all: int, order: int, backoff: float) -> pa.RecordBatch:
    """Scores of a page's documents; totals: for each order the counts of the page's distinct n-grams in ascending order of hash."""
    h, doc = _read(row)
    sizes = np.array(row["n_words"], np.int64)
    rest = {n: _others(h, doc, n, totals[n]) for n in range(1, order + 1)}
    del h
    others = np.maximum(n_all - sizes, 1)[doc]
    score = np.log(np.maximum(rest[1], UNSEEN) / others)
    level = np.ones(len(doc), np.int8)
    highest = np.ones(len(doc), np.int8)
    for n in range(2, order + 1):
        highest[rest[n] >= 0] = n
    score += np.log(backoff) * (highest - 1)
    for n in range(2, order + 1):
        seen = np.flatnonzero(rest[n] > 0)
        score[seen] = np.log(rest[n][seen] / rest[n - 1][seen - 1]) + np.log(backoff) * (highest[seen] - n)
        level[seen] = n
    k = len(sizes)
    sums = np.bincount(doc, weights=score, minlength=k)
    lower = np.bincount(doc, weights=level < highest, minlength=k).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(sizes), pa.array(lower), pa.array(sums, pa.float64(), mask=sizes == 0)], names=["doc_id", "n_words", "n_backoff", "log_score"])


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_backoff, mean_log_score (rounded to 6 places)."""
    found = scored(docs)
    return found.select("doc_id", "n_words", "n_backoff", F.round(F.col("log_score") / F.col("n_words"), 6).alias("mean_log_score"))
