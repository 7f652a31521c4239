"""Benchmark decontamination by Wu-Manber search over words.

Texts and benchmark items are read as word sequences; every run of ten item
words (an item of fewer is one run) is a test string.  The search slides a
window over the text's words and looks only at the two-word block at its end:
a shift table says how far the window can move without passing a test string,
blocks with shift 0 select a bucket of test strings by that block's hash, and
the words themselves are then compared, first by 64-bit hash, then byte for
byte.

The skip loop advances thousands of windows at once: each text is cut into
lanes of window positions, and one numpy step moves all lanes by their own
shift.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import Place, column_of, extended, packed
from .runtime import shared_dir, ship, stored
from .textarrays import ALNUM, BLOCK, blocks, words

#: Window positions that one lane walks over.
LANE = 256
#: Test strings in one set of tables, which takes some 60 bytes for each, and in one run of an item's words.
PART_WINDOWS, RUN_WINDOWS = 1 << 19, 1 << 15
#: Bytes of text that meet all sets of tables in turn, where there are several.
MANY_PARTS_BLOCK = 16 << 20
_MUL = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Patterns:
    """Test strings of one length with their shift table and suffix buckets.

    word: hash of every word of the items' runs; start, end: the words' places
    in text, where single blanks part them; first: for each test string the
    number of its first word; items, item_first: the items of each string.
    """

    def __init__(self, length: int, word: np.ndarray, start: np.ndarray, end: np.ndarray, text: bytes, first: np.ndarray, item: np.ndarray):
        self.length, self.span = length, min(2, length)
        self.word, self.start, self.end, self.text = word, start, end, text
        code = np.zeros(len(first), np.uint64)
        for j in range(length):
            code = (code ^ (code >> np.uint64(29))) * _MUL[0] + word[first + j]
        order = np.lexsort((item, code))
        same = np.zeros(len(order), bool)
        same[1:] = True
        for j in range(length):  # strings are one if all their words' hashes are equal
            w = word[first[order] + j]
            same[1:] &= w[1:] == w[:-1]
        new = ~same
        first, of = first[order[new]], np.cumsum(new) - 1
        owner = item[order]
        once = new.copy()
        once[1:] |= owner[1:] != owner[:-1]
        owner, of = owner[once], of[once]
        self.bits = int(np.clip(np.ceil(np.log2(8 * len(first))), 18, 22))
        shift = np.full(1 << self.bits, length - self.span + 1, np.uint8)
        for at in range(length - 1, self.span - 2, -1):
            np.minimum.at(shift, self._index(word[first + max(at - 1, 0)], word[first + at]), np.uint8(length - 1 - at))
        bucket = self._index(word[first + max(length - 2, 0)], word[first + length - 1])
        order = np.argsort(bucket, kind="stable")
        self.shift, self.first = shift, first[order].astype(np.int32)
        self.bucket_first = np.searchsorted(bucket[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.argsort(place[of], kind="stable")
        self.items = owner[by].astype(np.int32)
        self.item_first = np.searchsorted(place[of][by], np.arange(len(order) + 1)).astype(np.int32)

    def _index(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        mixed = before * _MUL[0] + last * _MUL[1] if self.span == 2 else last * _MUL[0] + last * _MUL[1]
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def items_of(self, which: np.ndarray) -> set[int]:
        return set(np.concatenate([self.items[self.item_first[q] : self.item_first[q + 1]] for q in which]).tolist())

    def search(self, w, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the last word, test string) of every occurrence."""
        n_ends = w.counts - self.length + 1
        texts = np.flatnonzero(n_ends > 0)
        lanes = -(-n_ends[texts] // LANE)
        total = int(lanes.sum())
        if not total:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        nth = np.arange(total) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = np.repeat(w.first[texts] + self.length - 1, lanes)
        stop = np.minimum(begin + (nth + 1) * LANE, np.repeat(w.first[texts + 1], lanes))
        pos = begin + nth * LANE
        found = []
        while len(pos):
            last = w.hash[pos]
            at = self._index(w.hash[pos - 1] if self.span == 2 else last, last)
            step = self.shift[at]
            if len(zero := np.flatnonzero(step == 0)):
                found.append((pos[zero], at[zero]))
            pos = pos + np.maximum(step, 1)
            if not (on := pos < stop).all():
                pos, stop = pos[on], stop[on]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        where, at = (np.concatenate(x) for x in zip(*found, strict=True))
        size = (self.bucket_first[at + 1] - self.bucket_first[at]).astype(np.int64)
        where = np.repeat(where, size)
        which = np.arange(len(where)) + np.repeat(self.bucket_first[at] - (np.cumsum(size) - size), size)
        for j in range(self.length):
            same = w.hash[where - self.length + 1 + j] == self.word[self.first[which] + j]
            where, which = where[same], which[same]
        low = bytes.lower
        begin, stop = self.start[self.first[which]].tolist(), self.end[self.first[which] + self.length - 1].tolist()
        same = [b" ".join(low(data[w.start[k] : w.end[k]].tobytes()) for k in range(p - self.length + 1, p + 1)) == self.text[x:y] for p, x, y in zip(where.tolist(), begin, stop, strict=True)]
        same = np.array(same, bool)
        return where[same], which[same]


def _cut(window: int):
    """Runs of an item's words that hold its test strings: length, n (strings), words (hashes), sizes (bytes), text, ids."""
    schema = "length int, n int, words binary, sizes binary, text binary, ids array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer((batch.column(0)[i].as_py() or "").encode(), np.uint8)
                w = words(data, np.array([0, len(data)]), ALNUM)
                if not (n := len(w.hash)):
                    continue
                length = min(window, n)
                for a in range(0, n - length + 1, RUN_WINDOWS):
                    b = min(n, a + RUN_WINDOWS + length - 1)
                    text = b" ".join(data[x:y].tobytes().lower() for x, y in zip(w.start[a:b], w.end[a:b], strict=True))
                    row = [length, b - a - length + 1, w.hash[a:b].tobytes(), (w.end[a:b] - w.start[a:b]).astype(np.int64).tobytes(), text]
                    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], k) for x, k in zip(row, kinds, strict=True)), pa.array([batch.column(1)[i].as_py()], pa.list_(pa.string()))], names=["length", "n", "words", "sizes", "text", "ids"])

    return run, schema


def _tables(runs: pa.Table) -> tuple[list[Patterns], list[list[str]]]:
    """Patterns for each length of a part's runs, and the ids of each of its items."""
    out, ids = [], [x or [] for x in runs.column("ids").to_pylist()]
    length, n = runs.column("length").to_numpy(), runs.column("n").to_numpy()
    for size in np.unique(length).tolist():
        rows = np.flatnonzero(length == size)
        word = [np.frombuffer(runs.column("words")[i].as_py(), np.uint64) for i in rows.tolist()]
        sizes = np.concatenate([np.frombuffer(runs.column("sizes")[i].as_py(), np.int64) for i in rows.tolist()])
        end = np.cumsum(sizes + 1) - 1  # a blank after each word, also between runs
        text = b" ".join(runs.column("text")[i].as_py() for i in rows.tolist())
        begin = np.cumsum([0, *map(len, word)])[:-1]
        first = np.concatenate([b + np.arange(k) for b, k in zip(begin.tolist(), n[rows].tolist(), strict=True)])
        out.append(Patterns(size, np.concatenate(word), end - sizes, end, text, first, np.repeat(rows, n[rows])))
    return out, ids


def compiled(items: DataFrame, window: int = 10, item_id: str = "item_id", item_text: str = "text", part_windows: int = PART_WINDOWS) -> list[str]:
    """Paths of files in the shared folder with the tables of all test strings, each of about part_windows strings at most.

    Items of one text are one.  Executors cut them into runs of words, deal the
    runs to parts and build each part's tables; the driver only gets the paths,
    one for each part.
    """
    spark = items.sparkSession
    ship(spark)
    folder = shared_dir(spark)
    texts = items.select(F.col(f"`{item_text}`").alias("t"), F.col(f"`{item_id}`").cast("string").alias("k")).where("t is not null").groupBy("t").agg(F.sort_array(F.collect_set("k")).alias("ids"))
    run, schema = _cut(window)
    runs = stored(texts.mapInArrow(run, schema), f"{folder}/runs")
    parts = -(-(runs.agg(F.sum("n")).first()[0] or 0) // part_windows)

    def build(table: pa.Table) -> pa.Table:
        store, at = pafs.FileSystem.from_uri(folder)
        store.create_dir(f"{at}/tables", recursive=True)
        name = f"tables/{table.column('part')[0].as_py():06d}-{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(f"{at}/{name}") as f:
            f.write(pickle.dumps(_tables(table), protocol=5))
        return pa.table([pa.array([name])], names=["name"])

    if not parts:
        return []
    made = runs.withColumn("part", F.pmod(F.xxhash64("words", "ids"), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(build, "name string")
    return sorted(f"{folder}/{r.name}" for r in stored(made, f"{folder}/made").collect())


@lru_cache(1)
def _loaded(path: str) -> tuple[list[Patterns], list[list[str]]]:
    """One part's tables at a time in each worker."""
    store, at = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        return pickle.loads(f.read())


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def occurrences(docs: DataFrame, items: DataFrame, window: int = 10, text: Place = "text", item_id: str = "item_id", item_text: str = "text", part_windows: int = PART_WINDOWS, drop: Sequence[str] = ()) -> DataFrame:
    """Adds to docs: n_words, hit_spans (runs of hit words, end exclusive) and hit_items (sorted ids as strings).

    Words are maximal runs of ASCII letters and digits and non-ASCII
    characters, A-Z lower-cased.  The test strings' tables lie in files of
    bounded size, built on executors; a worker holds one of them at a time.
    Texts pass through once: where a benchmark is so large that there are
    several files, some megabytes of text meet all of them in turn.  No shuffle
    of texts takes place, so neither hot sources nor repeated rows matter.

    Null or empty text: no words, no hits.  Items without words have no test
    strings; an item with a null id still marks words but is not listed;
    repeated ids are listed once.  Empty tables give no rows, or no hits.
    Columns of docs that bear a new column's name are replaced, those in drop left out.
    """
    paths = compiled(items, window, item_id, item_text, part_windows)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(_SPAN)), T.StructField("hit_items", T.ArrayType(T.StringType()))]

    def make():
        def run(batch: pa.RecordBatch):
            column = column_of(batch, text)
            n_words, spans, items = [], [], []
            for _, _, data, offsets in blocks(column, BLOCK if len(paths) < 2 else MANY_PARTS_BLOCK):
                w = words(data, offsets, ALNUM)
                n_words.append(w.counts)
                mine: dict[int, set[str]] = {}
                edge = np.zeros(len(w.hash) + 1, np.int32)
                for path in paths:
                    tables, ids = _loaded(path)
                    for p in tables:
                        where, which = p.search(w, data)
                        np.add.at(edge, where - p.length + 1, 1)
                        np.add.at(edge, where + 1, -1)
                        owner = np.searchsorted(w.first, where, "right") - 1
                        for d in np.unique(owner).tolist():
                            mine.setdefault(d, set()).update(x for k in p.items_of(np.unique(which[owner == d])) for x in ids[k])
                hit = np.cumsum(edge[:-1]) > 0
                for d in range(len(offsets) - 1):
                    a, b = w.first[d], w.first[d + 1]
                    own = hit[a:b]
                    spans.append(_runs(own) if own.any() else [])
                    items.append(sorted(mine.get(d, ())))
            return [pa.array(np.concatenate(n_words), pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _ARROW_SPANS), pa.array(items, pa.list_(pa.string()))]

        return run

    return extended(docs, fields, make, drop)


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = occurrences(docs.select("doc_id", "text"), items, drop=["text"], **options)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any benchmark words, with the columns they came with.

    Documents are rows: null and empty texts stay, repeated rows stay or go
    together, an empty benchmark keeps all, and an empty table gives one.
    Columns may bear any names.
    """
    rows, place = packed(docs)
    return occurrences(rows, items, text=place).where(F.size("hit_spans") == 0).select("__row.*")
