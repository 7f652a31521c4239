"""Token ids in directly addressable files.

An id is cut into chunks of a few bits.  Level 0 holds the lowest chunk of
every id in order; a bitmap beside it marks the ids that go on, and level 1
holds the next chunk of those alone, and so on.  Chunk k of the id at place i
sits at place rank(i) of its level, where rank counts the marks before i, and a
directory of ranks at every 512 marks makes that a look-up and a count of at
most 512 bits.  Any token is thus read from a few fixed places of the file,
without decoding what lies before it.

File layout, little-endian, every section padded to 8 bytes:

    8 bytes   magic "DACIDS01"
    int64     documents n, ids m, levels k, then the chunk bits of each level
    int64[n]  document ids, uint8[n] 1 where the id is not null
    int64[n+1] places where documents begin
    for each level: int64 entries e; packed chunks; and, but for the last
    level, the bitmap of e bits and int64 ranks at every 512 bits
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunkcache import ChunkCache
from .runtime import shared_dir, ship, stored
from .textarrays import BLOCK, blocks

MAGIC = b"DACIDS01"
RANK_EVERY = 512
#: Ids after which a task begins its next file.
FILE_IDS = 4 << 20
WIDTHS = (8, 8, 16)
#: Files that one task reads back.
READ_FILES = 4
#: Chunks of text whose ids a worker remembers, about 90 bytes each.
REMEMBERED = 1_000_000


# -- the format ------------------------------------------------------------------


def _pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def packed(doc_ids: Sequence[int | None], first: np.ndarray, ids: np.ndarray, widths: Sequence[int] = WIDTHS) -> bytes:
    """A whole file; widths are 8 or 16 bits and add up to the 32 of an id."""
    if sum(widths) != 32 or set(widths) - {8, 16}:
        raise ValueError("chunk widths are 8 or 16 and add up to 32")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    levels, rest, shift = [], ids.astype(np.uint32), 0
    for k, bits in enumerate(widths):
        chunk = rest & np.uint32((1 << bits) - 1)
        body = [np.array([len(rest)], "<i8").tobytes(), _pad(chunk.astype("<u1" if bits == 8 else "<u2").tobytes())]
        rest = rest >> np.uint32(bits)
        on = rest > 0
        last = k == len(widths) - 1 or not on.any()
        if not last:
            marks = np.packbits(on, bitorder="little")
            padded = np.pad(on, (0, -len(on) % RANK_EVERY))
            ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, RANK_EVERY).sum(1))])
            body += [_pad(marks.tobytes()), ranks.astype("<i8").tobytes()]
        levels.append(b"".join(body))
        shift += bits
        if last:
            break
        rest = rest[on]
    head = np.array([len(names), len(ids), len(levels), *widths[: len(levels)]], "<i8")
    return b"".join([MAGIC, head.tobytes(), names.tobytes(), _pad(known.tobytes()), np.asarray(first, "<i8").tobytes(), *levels])


class Reader:
    """Random access over a seekable binary file: reads only the places that an answer needs."""

    def __init__(self, file):
        self.file = file
        if self._read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_ids, n_levels = self._ints(8, 3)
        self.widths = self._ints(32, n_levels)
        at = 32 + 8 * n_levels
        self.names_at, self.known_at = at, at + 8 * self.n_docs
        self.first_at = self.known_at + self.n_docs + -self.n_docs % 8
        at = self.first_at + 8 * (self.n_docs + 1)
        self.levels = []
        for k, bits in enumerate(self.widths):
            (n,) = self._ints(at, 1)
            chunks = at + 8
            marks = chunks + n * bits // 8 + -(n * bits // 8) % 8
            at = ranks = marks
            if k < n_levels - 1:
                ranks = marks + -(-n // 8) + -(-(-n // 8)) % 8
                at = ranks + 8 * (-(-n // RANK_EVERY) + 1)
            self.levels.append((bits, n, chunks, marks, ranks))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _ints(self, at: int, n: int) -> list[int]:
        return np.frombuffer(self._read(at, 8 * n), "<i8").tolist()

    def _marks_before(self, level: int, i: int) -> tuple[int, bool]:
        """Marks before place i of a level, and whether i is marked."""
        _, _, _, marks, ranks = self.levels[level]
        block = i // RANK_EVERY
        (rank,) = self._ints(ranks + 8 * block, 1)
        begin = block * RANK_EVERY // 8
        bits = int.from_bytes(self._read(marks + begin, i // 8 - begin + 1), "little")
        k = i - block * RANK_EVERY
        return rank + (bits & ((1 << k) - 1)).bit_count(), bool(bits >> k & 1)

    def __getitem__(self, i: int) -> int:
        """The id at place i of the file."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for k, (bits, _, chunks, _, _) in enumerate(self.levels):
            value |= int.from_bytes(self._read(chunks + i * bits // 8, bits // 8), "little") << shift
            shift += bits
            if k == len(self.levels) - 1:
                break
            i, on = self._marks_before(k, i)
            if not on:
                break
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids at places a to b."""
        a, b = max(0, a), min(b, self.n_ids)
        out = np.zeros(max(0, b - a), np.uint32)
        where, shift = np.arange(len(out)), 0
        for k, (bits, _, chunks, marks, _) in enumerate(self.levels):
            if b <= a:
                break
            raw = self._read(chunks + a * bits // 8, (b - a) * bits // 8)
            out[where] |= np.frombuffer(raw, "<u1" if bits == 8 else "<u2").astype(np.uint32) << np.uint32(shift)
            shift += bits
            if k == len(self.levels) - 1:
                break
            skip = a // 8
            on = np.unpackbits(np.frombuffer(self._read(marks + skip, (b - 1) // 8 - skip + 1), np.uint8), bitorder="little")[a - 8 * skip : b - 8 * skip].astype(bool)
            where = where[on]
            a = self._marks_before(k, a)[0]
            b = a + len(where)
        return out

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Document ids, and where each one begins (one entry more)."""
        known = np.frombuffer(self._read(self.known_at, self.n_docs), np.uint8)
        names = [i if k else None for i, k in zip(self._ints(self.names_at, self.n_docs), known.tolist(), strict=True)]
        return names, np.array(self._ints(self.first_at, self.n_docs + 1), np.int64)


# -- encoding --------------------------------------------------------------------


def _chunk_begins(data: np.ndarray) -> np.ndarray:
    """Blanks before which the byte-level pre-tokenizer surely begins a new word.

    No word of it goes on from a character other than white space to a blank,
    and a single blank before a visible character always begins one.
    """
    n = len(data)
    blank = data == 32
    begin = blank.copy()
    begin[1:] &= ~blank[:-1]
    seen = (data > 32) & (data < 127)
    before = np.zeros(n, bool)
    before[1:] = seen[:-1]
    for k, low, bad in ((2, 0xC3, ()), (3, 0xE0, (0xE1, 0xE2, 0xE3, 0xEF)), (4, 0xF0, ())):
        lead = np.zeros(n, bool)
        if n > k:
            lead[k:] = (data[:-k] >= low) & (data[:-k] < (0xE0, 0xF0, 0xF8)[k - 2])
            for x in bad:
                lead[k:] &= data[:-k] != x
        before |= lead & begin
    after = np.zeros(n, bool)
    after[:-1] = seen[1:]
    return begin & (before | after)


class _Tokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.cache = ChunkCache(self._strings, REMEMBERED)

    def _strings(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.own.encode_batch_fast(strings, add_special_tokens=False)]
        flat = np.fromiter((x for i in ids for x in i), np.int32)
        return flat, np.concatenate([[0], np.cumsum([len(i) for i in ids])])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.cache.encode(data, offsets, _chunk_begins(data))


@lru_cache(2)
def tokenizer(path: str) -> _Tokenizer:
    """One for each worker process."""
    return _Tokenizer(path)


# -- over tables -----------------------------------------------------------------

_MANIFEST = T.StructType([T.StructField(n, k) for n, k in (("part", T.IntegerType()), ("seq", T.IntegerType()), ("path", T.StringType()), ("n_docs", T.LongType()), ("n_ids", T.LongType()), ("bytes", T.LongType()))])


def written(docs: DataFrame, model: str, to: str | None = None, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the token files of a corpus and returns their manifest: part, seq, path, n_docs, n_ids, bytes.

    Documents go to files in ascending doc_id (null first, equal ids by a hash
    of their text), through one range exchange; each task closes a file every
    ``file_ids`` ids, so a task's memory does not follow its share of the input,
    and writes it under a name of its own before the manifest, written by
    Spark's committer, names it: a task that is run again leaves at most a file
    that no manifest lists.  Null counts as the empty text: just the end id.

    to: a folder that all executors share; by default a new one under
    spark.checkpoint.dir.
    """
    spark = docs.sparkSession
    ship(spark)
    to = to or shared_dir(spark)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    rows = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h").select("k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = tokenizer(model), TaskContext.get()
        out, folder = pafs.FileSystem.from_uri(to)
        out.create_dir(f"{folder}/files", recursive=True)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        seq = n_ids = 0

        def close():
            first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            body = packed(names, first, np.concatenate(held))
            at = f"{folder}/files/{task.partitionId():06d}-{seq:05d}-{task.taskAttemptId()}.dac"
            with out.open_output_stream(at) as f:
                f.write(body)
            line = [task.partitionId(), seq, at.removeprefix(f"{folder}/"), len(names), int(first[-1]), len(body)]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(line, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=_MANIFEST.names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, data, offsets in blocks(batch.column(1), min(BLOCK, file_ids)):
                got, first = enc.encode(data, offsets)
                held.append(np.insert(got, first[1:], end_id))
                sizes.append(np.diff(first) + 1)
                names += keys[a:b]
                n_ids += len(held[-1])
                if n_ids >= file_ids:
                    yield close()
                    seq, n_ids = seq + 1, 0
                    names.clear(), held.clear(), sizes.clear()
        if names:
            yield close()

    manifest = stored(rows.mapInArrow(run, _MANIFEST), f"{to}/manifest")
    return manifest.withColumn("path", F.concat(F.lit(f"{to}/"), "path"))


def read(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, path.

    Places in the whole corpus follow from running sums: over the files of each
    part, and over the parts, one row for each writing task.  Files are then
    read independently, READ_FILES in a task: their number is given, so adaptive
    execution doesn't put the small manifest, and with it the whole corpus, into
    one task.
    """
    spark: SparkSession = manifest.sparkSession
    ship(spark)

    def before(sums, column: str):
        return F.coalesce(F.sum(column).over(sums.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("__ids"), F.count("*").alias("__files"))
    tasks = -(-(parts.agg(F.sum("__files")).first()[0] or 0) // READ_FILES)
    starts = parts.select("part", before(Window.orderBy("part"), "__ids").alias("__start"))
    inside = before(Window.partitionBy("part").orderBy("seq"), "n_ids")
    files = manifest.withColumn("__inside", inside).join(starts, "part").select("path", (F.col("__start") + F.col("__inside")).alias("base")).repartition(max(1, tasks))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("path", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = pafs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    r = Reader(f)
                    names, first = r.documents()
                    a = 0
                    while a < len(names):  # a few documents at a time
                        b = max(a + 1, int(np.searchsorted(first, first[a] + (1 << 20), "right")) - 1)
                        ids = r.slice(int(first[a]), int(first[b])).astype("<u4")
                        own = first[a : b + 1] - first[a]
                        crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(names[a:b], pa.int64()), pa.array(first[a:b] + base), pa.array(np.diff(own)), pa.array(crc, pa.int64()), pa.array([path] * (b - a))], names=schema.names)
                        a = b

    return files.mapInArrow(run, schema)


def report(docs: DataFrame, model: str) -> DataFrame:
    """One row per document, from files written and read back: doc_id, start, n_tokens, ids_crc32."""
    return read(written(docs, model)).select("doc_id", "start", "n_tokens", "ids_crc32")
