"""SentencePiece BPE as vectorised merge rounds.

A text splits before every run of blanks that follows another character, as no
piece of the vocabulary continues past such a place (checked when the model is
loaded), so its words can be merged on their own and each distinct word once.
The symbols of all words lie in one flat array.  A round finds the least rank
of each word's adjacent pairs by a segmented minimum and merges all its places
at once, from the left and without overlap, in all words.  The library merges
them one after another; that comes to the same unless a merge makes a pair of
the same or a lesser rank, which is then next.  Every round looks for that, and
a word's places to the right of such a merge wait.  Absorbed symbols are
unlinked, and the arrays are compacted when two in five symbols are gone or
belong to words without a pair.

Very long words are first cut where no piece holds the two neighbouring
characters together.  Rounds number as many as the distinct ranks in a word, not
as its symbols, so words of any length go the same way.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import extended
from .chunkcache import ChunkCache
from .textarrays import blocks, gather

BLANK = "▁"
_BLANK_UTF8 = BLANK.encode()
#: Rank of a place without a pair, and the symbol of an absorbed one.
_NONE, _GONE = np.int32(2**31 - 1), -2


def _model_fields(data: bytes):
    """(field number, wire type, value) of one protobuf message."""
    at, n = 0, len(data)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Vocabulary, merge table and decoding tables of a SentencePiece BPE model with byte fallback."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        scores, kinds = [], []
        trainer: dict[int, object] = {}
        normal: dict[int, object] = {}
        for field, value in _model_fields(data):
            if field == 1:
                p = dict(_model_fields(value))
                self.pieces.append(p.get(1, b"").decode())
                scores.append(np.frombuffer(p[2], "<f4")[0] if 2 in p else np.float32(0))
                kinds.append(p.get(3, self.NORMAL))
            elif field == 2:
                trainer = dict(_model_fields(value))
            elif field == 3:
                normal = dict(_model_fields(value))
        kinds = np.array(kinds)
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or normal.get(2) or normal.get(4, 1) or not normal.get(3, 1):
            raise ValueError("a BPE model with byte fallback, identity normalisation, kept white space and a dummy prefix is needed")
        if (kinds == self.USER).any() or (kinds == self.UNUSED).any() or any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("user-defined or unused pieces, or pieces with blanks inside, are not supported")
        self.kinds, self.unk = kinds, int(np.flatnonzero(kinds == self.UNKNOWN)[0])
        self.end = self.pieces.index("</s>")
        self.byte_id = np.array([self.pieces.index(f"<0x{b:02X}>") for b in range(256)], np.int32)
        plain = {p: i for i, p in enumerate(self.pieces) if kinds[i] == self.NORMAL}
        symbols = dict(plain)  # characters that occur only inside pieces get ids past the vocabulary
        for p in plain:
            for c in p:
                symbols.setdefault(c, len(self.pieces) + len(symbols) - len(plain))
        self.n_symbols = len(self.pieces) + len(symbols) - len(plain)
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        levels = {s: r for r, s in enumerate(sorted({-float(scores[i]) for i in plain.values()}))}
        keys, merged, ranks, inner = [], [], [], set()
        for p, i in plain.items():
            for k in range(1, len(p)):
                inner.add(ord(p[k - 1]) << 21 | ord(p[k]))
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.n_symbols + b)
                    merged.append(i)
                    ranks.append(levels[-float(scores[i])])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.merged = np.array(merged, np.int32)[order]
        self.ranks = np.array(ranks, np.int32)[order]
        self.inner = np.array(sorted(inner), np.int64)
        bits = max(16, int(len(keys) * 8 - 1).bit_length())
        self.slot_bits = bits
        self._slots()
        blobs = [p.replace(BLANK, " ").encode() if kinds[i] == self.NORMAL else b" \xe2\x81\x87 " if kinds[i] == self.UNKNOWN else bytes([int(p[3:5], 16)]) if kinds[i] == self.BYTE else b"" for i, p in enumerate(self.pieces)]
        self.bytes_of = blobs
        self.piece_bytes = np.frombuffer(b"".join(blobs), np.uint8)
        self.piece_first = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])

    def _slots(self):
        """Open-addressed table from pair to its place in keys; most lookups need one probe."""
        size = 1 << self.slot_bits
        table = np.full(size, -1, np.int32)
        depth = 0
        todo = np.arange(len(self.keys), dtype=np.int32)
        spot = self._spot(self.keys)
        while len(todo):
            free = table[spot] < 0
            table[spot[free]] = todo[free]
            left = table[spot] != todo
            todo, spot = todo[left], (spot[left] + 1) & (size - 1)
            depth += 1
        self.table, self.depth = table, depth

    def _spot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index into keys of each pair, -1 where no piece is made of it."""
        key = left.astype(np.int64) * self.n_symbols + right
        key[(left < 0) | (right < 0)] = -1
        out = np.full(len(key), -1, np.int64)
        todo, spot = np.flatnonzero(key >= 0), None
        spot = self._spot(key[todo])
        size = len(self.table)
        for _ in range(self.depth + 1):
            at = self.table[spot]
            same = (at >= 0) & (self.keys[at] == key[todo])
            out[todo[same]] = at[same]
            on = (at >= 0) & ~same
            if not on.any():
                break
            todo, spot = todo[on], (spot[on] + 1) & (size - 1)
        return out

    # -- merging -------------------------------------------------------------

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and where each word's ids begin (one entry more)."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate([[0], np.cumsum(sizes)])
        begin, owner = first[:-1], np.arange(len(words))
        if len(words) and sizes.max() > 64:  # cut long words between characters that no piece holds together
            pair = codes[:-1] << 21 | codes[1:]
            at = np.searchsorted(self.inner, pair)
            cut = (self.inner[np.minimum(at, len(self.inner) - 1)] != pair) if len(self.inner) else np.ones(len(pair), bool)
            cut &= np.repeat(sizes > 64, sizes)[1:]
            begin = np.union1d(begin[sizes > 0], np.flatnonzero(cut) + 1)
            owner = np.searchsorted(first, begin, "right") - 1
        length = np.diff(np.append(begin, len(codes)))
        sym, at = self._rounds(self.of_char[codes], length[length > 0])
        return self._spelled(sym, at, codes, first)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; _NONE where no piece is made of it."""
        if not len(self.keys):
            return np.full(len(left), _NONE), np.full(len(left), -1, np.int32)
        found = self.pairs(left, right)
        return np.where(found >= 0, self.ranks[found], _NONE), np.where(found >= 0, self.merged[found], np.int32(-1))

    def _rounds(self, symbol: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after their merges, and the place at which each began; length: each word's symbols, none of them 0."""
        place = np.arange(len(symbol))
        if not len(symbol):
            return symbol, place
        rank, merged = (np.append(x, x[:0].dtype.type(y)) for x, y in zip(self._ranked(symbol[:-1], symbol[1:]), (_NONE, -1), strict=True))
        rank[np.cumsum(length)[:-1] - 1] = _NONE
        done_sym, done_at = [], []
        while len(symbol):
            going, size = self._merged_until_sparse(symbol, rank, merged, length)
            held, on = symbol != _GONE, np.repeat(going, length)
            off = held & ~on
            done_sym.append(symbol[off])
            done_at.append(place[off])
            on &= held
            symbol, place, rank, merged, length = symbol[on], place[on], rank[on], merged[on], size[going]
        sym, at = np.concatenate(done_sym), np.concatenate(done_at)
        order = np.argsort(at, kind="stable")
        return sym[order], at[order]

    def _merged_until_sparse(self, symbol, rank, merged, length) -> tuple[np.ndarray, np.ndarray]:
        """Rounds, in place, until two in five symbols need no more; which words have a pair left, and each word's symbols."""
        n, size = len(symbol), length.copy()
        start = np.cumsum(length) - length
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[start + length - 1] = -1
        before[start] = -1
        while True:
            least = np.minimum.reduceat(rank, start)
            going = least != _NONE
            if 5 * int(size[going].sum()) < 3 * n or not going.any():
                return going, size
            least[~going] = -1
            c = np.flatnonzero(rank == (least[0] if len(least) == 1 else np.repeat(least, length)))
            follows = after[c[:-1]] == c[1:]
            if follows.any():  # of places that overlap every second one, from the left
                i = np.arange(len(c))
                i[1:][follows] = 0
                c = c[((np.arange(len(c)) - np.maximum.accumulate(i)) & 1) == 0]
            absorbed, left = after[c], before[c]
            right, new = after[absorbed], merged[c]
            touching = np.zeros(len(c), bool)  # the place before ends where this one begins
            touching[1:] = right[:-1] == c[1:]
            beside = np.where(left >= 0, symbol[left], -1)
            beside[1:][touching[1:]] = new[:-1][touching[1:]]
            left[1:][touching[1:]] = c[:-1][touching[1:]]
            left_rank, left_piece = self._ranked(beside, new)
            right_rank, right_piece = self._ranked(new, np.where(right >= 0, symbol[right], -1))
            first = np.minimum(left_rank, right_rank) <= rank[c]
            word = np.searchsorted(start, c, "right") - 1 if len(start) > 1 else np.zeros(len(c), np.int64)
            if first.any():  # what such a merge makes comes before the word's places to its right
                earlier = np.cumsum(first) - first
                keep = earlier == earlier[np.searchsorted(word, word)]
                c, absorbed, left, right, new, word = c[keep], absorbed[keep], left[keep], right[keep], new[keep], word[keep]
                left_rank, left_piece, right_rank, right_piece = left_rank[keep], left_piece[keep], right_rank[keep], right_piece[keep]
            symbol[c], symbol[absorbed], rank[absorbed] = new, _GONE, _NONE
            rank[c], merged[c] = right_rank, right_piece
            some = left >= 0
            rank[left[some]], merged[left[some]] = left_rank[some], left_piece[some]
            after[c] = right
            some = right >= 0
            before[right[some]] = c[some]
            size -= np.bincount(word, minlength=len(size))

    def _spelled(self, sym, at, codes, first) -> tuple[np.ndarray, np.ndarray]:
        """Replaces symbols that are no piece by their characters' bytes."""
        word = np.searchsorted(first, at, "right") - 1
        lost = (sym < 0) | (sym >= len(self.pieces))
        if not lost.any():
            return sym, np.searchsorted(word, np.arange(len(first)))
        spans = [self.byte_id[list(chr(int(c)).encode())] for c in codes[at[lost]]]
        sizes = np.ones(len(sym), np.int64)
        sizes[lost] = [len(s) for s in spans]
        out = np.repeat(sym, sizes)
        out[np.repeat(lost, sizes)] = np.concatenate(spans)
        return out.astype(np.int32), np.searchsorted(np.repeat(word, sizes), np.arange(len(first)))

    # -- decoding ------------------------------------------------------------

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """UTF-8 texts of id sequences ids[first[i]:first[i+1]]: as the library's decode."""
        flat, sizes = gather(self.piece_bytes, self.piece_first, ids)
        ends = np.concatenate([[0], np.cumsum(sizes)])[first]
        is_byte = self.kinds[ids] == self.BYTE
        shown = np.flatnonzero(self.kinds[ids] != self.CONTROL)
        out = []
        for i in range(len(first) - 1):
            a, b = first[i], first[i + 1]
            k = np.searchsorted(shown, a)
            text = flat[ends[i] : ends[i + 1]].tobytes()
            lead = k < len(shown) and shown[k] < b and self.kinds[ids[shown[k]]] == self.NORMAL and self.pieces[ids[shown[k]]].startswith(BLANK)
            if is_byte[a:b].any():
                text = self._repaired(ids[a:b], text)
            out.append(text[1:] if lead else text)
        return out

    def _repaired(self, ids: np.ndarray, text: bytes) -> bytes:
        runs, run = [], b""
        try:
            text.decode()
            whole = True
        except UnicodeDecodeError:
            whole = False
        if whole and not (self.kinds[ids[:-1]] == self.CONTROL).any():
            return text
        for i in ids.tolist():
            if self.kinds[i] == self.BYTE:
                run += self.bytes_of[i]
            else:
                runs += [_valid(run), self.bytes_of[i]]
                run = b""
        return b"".join([*runs, _valid(run)])


def _valid(run: bytes) -> bytes:
    """The run's characters; each byte that is part of none becomes U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode().encode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(b"\xef\xbf\xbd")
            at += 1
    return b"".join(out)


class Encoder:
    """Encodes blocks of texts, merging each distinct word once."""

    def __init__(self, model: Model):
        self.cache = ChunkCache(lambda words: model.merge([w.replace(" ", BLANK) for w in words]))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block one after another, and where each text's begin (one entry more)."""
        if (data == 0x81).any() and _BLANK_UTF8 in (raw := data.tobytes()):  # the blank sign itself counts as a blank
            texts = [raw[a:b].replace(_BLANK_UTF8, b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        full = offsets[:-1] < offsets[1:]
        data = np.insert(data, offsets[:-1][full], 32)  # the library puts one blank before a text
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        blank = data == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        return self.cache.encode(data, offsets, begins)


@lru_cache(2)
def load(path: str) -> Model:
    return Model(path)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process; its memory of words outlives a task."""
    return Encoder(load(path))


# -- over tables -----------------------------------------------------------------


def encoded(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", end_id: bool = True, decoded: str | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Adds the piece ids of each text, with the end id at the end if asked for.

    model: path of the model file on every machine.  Null counts as the empty
    text, which has no ids but the end id.  One narrow pass: no shuffle.
    decoded: name of a further column with the text that the ids decode to, if
    wanted in the same pass.
    """

    def make():
        enc, m = encoder(model), load(model)

        def run(batch):
            values, sizes, texts = [], [], []
            for _, _, data, offsets in blocks(batch.column(batch.schema.get_field_index(text))):
                got, first = enc.encode(data, offsets)
                n = np.diff(first)
                if end_id:
                    got = np.insert(got, first[1:], m.end)
                    n = n + 1
                values.append(got)
                sizes.append(n)
                if decoded:
                    texts += m.decode(got, np.concatenate([[0], np.cumsum(n)]))
            return [_lists(values, sizes, pa.int32()), *([pa.array(texts, pa.binary()).cast(pa.string())] if decoded else [])]

        return run

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    return extended(docs, fields, make, drop)


def decoded(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded", drop: Sequence[str] = ()) -> DataFrame:
    """Adds the text of each id sequence, as the library's decode gives it.  A null sequence gives the empty text."""

    def make():
        m = load(model)

        def run(batch):
            column = batch.column(batch.schema.get_field_index(ids))
            column = pc.fill_null(column, pa.scalar([], column.type)) if column.null_count else column
            first = column.offsets.to_numpy().astype(np.int64)
            flat = column.values.to_numpy(zero_copy_only=False).astype(np.int32)
            texts = []
            for at in range(0, len(column), 256):
                f = first[at : at + 257]
                texts += m.decode(flat[f[0] : f[-1]], f - f[0])
            return [pa.array(texts, pa.binary()).cast(pa.string())]

        return run

    return extended(docs, [T.StructField(text, T.StringType())], make, drop)


def _lists(values: list[np.ndarray], sizes: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values), kind))


def report(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for."""
    found = encoded(docs.select("doc_id", "text"), model, decoded="decoded", drop=["text"])
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), *(["ids"] if with_ids else []),
    )
