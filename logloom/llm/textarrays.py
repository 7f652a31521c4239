"""Words of Arrow text columns as flat numpy arrays.

Texts stay in Arrow's own buffers: a batch is one byte array and one offset
array, and word limits, word hashes and shingle hashes are computed for all of
its texts at once.  Work goes on in blocks of about ``BLOCK`` bytes, so memory
does not follow the batch size; only a single text longer than that makes a
larger block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: ASCII white space separates words; everything else belongs to one.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: Letters a-z (after lower-casing), digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_rng = np.random.default_rng(20240229)
_Q = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
#: Keeps the lowest 0 to 8 bytes of a number.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lanes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each stretch as numbers of 8 bytes (zeros after its end), and where each one's begin (one entry more)."""
    size = end - start
    count = (size + 7) >> 3
    first = np.concatenate([[0], np.cumsum(count)])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the 8 bytes from every byte on
    if first[-1] == len(size) and (count == 1).all():
        return loads[start] & _LOW_BYTES[size], first
    nth = np.arange(first[-1]) - np.repeat(first[:-1], count)
    return loads[np.repeat(start, count) + 8 * nth] & _LOW_BYTES[np.minimum(np.repeat(size, count) - 8 * nth, 8)], first


def hashes(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits of each stretch, from its lanes and its length in bytes.

    Every lane is mixed together with its place before the lanes are summed, so
    no arrangement of bytes cancels another, whatever the stretch's length.
    """
    count = np.diff(first)
    if (count == 1).all():
        total = mix(values ^ np.uint64(0x8E9A1F1D3C5B7A69))
    else:
        nth = (np.arange(len(values)) - np.repeat(first[:-1], count)).astype(np.uint64)
        mixed = mix(values ^ np.uint64(0x8E9A1F1D3C5B7A69) ^ mix(nth) * (nth > 0))
        total = np.zeros(len(size), np.uint64)
        some = count > 0
        total[some] = np.add.reduceat(mixed, first[:-1][some]) if len(values) else 0
    return mix(total + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return raw, offs


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, row after the last, bytes, offsets from 0) of runs of whole texts."""
    raw, offs = buffers(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, to, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


class Words:
    """Words of a block of texts.

    start, end: byte limits of each word in the block; hash: 64 bits of each
    word's lower-cased bytes; first: for each text the index of its first word,
    and one entry more for the end.
    """

    __slots__ = ("start", "end", "hash", "first")

    def __init__(self, start, end, hash_, first):
        self.start, self.end, self.hash, self.first = start, end, hash_, first

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _piece(low: np.ndarray, is_word: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(low)
    m = is_word[low]
    begin = m.copy()
    begin[1:] &= ~m[:-1]
    breaks = breaks[breaks < n]
    begin[breaks] = m[breaks]
    stop = m.copy()
    stop[:-1] &= ~m[1:]
    cut = breaks[breaks > 0] - 1
    stop[cut] = m[cut]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    if not len(start):
        return start, end, np.empty(0, np.uint64)
    values, first = lanes(low, start, end)
    return start, end, hashes(values, first, end - start)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Splits a block into words after lower-casing A-Z; no word spans two texts."""
    low = _LOWER[data]
    if len(low) <= 2 * BLOCK:
        start, end, hashed = _piece(low, is_word, offsets[:-1])
    else:  # one very long text: pieces that end between words
        parts, at = [], 0
        while at < len(low):
            to = min(len(low), at + BLOCK)
            while to < len(low) and is_word[low[to]] and is_word[low[to - 1]]:
                ahead = np.flatnonzero(~is_word[low[to : to + 4096]])
                to = to + int(ahead[0]) if len(ahead) else min(len(low), to + 4096)
            own = offsets[:-1][(offsets[:-1] >= at) & (offsets[:-1] < to)] - at
            s, e, h = _piece(low[at:to], is_word, own)
            parts.append((s + at, e + at, h))
            at = to
        start, end, hashed = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(start, end, hashed, np.searchsorted(start, offsets))


def ngram_hashes(w: Words, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a text, and the first index of each text's runs.

    short: a text of fewer words, but not none, gets one hash of its whole sequence.
    """
    counts = w.counts
    runs = np.maximum(counts - n + 1, 0)
    total = len(w.hash)
    if total >= n:
        acc = np.zeros(total - n + 1, np.uint64)
        for j in range(n):
            acc += w.hash[j : total - n + 1 + j] * _Q[j]
        acc = mix(acc)
    else:
        acc = np.empty(0, np.uint64)
    keep = np.zeros(total + 1, np.int64)
    has = runs > 0
    keep[w.first[:-1][has]] += 1
    keep[(w.first[:-1] + runs)[has]] -= 1
    inside = np.cumsum(keep[:-1])[: len(acc)].astype(bool)
    if not short or not (lack := (counts > 0) & ~has).any():
        return acc[inside], np.concatenate([[0], np.cumsum(runs)])
    sizes = runs + lack
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(first[-1], np.uint64)
    slots = np.ones(first[-1], bool)
    slots[first[:-1][lack]] = False
    out[slots] = acc[inside]
    for i in np.flatnonzero(lack):
        own = w.hash[w.first[i] : w.first[i + 1]]
        with np.errstate(over="ignore"):
            out[first[i]] = mix(np.array([(own * _Q[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))[0]
    return out, first


def gather(table: np.ndarray, table_first: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates table[table_first[i]:table_first[i+1]] over ids; also the lengths."""
    sizes = (table_first[1:] - table_first[:-1])[ids]
    total = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(table_first[:-1][ids] - begin, sizes)
    return table[index], sizes
