"""Encodes texts chunk by chunk, each distinct chunk once.

Both tokenizers split a text at places that depend only on the characters
around them, so a text's ids are the ids of its chunks one after another.
Chunks are found, hashed and looked up for a whole block of texts with numpy;
only chunks not seen of late become strings and go to the tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .textarrays import BLOCK, gather, hashes, lanes, mix

#: From strings to their ids one after another, and where each one's begin.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class ChunkCache:
    """Ids of chunks, found by the chunk's 64-bit hash and confirmed by its bytes.

    A chunk whose hash another one bears goes by the next hash of its own.  The
    cache is emptied when it holds ``remembered`` chunks, so its memory is
    bounded; what is emptied is encoded again when it returns.
    """

    def __init__(self, encode: Encode, remembered: int = 400_000):
        self.encode_strings, self.remembered = encode, remembered
        self._clear()

    def _clear(self):
        self.bits, self.n = 17, 0
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.ids, self.n_ids = np.empty(1 << 17, np.int32), 0
        self.first = np.zeros(1 << 17, np.int64)
        self.lanes, self.lane_first = np.empty(1 << 17, np.uint64), np.zeros(1 << 17, np.int64)
        self.size = np.zeros(1 << 17, np.int32)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Number of each chunk, -1 if it isn't held."""
        out = np.full(len(key), -1, np.int32)
        todo, spot = np.arange(len(key)), (key >> np.uint64(64 - self.bits)).astype(np.int64)
        mask = (1 << self.bits) - 1
        while len(todo):
            at = self.slot[spot]
            same = (self.keys[spot] == key[todo]) & (at >= 0)
            out[todo[same]] = at[same]
            on = (at >= 0) & ~same
            todo, spot = todo[on], (spot[on] + 1) & mask
        return out

    def _place(self, key: np.ndarray, number: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        spot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(key):
            free = np.flatnonzero(self.slot[spot] < 0)
            self.slot[spot[free]] = number[free]  # of several for one place the last stays
            self.keys[spot[free]] = key[free]
            left = self.slot[spot] != number
            self_keys = self.keys[spot[~left]] != key[~left]
            assert not self_keys.any()
            key, number, spot = key[left], number[left], (spot[left] + 1) & mask

    def _add(self, keys: np.ndarray, strings: list[str], values: np.ndarray, counts: np.ndarray, size: np.ndarray) -> None:
        ids, first = self.encode_strings(strings)
        n, m = self.n, int(self.lane_first[self.n])
        self.ids = _room(self.ids, self.n_ids + len(ids))
        self.lanes = _room(self.lanes, m + len(values))
        self.first, self.lane_first, self.size = (_room(x, n + len(strings) + 1) for x in (self.first, self.lane_first, self.size))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.first[n + 1 : n + 1 + len(strings)] = first[1:] + self.n_ids
        self.lanes[m : m + len(values)] = values
        self.lane_first[n + 1 : n + 1 + len(strings)] = np.cumsum(counts) + m
        self.size[n : n + len(strings)] = size
        number = np.arange(n, n + len(strings), dtype=np.int32)
        self.n, self.n_ids = n + len(strings), self.n_ids + len(ids)
        if 2 * self.n > len(self.slot):
            held = self.slot >= 0
            keys, number = np.concatenate([self.keys[held], keys]), np.concatenate([self.slot[held], number])
            while 2 * self.n > 1 << self.bits:
                self.bits += 1
            self.keys, self.slot = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self._place(keys, number)

    def _same(self, number: np.ndarray, values: np.ndarray, counts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each chunk has the bytes of the numbered one."""
        out = self.size[number] == size
        held, _ = gather(self.lanes, self.lane_first[: self.n + 1], number[out])
        own = values if out.all() else values[np.repeat(out, counts)]
        differ = held != own
        if differ.any():
            first = np.cumsum(counts[out]) - counts[out]
            out[np.flatnonzero(out)[np.logical_or.reduceat(differ, first)]] = False
        return out

    def _numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each chunk; those not held are encoded."""
        out = np.empty(len(start), np.int64)
        values, first = lanes(data, start, end)
        counts, size = np.diff(first), end - start
        key, todo, raw = hashes(values, first, size), np.arange(len(start)), None
        while True:
            number = self._find(key).astype(np.int64)
            if len(miss := np.flatnonzero(number < 0)):
                keys, one, back = np.unique(key[miss], return_index=True, return_inverse=True)
                one = miss[one]
                raw = raw or data.tobytes()
                base = self.n
                taken, n_lanes = gather(values, np.concatenate([[0], np.cumsum(counts)]), one)
                self._add(keys, [raw[a:b].decode() for a, b in zip(start[todo[one]].tolist(), end[todo[one]].tolist(), strict=True)], taken, n_lanes, size[one])
                number[miss] = base + back
            same = self._same(number, values, counts, size)
            out[todo[same]] = number[same]
            if same.all():
                return out
            clash = ~same
            todo, key, values = todo[clash], mix(key[clash] + np.uint64(1)), values[np.repeat(clash, counts)]
            counts, size = counts[clash], size[clash]

    def encode(self, data: np.ndarray, offsets: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, and where each text's begin (one entry more).

        begins: marks the bytes at which a chunk begins; a text's first byte begins one anyhow.
        """
        if self.n > self.remembered:
            self._clear()
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[heads] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        numbers, at = [], 0
        while at < len(start):  # pieces of whole chunks, so that a very long text needs no more memory
            to = max(at + 1, int(np.searchsorted(start, start[at] + 2 * BLOCK)))
            a, b = start[at], end[to - 1]
            numbers.append(self._numbers(data[a:b], start[at:to] - a, end[at:to] - a))
            at = to
        ids, sizes = gather(self.ids, self.first[: self.n + 1], np.concatenate(numbers))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, ends[np.searchsorted(start, offsets)]


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """The array, doubled until it has n places; new ones are zero."""
    while len(x) < n:
        x = np.concatenate([x, np.zeros_like(x)])
    return x
