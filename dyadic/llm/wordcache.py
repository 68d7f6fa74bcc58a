"""Ids of repeated chunks of text, found by their hashes in flat numpy arrays and compared byte by byte."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import textvec

#: Bits of the number of slots; a slot holds the chunk that was put there last.
SLOTS = 20
#: Bytes of a chunk that a slot holds, in words of eight; longer chunks are encoded each time.
WORDS = 3
#: Ids that a cache stores before it starts anew, so memory stays bounded.
STORED = 6_000_000


def ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start[k] : start[k] + length[k]] for all k, joined."""
    if not len(length):
        return flat[:0]
    shift = np.repeat(start - (np.cumsum(length) - length), length)
    return flat[np.arange(len(shift)) + shift]


def _distinct(h: np.ndarray, bytes_: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct chunk, and for each row its chunk among these; rows of one hash with other bytes stand alone."""
    _, first, place = np.unique(h, return_index=True, return_inverse=True)
    odd = np.flatnonzero((size != size[first[place]]) | (bytes_ != bytes_[first[place]]).any(1))
    if len(odd):
        place[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])
    return first, place


#: Encodes distinct ranges of bytes (data, start, end): for each way of encoding, their ids, joined, and how many each has.
Encode = Callable[[np.ndarray, np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]


class ChunkCache:
    """What `encode` gives for chunks, in one or more ways at once."""

    def __init__(self, encode: Encode, ways: int = 1, dtype=np.uint32):
        self.encode = encode
        # A chunk has two slots: it takes the second one if another chunk has the first.
        self.bytes = [np.zeros(1 << SLOTS, np.uint64) for _ in range(WORDS)]
        self.size = np.zeros(1 << SLOTS, np.uint8)  # in bytes; 0 in empty slots
        self.start = [np.zeros(1 << SLOTS, np.int32) for _ in range(ways)]
        self.length = [np.zeros(1 << SLOTS, np.int32) for _ in range(ways)]
        self.flat = [np.zeros(1 << 20, dtype) for _ in range(ways)]
        self.used = [0] * ways

    def _holds(self, slot: np.ndarray, own: list[np.ndarray], size: np.ndarray, long: list[np.ndarray]) -> np.ndarray:
        """Whether slots hold chunks; `long` tells which chunks have bytes in each further word."""
        known = (self.bytes[0][slot] == own[0]) & (self.size[slot] == size)
        for k, at in enumerate(long, 1):
            known[at] &= self.bytes[k][slot[at]] == own[k]
        return known

    def ids(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each way, all ids of the chunks (ranges of data with hashes h, none empty) in order, and each chunk's number of them."""
        size, view = end - start, textvec.eights(data)
        own, long = [textvec.piece(view, start, size, 0)], []
        for k in range(1, WORDS):
            long.append(np.flatnonzero(size > 8 * k))
            own.append(textvec.piece(view, start[long[-1]], size[long[-1]], 8 * k))
        slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        known = self._holds(slot, own, size, long)
        missed = np.flatnonzero(~known)
        if not len(missed):
            return [self._out(w, self.start[w][slot], self.length[w][slot]) for w in range(len(self.flat))]
        # What isn't in its first slot may be in its second one.
        full = np.zeros((WORDS, len(h)), np.uint64)
        full[0] = own[0]
        for k, at in enumerate(long, 1):
            full[k, at] = own[k]
        second = (h[missed] >> np.uint64(44 - SLOTS)).astype(np.int64) & ((1 << SLOTS) - 1)
        there = self._holds(second, [full[k][missed] for k in range(WORDS)], size[missed], [np.arange(len(missed))] * (WORDS - 1))
        slot[missed[there]] = second[there]
        missed, second = missed[~there], second[~there]
        short, beyond = missed[size[missed] <= 8 * WORDS], missed[size[missed] > 8 * WORDS]
        first, place = _distinct(h[short], full[:, short].T, size[short])
        new = short[first]
        out, one = [], np.concatenate([new, beyond])
        begins, counts = [], []
        for w, (ids, n) in enumerate(self.encode(data, start[one], end[one]) if len(one) else []):
            begin = self._store(w, ids) + np.cumsum(n) - n
            at, length = self.start[w][slot].astype(np.int64), self.length[w][slot].astype(np.int64)
            at[short], length[short] = begin[: len(new)][place], n[: len(new)][place]
            at[beyond], length[beyond] = begin[len(new) :], n[len(new) :]
            out.append(self._out(w, at, length))
            begins.append(begin)
            counts.append(n)
        if not len(one):
            return [self._out(w, self.start[w][slot], self.length[w][slot]) for w in range(len(self.flat))]
        if max(self.used) > STORED:
            self.size[:] = 0
            self.used = [0] * len(self.flat)
            self.flat = [f[:STORED].copy() for f in self.flat]
            return out
        put = slot[new]
        taken = self.size[put] > 0
        put[taken] = second[size[missed] <= 8 * WORDS][first][taken]
        put, last = np.unique(put, return_index=True)
        new, begins, counts = new[last], [b[: len(new)][last] for b in begins], [n[: len(new)][last] for n in counts]
        self.size[put] = size[new]
        for k in range(WORDS):
            self.bytes[k][put] = full[k, new]
        for w, (begin, n) in enumerate(zip(begins, counts)):
            self.start[w][put], self.length[w][put] = begin, n
        return out

    def _out(self, way: int, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = length.astype(np.int64)
        return ragged(self.flat[way], at.astype(np.int64), length), length

    def _store(self, way: int, ids: np.ndarray) -> int:
        base, flat = self.used[way], self.flat[way]
        if base + len(ids) > len(flat):
            flat = self.flat[way] = np.concatenate([flat[:base], np.zeros(max(len(ids), len(flat)), flat.dtype)])
        flat[base : base + len(ids)] = ids
        self.used[way] += len(ids)
        return base
