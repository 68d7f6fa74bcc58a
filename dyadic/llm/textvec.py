"""Words of many texts at once, as numpy arrays over UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, the white space of `[^\\x20\\x09-\\x0D]+`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

from .common import mix

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Ranges of more bytes are hashed one by one.
LONG = 64
_G, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


@dataclass
class Words:
    """Bounds in bytes of each word, and the index of each text's first word (with the end)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, bounds: np.ndarray) -> Words:
    solid = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | cut[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | cut[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(start, end, np.searchsorted(start, bounds))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes (zeros after the end) from each place on, as little-endian integers."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def piece(view: np.ndarray, start: np.ndarray, length: np.ndarray, at: int) -> np.ndarray:
    """Bytes at to at + 8 of ranges that have more than `at` bytes."""
    return view[start + at] & _LOW_BYTES[np.minimum(length - at, 8)]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes; it depends on these bytes alone. Eight bytes at a time pass a mixer that isn't linear, so ranges of
    one length up to eight never collide, and for longer ones no rule builds collisions."""
    view, length = eights(data), end - start
    with np.errstate(over="ignore"):
        out = mix(piece(view, start, length, 0) + length.astype(np.uint64) * _G)
        rest, at = np.flatnonzero((length > 8) & (length <= LONG)), 8
        while len(rest):
            out[rest] = mix(out[rest] * _SPREAD + piece(view, start[rest], length[rest], at))
            at += 8
            rest = rest[length[rest] > at]
    for k in np.flatnonzero(length > LONG):
        out[k] = xxhash.xxh3_64_intdigest(np.ascontiguousarray(data[start[k] : end[k]]))
    return out


def ascending(keys: np.ndarray) -> np.ndarray:
    """Stable argsort of 64-bit hashes: high bits and places are sorted as one integer, many times faster than an argsort; where low bits decide, that takes over."""
    bits = np.uint64(max(1, int(len(keys) - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    found = keys[order]
    return np.argsort(keys, kind="stable") if (found[1:] < found[:-1]).any() else order


def starts_of_runs(ordered: np.ndarray) -> np.ndarray:
    """Whether each of ascending values differs from the one before."""
    out = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=out[1:])
    return out


def windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each window of `width` words that lies in one text, and the index of its first word."""
    at = np.arange(len(h) - width + 1 if len(h) >= width else 0)
    if len(at):
        end = np.repeat(first[1:], np.diff(first))
        at = at[at + width <= end[at]]
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mix(out * _SPREAD + h[at + k])
    return out, at
