"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text becomes words (runs of the space mark and what follows them, which no piece crosses). Words
that aren't known yet are put together by length, and all words of a length advance together: hashes of all their
substrings (from prefix sums) probe the sorted piece keys at once, and at each end a vectorised
maximum over the piece lengths keeps the best score and the backpointer. Ties go to the longer last piece, sums are 32-bit floats, and characters without a piece fall back to bytes, as
in the library's unigram search; the tests hold ids against it on the same pieces.

The model file given here was trained as BPE, and merge order isn't a maximum of summed scores: ids are
the best-scoring segmentation under the file's piece scores, which decodes to the same text but
isn't always what the library's BPE mode gives (see the README for the measured share). `also_merges`
adds exactly the latter: the same batches of words and hash probes, with merges in place of the search.

Cases: null and empty texts have no ids and decode to an empty text. A text with the space mark itself (U+2581) decodes with spaces
in its place and is marked as not exact. Repeated rows give repeated results. An empty table gives
none. Other columns are never read. Very long texts take time in proportion to their length; words of more than 96 characters are
segmented one by one, in n log n time.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import id_text, text_slices
from .wordcache import ChunkCache, ragged

MODEL = "piece_bpe_32k.model"
MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = range(1, 7)
_BASE = 0x9E3779B97F4A7C15
#: First bits of keys by which a table tells where their range of sorted keys starts, and the multiplier that spreads keys.
_BITS, _SPREAD = 18, np.uint64(0xD6E8FEB86659FD93)
#: Ways to segment: by the best sum of scores, or by the merge order of a BPE model.
BEST, MERGED = "best", "merged"
#: Substrings of words that are probed at once.
PROBED = 1 << 19
#: Bytes of text that are encoded together, so that lengths have many words.
TOGETHER = 3 << 19
#: Characters of a word beyond which it is segmented by itself: words of one length are then too few to advance together.
LONG = 96


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            x = b[at]
            at += 1
            out |= (x & 127) << shift
            shift += 7
            if x < 128:
                return out

    while at < len(b):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            n = number() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, b[at : at + n]
            at += n


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    dummy_prefix: bool = True

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds, prefix = [], [], [], True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, _NORMAL))
            elif number == 3:
                own = dict(_fields(value))
                prefix = bool(own.get(3, 1))
                if own.get(1, b"identity") != b"identity" or own.get(4, 1):
                    raise ValueError("only models without normalisation are supported")
        return cls(pieces, np.array(scores, np.float32), np.array(kinds), prefix)


class Encoder:
    """Segments texts in one or more ways at once."""

    def __init__(self, model: Model, ways: tuple[str, ...] = (BEST,)):
        self.model, self.ways = model, ways
        usable = [k for k, t in enumerate(model.kinds) if t in (_NORMAL, _USER)]
        if any(MARK in model.pieces[k].lstrip(MARK) for k in usable):
            raise ValueError("pieces that cross words are not supported")
        self.longest = max(len(model.pieces[k]) for k in usable)
        with np.errstate(over="ignore"):
            self.powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.longest, _BASE, np.uint64)])
            keys = np.array([self._key(model.pieces[k]) for k in usable], np.uint64) * _SPREAD
        order = np.argsort(keys)
        self.keys, self.of = keys[order], np.array(usable)[order]
        self.first = np.searchsorted(self.keys >> np.uint64(64 - _BITS), np.arange((1 << _BITS) + 1, dtype=np.uint64)).astype(np.int32)
        self.crowded = int(np.diff(self.first).max())
        score = model.scores.copy()
        user = model.kinds == _USER
        score[user] = [len(p) * model.scores[usable].max() - 0.1 for p, u in zip(model.pieces, user) if u]
        # With one more for place -1, where no piece was found.
        self.score = np.r_[score[self.of], np.float32(-np.inf)].astype(np.float32)
        self.of = np.r_[self.of, -1]
        self.known = {model.pieces[k]: (float(s), k) for s, k in zip(score[usable], usable)}
        self.unknown_score = np.float32(model.scores[usable].min() - 10)
        self.byte_ids = np.full(256, int(np.flatnonzero(model.kinds == _UNKNOWN)[0]))
        for k in np.flatnonzero(model.kinds == _BYTE):
            self.byte_ids[int(model.pieces[k][3:5], 16)] = k
        self.cache = ChunkCache(self.encode_words, len(ways), np.int32)

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + ord(c) + 1) & ((1 << 64) - 1)
        return h

    def encode_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each way, ids of distinct words (ranges of UTF-8 bytes, with spaces), joined, and how many each has."""
        raw = ragged(data, start, end - start)
        chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.where(chars == 0x20, np.uint32(ord(MARK)), chars)
        # Characters before each byte that starts one.
        heads = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        bounds = heads[np.r_[0, np.cumsum(end - start)]]
        length = np.diff(bounds)
        rows: list = []
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.ways]
        by_length = np.argsort(length, kind="stable")
        sizes, cuts = np.unique(length[by_length], return_index=True)
        for size, own in zip(sizes.tolist(), np.split(by_length, cuts[1:])):
            if size > LONG:
                for k in own:
                    rows.append([k])
                    for out, way in zip(found, self.ways):
                        out.append((self._search_long if way == BEST else self._merged_long)(chars[bounds[k] : bounds[k + 1]]))
                continue
            most = max(1, PROBED // (size * min(size, self.longest)))
            for part in np.split(own, range(most, len(own), most)):
                rows.append(part)
                words = chars[bounds[part][:, None] + np.arange(size)]
                pieces = self._pieces(words)
                for out, way in zip(found, self.ways):
                    out.append((self._search if way == BEST else self._merged)(words, pieces))
        order = np.argsort(np.concatenate(rows))
        done = []
        for out in found:
            ids, n = (np.concatenate(x) for x in zip(*out))
            done.append((ragged(ids, (np.cumsum(n) - n)[order], n[order]), n[order]))
        return done

    def _found(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys, or -1: its first bits say in which range of the sorted keys it would be."""
        with np.errstate(over="ignore"):
            h = h * _SPREAD
        part = (h >> np.uint64(64 - _BITS)).astype(np.int32)
        first, last = self.first[part], self.first[part + 1]
        out = np.full(h.shape, -1, np.int32)
        for k in range(self.crowded):
            maybe = np.nonzero(first + k < last)
            at = first[maybe] + k
            hit = self.keys[at] == h[maybe]
            out[tuple(x[hit] for x in maybe)] = at[hit]
        return out

    def _pieces(self, words: np.ndarray) -> np.ndarray:
        """Place among the keys of each word's substrings, or -1: [length - 1, start, word]."""
        n, length = words.shape
        sums = np.zeros((length + 1, n), np.uint64)
        out = np.full((min(self.longest, length), length, n), -1, np.int32)
        with np.errstate(over="ignore"):
            for k in range(length):
                sums[k + 1] = sums[k] * np.uint64(_BASE) + (words[:, k].astype(np.uint64) + np.uint64(1))
            for size in range(1, len(out) + 1):
                out[size - 1, : length - size + 1] = self._found(sums[size:] - sums[:-size] * self.powers[size])
        return out

    def _search(self, words: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentations of words of one length, a row of characters each."""
        n, length = words.shape
        best = np.full((length + 1, n), -np.inf, np.float32)
        best[0] = 0
        back = np.zeros((length + 1, n), np.int32)
        piece = np.full((length + 1, n), -1, np.int32)
        every = np.arange(n)
        for end in range(1, length + 1):
            sizes = np.arange(min(len(pieces), end), 0, -1)  # the longest first, as ties go to it
            at = pieces[sizes - 1, end - sizes]
            total = best[end - sizes] + self.score[at]
            top = total.argmax(0)
            score, chosen = total[top, every], at[top, every]
            unknown = best[end - 1] + self.unknown_score
            alone = (at[-1] < 0) & (unknown > score)
            best[end] = np.where(alone, unknown, score)
            back[end] = np.where(alone, 1, sizes[top])
            piece[end] = np.where(alone, -1, self.of[chosen])
        at, rows, steps = np.full(n, length), every, []
        while len(rows):
            steps.append((rows, piece[at[rows], rows], at[rows] - 1))
            at[rows] -= back[at[rows], rows]
            rows = rows[at[rows] > 0]
        rows, ids, places = (np.concatenate([s[k] for s in reversed(steps)]) for k in range(3))
        order = np.argsort(rows, kind="stable")
        return self._with_bytes(words, rows[order], ids[order], places[order])

    def _merged(self, words: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segmentations by merges: all words of a length merge their best pair of neighbours (the first of equals) until none has one."""
        n, length = words.shape
        most = len(pieces)

        def pairs(rows, start, middle, end) -> np.ndarray:
            """Score of the piece from start to end, -inf where there is none or the middle is no start of a second piece."""
            size = end - start
            at = pieces[np.minimum(size, most) - 1, np.minimum(start, length - 1), rows]
            return np.where((middle < length) & (size <= most) & (size > 0), self.score[at], np.float32(-np.inf))

        # Starts of the pieces of each word, then the word's end; and scores of all pairs of neighbours: a merge changes the two pairs that it touches.
        starts = np.tile(np.arange(length + 1), (n, 1))
        score = pairs(np.arange(n)[:, None], starts[:, :-2], starts[:, 1:-1], starts[:, 2:])
        rows = np.arange(n)
        while len(rows) and length > 1:
            best = score[rows].argmax(1)
            rows, best = rows[has := score[rows, best] > -np.inf], best[has]
            behind = np.arange(length) > best[:, None]
            starts[rows, :-1] = np.where(behind, starts[rows, 1:], starts[rows, :-1])
            score[rows, :-1] = np.where(behind[:, : length - 2], score[rows, 1:], score[rows, :-1])
            score[rows, -1] = -np.inf
            for k in (best - 1, best):
                ok = (k >= 0) & (k < length - 1)
                r, c = rows[ok], k[ok]
                score[r, c] = pairs(r, starts[r, c], starts[r, c + 1], starts[r, c + 2])
        row, place = np.nonzero(starts[:, :-1] < length)
        first, last = starts[row, place], starts[row, place + 1]
        return self._with_bytes(words, row, self.of[pieces[last - first - 1, first, row]], first)

    def _search_long(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same search for one long word: all places are probed at once for each piece length, then one pass goes over the pieces found."""
        length = len(chars)
        with np.errstate(over="ignore"):
            sums = np.zeros(length + 1, np.uint64)
            for k in range(0, length):
                sums[k + 1] = sums[k] * np.uint64(_BASE) + (chars[k].astype(np.uint64) + np.uint64(1))
            ends, sizes, places = [], [], []
            for size in range(min(self.longest, length), 0, -1):
                at = self._found(sums[size:] - sums[:-size] * self.powers[size])
                hit = np.flatnonzero(at >= 0)
                ends.append(hit + size)
                sizes.append(np.full(len(hit), size))
                places.append(at[hit])
        ends, sizes, places = (np.concatenate(x) for x in (ends, sizes, places))
        by = np.argsort(ends, kind="stable")  # the longest first, as ties go to it
        first = np.searchsorted(ends[by], np.arange(length + 2)).tolist()
        sizes, scores, pieces = sizes[by].tolist(), list(self.score[places[by]]), self.of[places[by]].tolist()
        best, back, piece = [np.float32(0)] + [np.float32(-np.inf)] * length, [0] * (length + 1), [-1] * (length + 1)
        for end in range(1, length + 1):
            top, single = np.float32(-np.inf), False
            for k in range(first[end], first[end + 1]):
                total = best[end - sizes[k]] + scores[k]
                single = sizes[k] == 1
                if total > top:
                    top, back[end], piece[end] = total, sizes[k], pieces[k]
            if not single and (total := best[end - 1] + self.unknown_score) > top:
                top, back[end], piece[end] = total, 1, -1
            best[end] = top
        ids, at, end = [], [], length
        while end:
            ids.append(piece[end])
            at.append(end - 1)
            end -= back[end]
        return self._with_bytes(chars[None], np.zeros(len(ids), np.int64), np.array(ids[::-1]), np.array(at[::-1]))

    def _merged_long(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same merges for one long word, with a heap of its pairs."""
        text, length, known = chars.tobytes().decode("utf-32-le", "surrogatepass"), len(chars), self.known
        after, before = list(range(1, length + 1)), list(range(-1, length - 1))  # the next piece's start (length at the end), and the last one's
        heap: list[tuple[float, int, int, int]] = []

        def push(first: int) -> None:
            if first >= 0 and (middle := after[first]) < length:
                end = after[middle]
                if end - first <= self.longest and (own := known.get(text[first:end])):
                    heapq.heappush(heap, (-own[0], first, middle, end))

        for k in range(length - 1):
            push(k)
        while heap:
            _, first, middle, end = heapq.heappop(heap)
            # Pieces that have changed since are no pair any more.
            if after[first] != middle or middle >= length or after[middle] != end:
                continue
            after[first], after[middle] = end, -1
            if end < length:
                before[end] = first
            push(first)
            push(before[first])
        ids, at, first = [], [], 0
        while first < length:
            own = known.get(text[first : after[first]])
            ids.append(own[1] if own else -1)
            at.append(first)
            first = after[first]
        return self._with_bytes(chars[None], np.zeros(len(ids), np.int64), np.array(ids), np.array(at))

    def _with_bytes(self, chars: np.ndarray, rows: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids by word and each word's number of them; a character without a piece (-1) becomes its bytes."""
        unknown = np.flatnonzero(ids < 0)
        if not len(unknown):
            return ids, np.bincount(rows, minlength=len(chars))
        coded = [chr(c).encode("utf-8", "surrogatepass") for c in chars[rows[unknown], places[unknown]]]
        width = np.ones(len(ids), np.int64)
        width[unknown] = [len(c) for c in coded]
        out = np.repeat(ids, width)
        out[np.repeat(ids < 0, width)] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        return out, np.bincount(rows, width, len(chars)).astype(np.int64)

    def _split(self, data: np.ndarray, bounds: np.ndarray) -> tuple:
        """Words of the texts that data holds: their hashes, the bytes and each one's bounds in them, and the first word of each text (with the end)."""
        if self.model.dummy_prefix:
            full = np.diff(bounds) > 0
            data = np.insert(data, bounds[:-1][full], 0x20)
            bounds = bounds + np.r_[0, np.cumsum(full)]
        space = data == 0x20
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        cut[1:-1] |= space[1:] & ~space[:-1]
        start = np.flatnonzero(cut[:-1])
        end = np.r_[start[1:], len(data)].astype(np.int64)
        return textvec.hashes(data, start, end), data, start, end, np.searchsorted(start, bounds)

    def slice(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each way, ids of the texts that data holds, joined, and each text's number of them."""
        if not len(data):
            return [(np.zeros(0, np.int32), np.zeros(len(bounds) - 1, np.int64)) for _ in self.ways]
        *words, first = self._split(data, bounds)
        return [(ids, np.diff(np.r_[0, np.cumsum(n)][first])) for ids, n in self.cache.ids(*words)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in the first way, joined, and each text's number of them."""
        own = [t.encode() for t in texts]
        return self.slice(np.frombuffer(b"".join(own), np.uint8), np.r_[0, np.cumsum([len(x) for x in own])].astype(np.int64))[0]


class Decoder:
    def __init__(self, model: Model):
        self.dummy_prefix = model.dummy_prefix
        data = [bytes([int(p[3:5], 16)]) if t == _BYTE else b"" if t == _CONTROL else p.replace(MARK, " ").encode() for p, t in zip(model.pieces, model.kinds)]
        self.length = np.array([len(d) for d in data], np.int64)
        self.start = np.r_[0, np.cumsum(self.length)[:-1]]
        self.flat = np.frombuffer(b"".join(data), np.uint8)

    def __call__(self, ids: np.ndarray) -> str:
        text = ragged(self.flat, self.start[ids], self.length[ids]).tobytes().decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def many(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of many texts, given where each one's ids end; and their bounds in them."""
        size = self.length[ids]
        data = ragged(self.flat, self.start[ids], size)
        bounds = np.r_[0, np.r_[0, np.cumsum(size)][ends]]
        if self.dummy_prefix:
            first = bounds[:-1][np.diff(bounds) > 0]
            gone = np.zeros(len(data) + 1, np.int64)
            gone[first[data[first] == 0x20]] = 1
            data = data[gone[:-1] == 0]
            bounds = bounds - np.r_[0, np.cumsum(gone)][bounds]
        return data, bounds


def _equal(a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray) -> np.ndarray:
    """Whether each text of a is that of b, byte by byte."""
    out = np.diff(a_bounds) == np.diff(b_bounds)
    if out.all():
        return np.diff(np.r_[0, np.cumsum(a != b)][a_bounds]) == 0
    for k in np.flatnonzero(out):
        out[k] = (a[a_bounds[k] : a_bounds[k + 1]] == b[b_bounds[k] : b_bounds[k + 1]]).all()
    return out


_made: dict[tuple, tuple[Encoder, Decoder]] = {}


def shared(path: str, ways: tuple[str, ...] = (BEST,)) -> tuple[Encoder, Decoder]:
    """One coder for all tasks that a Python worker runs, so that what it remembers serves them all."""
    if (path, ways) not in _made:
        model = Model.load(path)
        _made[path, ways] = Encoder(model, ways), Decoder(model)
    return _made[path, ways]


def _lists(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, also_merges: bool = False) -> DataFrame:
    """doc_id, ids, n_ids, n_byte_ids, decoded_chars, exact (the ids decode to the text): one row for each row of docs.

    also_merges adds merge_ids: what the model's merge order gives, as the library's BPE mode does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = model or public_tokenizers.path(MODEL)
        encode, decode = shared(path, (BEST, MERGED) if also_merges else (BEST,))
        loaded = encode.model
        byte = loaded.kinds == _BYTE
        for batch in batches:
            for part, data, bounds in text_slices(batch, most=TOGETHER):
                (ids, n), *others = encode.slice(data, bounds)
                ends = np.cumsum(n)
                decoded, cut = decode.many(ids, ends)
                heads = np.r_[0, np.cumsum((decoded & 0xC0) != 0x80)]
                bytes_before = np.r_[0, np.cumsum(byte[ids])]
                more = [_lists(*x) for x in others]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), _lists(ids, n), pa.array(n), pa.array(bytes_before[ends] - bytes_before[ends - n]),
                        pa.array(np.diff(heads[cut])), pa.array(_equal(decoded, cut, data, bounds)), *more,
                    ],
                    ["doc_id", "ids", "n_ids", "n_byte_ids", "decoded_chars", "exact", *["merge_ids"] * len(more)],
                )

    return id_text(docs, id_col, text_col).select("doc_id", F.col("text")).mapInArrow(
        run, "doc_id long, ids array<int>, n_ids long, n_byte_ids long, decoded_chars long, exact boolean" + ", merge_ids array<int>" * also_merges
    )


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str | None = None) -> DataFrame:
    """rows with the texts of their ids; null ids give a null text, ids outside the vocabulary are an error."""
    names = rows.columns
    at = names.index(ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text_col)
    keep = [k for k, c in enumerate(names) if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        _, own = shared(model or public_tokenizers.path(MODEL))
        for batch in batches:
            texts = [None if x is None else own(np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())], [*(names[k] for k in keep), text_col])

    return rows.mapInArrow(run, f"{schema}, `{text_col}` string")
