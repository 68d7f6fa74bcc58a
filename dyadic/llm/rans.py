"""Token ids in blocks coded by a static range asymmetric numeral system (rANS).

Frequencies: one table, shared by all blocks, is counted over the whole corpus and scaled to
2^SCALE (more, if the ids need it); it has a row for each id of the vocabulary at most. A block holds whole documents, about BLOCK ids, as
`lanes` interleaved coders: id k belongs to lane k mod lanes, and all lanes advance together as
numpy vectors. A coder's state is 64 bits wide and gives off 32-bit words. A block
starts with its lengths, states and a checksum of its ids, and every STEP ids a checkpoint keeps
the word position and the states, so that the sections between checkpoints are decoded side by side.

File format: `<path>/table` (id, frequency) and `<path>/blocks`, one row a block: part and seq (in
this order, documents ascend by doc_id), doc_ids, lengths, before (ids of the part that precede) and
the coded bytes. Parts are range partitions, so blocks are written and read in parallel.

Cases: null and empty texts are the end id alone. Null doc_ids come first; repeated rows follow each
other. A file of an empty table has no blocks. Other columns are never read. A very long text is
tokenised whole and lies in one block of its own length, so memory is in proportion to it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec
from .common import id_text, remove, scratch_path, text_slices, written
from .wordcache import ChunkCache, ragged

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
SCALE, LANES, BLOCK, STEP = 20, 2048, 1 << 20, 1 << 18
_LOW = np.uint64(1 << 31)  # least state
_MAGIC = b"RNS1"


# --- tokens -------------------------------------------------------------------------------------

_b = np.arange(256)
_WHITE = np.isin(_b, [0x20, 0x0A, 0x0D, 0x09])
_LETTER = ((_b | 32) >= 97) & ((_b | 32) <= 122)
#: ASCII characters that are neither letters nor white space.
_OTHER = (_b < 128) & ~_LETTER & ~_WHITE
_CONTROL = np.isin(_b, [0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F])


#: Bytes that rare white space, or what only looks like it, starts with.
_SUSPECT = _CONTROL | np.isin(_b, [0xC2, 0xE1, 0xE2, 0xE3, 0xEF])


def _rare(data: np.ndarray) -> np.ndarray:
    """Places of white space other than space, line feed, carriage return and tab (and of some characters that only look like it)."""
    at = np.flatnonzero(_SUSPECT[data])
    a, b, c = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
    rare = _CONTROL[a] | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)))
    rare |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)))) | (b == 0x81))
    rare |= ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xEF) & (b == 0xBB))
    return at[rare]


def _chunks(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of chunks: where white space follows something else, and where an ASCII non-letter follows a letter."""
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    if len(data) > 1:
        white = _WHITE[data]
        letter = _LETTER[data]
        # Second bytes of Latin-1 letters, but for the signs of multiplication and division.
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        letter[at[(data[at] != 0x97) & (data[at] != 0xB7)]] = True
        cut[1:-1] |= (white[1:] & ~white[:-1]) | (letter[:-1] & _OTHER[data[1:]])
    return np.flatnonzero(cut[:-1])


class Encoder:
    """Ids of whole texts. The tokenizer splits before any white space that follows something else, and between a letter and what isn't one, so chunks cut there are encoded apart and remembered.

    Unknown chunks are encoded as one text; ids' lengths in bytes tell where each chunk ends. Texts with rare white space or an added token are encoded whole.
    """

    _made: dict = {}

    def __init__(self, tokenizer: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer or public_tokenizers.path(TOKENIZER))
        own = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = [t.encode() for t in own]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, k in vocabulary.items():
            # The byte-level alphabet has one character for each byte.
            self.bytes[k] = len(piece.encode()) if piece in own else len(piece)
        self.cache = ChunkCache(self._encode)

    @classmethod
    def shared(cls, tokenizer: str | None = None) -> Encoder:
        """One encoder for all tasks that a Python worker runs, so that what it remembers serves them all."""
        if tokenizer not in cls._made:
            cls._made[tokenizer] = cls(tokenizer)
        return cls._made[tokenizer]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        # A chunk that starts without white space can't follow another one; nor can anything follow a chunk of white space alone.
        joined = _WHITE[data[start]] & ~_WHITE[data[end - 1]]
        n = np.zeros(len(start), np.int64)
        size = (end - start)[joined]
        ids = self._ids(ragged(data, start[joined], size).tobytes().decode()) if len(size) else np.zeros(0, np.uint32)
        cut = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(size), "right")
        n[joined] = np.diff(np.r_[0, cut])
        if joined.all():
            return [(ids, n)]
        apart = np.flatnonzero(~joined)
        found = self.tokenizer.encode_batch_fast([data[start[k] : end[k]].tobytes().decode() for k in apart], add_special_tokens=False)
        own = [e.ids for e in found]
        n[apart] = [len(x) for x in own]
        flat = np.concatenate([ids, np.fromiter((i for x in own for i in x), np.uint32)])
        # Joined chunks stand first, then those that were encoded apart.
        order = np.r_[np.flatnonzero(joined), apart]
        begin = np.empty(len(n), np.int64)
        begin[order] = np.cumsum(n[order]) - n[order]
        return [(ragged(flat, begin, n), n)]

    def _added_in(self, data: np.ndarray) -> np.ndarray:
        """Places where an added token starts."""
        out, raw = [], data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                out.append(at)
                at = raw.find(token, at + 1)
        return np.array(out, np.int64)

    def slice(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that data holds, joined, and each text's number of them."""
        start = _chunks(data, bounds)
        end = np.r_[start[1:], len(data)].astype(np.int64)
        rare = np.unique(np.searchsorted(bounds, np.r_[_rare(data), self._added_in(data)], "right") - 1)
        first = np.searchsorted(start, bounds)
        if len(rare):
            odd = np.zeros(len(bounds) - 1, bool)
            odd[rare] = True
            keep = ~odd[np.searchsorted(bounds, start, "right") - 1]
            start, end = start[keep], end[keep]
            first = np.searchsorted(start, bounds)
        ids, n = self.cache.ids(textvec.hashes(data, start, end), data, start, end)[0] if len(start) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        ends = np.r_[0, np.cumsum(n)][first]
        if not len(rare):
            return ids, np.diff(ends)
        parts = [ids[i:j] for i, j in zip(ends, ends[1:])]
        for k in rare:
            parts[k] = self._ids(data[bounds[k] : bounds[k + 1]].tobytes().decode())
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_RAW = "part int, seq int, doc_ids array<long>, lengths array<long>, before long, n long, ids binary"
_RAW_TYPES = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
_RAW_NAMES = ["part", "seq", "doc_ids", "lengths", "before", "n", "ids"]


def tokenized(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Blocks of whole documents in ascending order of ids, each text with the end id after it. ids: little-endian, 16 bits each if all are below 2^16, else 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(tokenizer)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, own, n = [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal seq, before, doc_ids, lengths, own, n
            ids = np.concatenate(own)
            packed = (b"\x02" + ids.astype("<u2").tobytes()) if ids.max() < 1 << 16 else (b"\x04" + ids.astype("<u4").tobytes())
            row = (part, seq, pa.concat_arrays(doc_ids).to_pylist(), np.concatenate(lengths), before, n, packed)
            seq, before, doc_ids, lengths, own, n = seq + 1, before + n, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, _RAW_TYPES)], _RAW_NAMES)

        for batch in batches:
            for rows, data, bounds in text_slices(batch):
                ids, size = encoder.slice(data, bounds)
                # The end id goes behind each text.
                own.append(np.insert(ids, np.cumsum(size), end_id))
                doc_ids.append(rows.column(0))
                lengths.append(size + 1)
                n += len(own[-1])
                if n >= BLOCK:
                    yield block()
        if doc_ids:
            yield block()

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The hash of the text parts rows without an id, and rows that repeat one.
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    ordered = docs.withColumn("hash", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    return ordered.mapInArrow(run, _RAW)


def _unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, f"<u{ids[0]}", offset=1).astype(np.uint32)


def token_counts(blocks: DataFrame) -> DataFrame:
    """id, n: how often each id occurs in all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                own = np.bincount(_unpacked(ids.as_py()))
                if len(own) > len(n):
                    n = np.concatenate([n, np.zeros(len(own) - len(n), np.int64)])
                n[: len(own)] += own
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], ["id", "n"])

    return blocks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# --- coder --------------------------------------------------------------------------------------


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to a sum of 2^scale, with one at least for each that isn't zero; a larger power of two where there are more than 2^(scale - 2) ids."""
    if not (total := int(counts.sum())):
        return counts.astype(np.int64)
    scale = max(scale, int((counts > 0).sum() - 1).bit_length() + 2)
    out = np.where(counts > 0, np.maximum(1, counts.astype(float) * (1 << scale) / total).astype(np.int64), 0)
    rest = (1 << scale) - int(out.sum())
    for k in np.argsort(-out, kind="stable"):
        if rest == 0:
            break
        give = rest if rest > 0 else max(rest, 1 - int(out[k]))
        out[k] += give
        rest -= give
    return out


class Coder:
    """ids: ascending, each with its frequency; frequencies sum to a power of two."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.scale = ids.astype(np.uint32), np.uint64(max(int(freq.sum()) - 1, 0).bit_length())
        self.freq = freq.astype(np.uint64)
        self.low = np.r_[0, np.cumsum(freq)[:-1]].astype(np.uint64) if len(freq) else freq.astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(ids), dtype=np.uint32), freq)
        self.place = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
        self.place[ids] = np.arange(len(ids))

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = int(min(LANES, max(1, n // 256)))
        symbols = self.place[ids]
        x = np.full(lanes, _LOW, np.uint64)
        words, marks, count = [], [], 0
        steps = -(-n // lanes)
        every = max(1, STEP // lanes)
        for k in range(steps - 1, -1, -1):
            s = symbols[k * lanes : (k + 1) * lanes]
            own = x[: len(s)]
            f = self.freq[s]
            full = own >= f << (np.uint64(63) - self.scale)
            if full.any():
                words.append(own[full].astype(np.uint32))
                count += len(words[-1])
                own = np.where(full, own >> np.uint64(32), own)
            q = own // f
            x[: len(s)] = (q << self.scale) + (own - q * f) + self.low[s]
            if k and k % every == 0:
                marks.append((k, count, x.copy()))
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        head = struct.pack("<4sIIIII", _MAGIC, n, lanes, len(stream), len(marks), zlib.crc32(ids.astype("<u4").tobytes()))
        body = [head, x.tobytes()]
        for k, upto, states in reversed(marks):
            body += [struct.pack("<II", k, count - upto), states.tobytes()]
        return b"".join([*body, stream.tobytes()])

    def _open(self, block: bytes):
        magic, n, lanes, words, marks, crc = struct.unpack_from("<4sIIIII", block)
        if magic != _MAGIC:
            raise ValueError("not a block of token ids")
        at, entry = 24, lanes * 8
        points = [(0, 0, np.frombuffer(block, np.uint64, lanes, at))]
        at += entry
        for _ in range(marks):
            points.append((*struct.unpack_from("<II", block, at), np.frombuffer(block, np.uint64, lanes, at + 8)))
            at += 8 + entry
        return n, lanes, crc, points, np.frombuffer(block, np.uint32, words, at)

    def sections(self, block: bytes) -> int:
        return len(self._open(block)[3])

    def section(self, block: bytes, number: int) -> np.ndarray:
        """Ids from a checkpoint to the next one; sections can be decoded in any order and place."""
        n, lanes, _, points, words = self._open(block)
        last = points[number + 1][0] if number + 1 < len(points) else -(-n // lanes)
        return self._decode(n, lanes, points[number], last, words)[0]

    def _decode(self, n: int, lanes: int, point: tuple, last: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the steps from a checkpoint up to `last`, and the states after them."""
        step, at, x = point[0], point[1], point[2].copy()
        out = np.empty(min(n, last * lanes) - step * lanes, np.uint32)
        mask = np.uint64((1 << int(self.scale)) - 1)
        done = 0
        for k in range(step, last):
            own = x[: min(lanes, n - k * lanes)]
            slot = own & mask
            s = self.symbol[slot.astype(np.int64)]
            out[done : done + len(s)] = s
            done += len(s)
            own = self.freq[s] * (own >> self.scale) + slot - self.low[s]
            short = np.flatnonzero(own < _LOW)
            if len(short):
                # Within a step, words are in the order of their lanes.
                own[short] = (own[short] << np.uint64(32)) | words[at : at + len(short)]
                at += len(short)
            x[: len(own)] = own
        return self.ids[out], x

    def _sections(self, lanes: int, points: list, words: np.ndarray) -> np.ndarray:
        """Ids of all sections but the last, which have the same number of steps: they advance together."""
        steps = points[1][0]
        x = np.stack([p[2] for p in points[:-1]])
        at = np.array([p[1] for p in points[:-1]])[:, None]
        out = np.empty((len(x), steps, lanes), np.uint32)
        mask = np.uint64((1 << int(self.scale)) - 1)
        for k in range(steps):
            slot = x & mask
            out[:, k] = s = self.symbol[slot.astype(np.int64)]
            x = self.freq[s] * (x >> self.scale) + slot - self.low[s]
            short = x < _LOW
            # Within a step of a section, words are in the order of its lanes.
            rank = np.cumsum(short, axis=1)
            x[short] = (x[short] << np.uint64(32)) | words[(at + rank - 1)[short]]
            at = at + rank[:, -1:]
        return self.ids[out.ravel()]

    def decode(self, block: bytes) -> np.ndarray:
        n, lanes, crc, points, words = self._open(block)
        ids, states = self._decode(n, lanes, points[-1], -(-n // lanes), words)
        if len(points) > 1:
            ids = np.concatenate([self._sections(lanes, points, words), ids])
        # A whole block ends in the states that its encoding started from.
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc or (states != _LOW).any():
            raise ValueError("checksum of a block of token ids doesn't match")
        return ids


# --- files --------------------------------------------------------------------------------------

_BLOCKS = "part int, seq int, doc_ids array<long>, lengths array<long>, before long, n long, coded binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, with the end id after it, in ascending order of ids, as files under path."""
    spark = docs.sparkSession
    raw, raw_path = written(tokenized(id_text(docs, id_col, text_col), tokenizer, end_id), "ids")
    counts = token_counts(raw).orderBy("id").toPandas()  # a row for each id of the vocabulary at most
    ids, freq = counts["id"].to_numpy(np.int64), frequencies(counts["n"].to_numpy(np.int64))
    spark.createDataFrame([(int(i), int(f)) for i, f in zip(ids, freq)], "id long, frequency long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((ids, freq))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                coded = coder.encode(_unpacked(row.column(6)[0].as_py()))
                yield pa.RecordBatch.from_arrays([*row.columns[:6], pa.array([coded], pa.binary())], [*_RAW_NAMES[:6], "coded"])

    raw.mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    remove(spark, raw_path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (packed little-endian 32-bit): the documents of the files, each block decoded by itself."""
    return _decoded(spark, path, "ids binary", lambda ids: pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), "ids")


def _decoded(spark: SparkSession, path: str, column: str, made, name: str) -> DataFrame:
    table = spark.read.parquet(f"{path}/table").orderBy("id").toPandas()
    shared = spark.sparkContext.broadcast((table["id"].to_numpy(np.int64), table["frequency"].to_numpy(np.int64)))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    # One row for each part of the file.
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    first = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    rows = blocks.join(F.broadcast(first), "part").select("doc_ids", "lengths", (F.col("first") + F.col("before")).alias("before"), "coded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, lengths, before, coded = (batch.column(c)[k] for c in range(4))
                lengths = lengths.values.to_numpy()
                ends = np.cumsum(lengths)
                ids = np.split(coder.decode(coded.as_py()), ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(before.as_py() + ends - lengths), pa.array(lengths), made(ids)], ["doc_id", "start", "n_tokens", name]
                )

    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents, from files written for the purpose."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, id_col=id_col, text_col=text_col)
    crc = lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
    return _decoded(docs.sparkSession, path, "ids_crc32 long", crc, "ids_crc32")
