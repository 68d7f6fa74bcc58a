"""Stupid-backoff scores from n-gram counts of the whole corpus, with each document's own counts left out.

A document's score is the mean over its words of log S(word | words before it, up to ORDER - 1), where S
is count(n-gram) / count(its context) if the n-gram occurs in another document, else BACKOFF times S
with one word of context less; a word that no other document has counts as one in (words of
the others + 1). Words are runs of non-white space, n-grams never leave a document, and without leaving own counts
out every n-gram would have been seen.

Plan: documents are packed into blocks of some MB. Each block explodes its texts into n-grams and counts them
before anything is shuffled, so an n-gram of a third of all words costs a block one entry. Entries
are dealt to buckets by the n-gram's hash: a bucket holds its part of the count tables, of bounded
size, joins each block's n-grams to the sums, and answers with the counts in the block's
order. Blocks then meet their answers by block id and sum per document.

Cases: null and empty texts have no words, and null scores. Rows with a null doc_id are scored like
others. Repeated rows are documents of their own. An empty table gives no rows. Other columns are
never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import id_text, text_slices, written

ORDER, BACKOFF = 2, 0.4
#: Bytes of text in a block (a longer text is a block alone), and n-gram entries in a bucket.
BLOCK, BUCKET = 4 << 20, 2_000_000


def _pack(x: np.ndarray) -> bytes:
    """Integers by planes of bytes, so that the empty high planes vanish."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize)
    return x.dtype.str.encode() + zstandard.ZstdCompressor(1).compress(raw.T.tobytes())


def _unpack(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:3].decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[3:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def _small(n: np.ndarray) -> np.ndarray:
    return n.astype(np.uint8 if not len(n) or n.max() < 256 else np.uint32 if n.max() < 1 << 32 else np.uint64)


def _grams(data: np.ndarray, bounds: np.ndarray, order: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], textvec.Words]:
    """(hash, place of the first word) of all n-grams of each order from 1 on."""
    w = textvec.words(data, bounds)
    h = textvec.hashes(data, w.start, w.end)
    out = []
    for k in range(1, order + 1):
        key, at = textvec.windows(h, w.first, k)
        with np.errstate(over="ignore"):
            out.append((textvec.mix(key + np.uint64(k)), at))
    return out, w


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order of hashes; where a new hash starts in this order; the distinct ones, ascending."""
    order = textvec.ascending(keys)
    ordered = keys[order]
    new = textvec.starts_of_runs(ordered)
    return order, new, ordered[new]


def _lengths(new: np.ndarray) -> np.ndarray:
    """Lengths of the runs that start where `new` says."""
    return np.diff(np.flatnonzero(np.r_[new, True]))


def _blocks(docs: DataFrame) -> DataFrame:
    """block, doc_ids, sizes, words (their number), text (compressed): whole documents packed together where they were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, part, ids, sizes, words, texts = 0, TaskContext.get().partitionId(), [], [], 0, []

        def block() -> pa.RecordBatch:
            nonlocal seq, ids, sizes, words, texts
            text = b"".join(texts)
            row = [(part << 32) + seq, ids, sizes, words, zstandard.ZstdCompressor(1).compress(text)]
            seq, ids, sizes, words, texts = seq + 1, [], [], 0, []
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], ["block", "doc_ids", "sizes", "words", "text"])

        held = 0
        for batch in batches:
            for rows, data, bounds in text_slices(batch):
                if texts and held + len(data) > BLOCK:
                    yield block()
                    held = 0
                ids += rows.column(0).to_pylist()
                sizes += np.diff(bounds).tolist()
                words += len(textvec.words(data, bounds).start)
                texts.append(data.tobytes())
                held += len(data)
        if texts:
            yield block()

    return docs.mapInArrow(run, "block long, doc_ids array<long>, sizes array<long>, words long, text binary")


def _opened(sizes, text) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text.as_py()), np.uint8)
    return data, np.r_[0, np.cumsum(sizes.values.to_numpy())].astype(np.int64)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys start in ascending keys: buckets are equal ranges of hashes."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.r_[np.searchsorted(keys, edges), len(keys)]


def _entries(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data, bounds = _opened(batch.column(1)[k], batch.column(2)[k])
                _, new, keys = _distinct(np.concatenate([k for k, _ in _grams(data, bounds, order)[0]]))
                n, cuts = _lengths(new), _cuts(keys, buckets)
                rows = [(b, keys[i:j], n[i:j]) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _, _ in rows], pa.int32()), pa.array([batch.column(0)[k].as_py()] * len(rows), pa.int64()),
                        pa.array([_pack(np.diff(x, prepend=np.uint64(0))) for _, x, _ in rows], pa.binary()), pa.array([_pack(_small(x)) for _, _, x in rows], pa.binary()),
                    ],
                    ["bucket", "block", "keys", "n"],
                )

    return blocks.select("block", "sizes", "text").mapInArrow(run, "bucket int, block long, keys binary, n binary")


def _answered(group: pa.Table) -> pa.Table:
    """Sums of a bucket's n-grams over all blocks, handed back to each block in the order of its keys."""
    if not group.num_rows:
        return pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "sums": pa.array([], pa.binary())})
    keys = [np.cumsum(_unpack(x.as_py()), dtype=np.uint64) for x in group.column("keys")]
    n = np.concatenate([_unpack(x.as_py()).astype(np.int64) for x in group.column("n")])
    order, new, _ = _distinct(np.concatenate(keys))
    sums = np.empty(len(n), np.uint64)
    sums[order] = np.repeat(np.add.reduceat(n[order], np.flatnonzero(new)), _lengths(new)).astype(np.uint64)
    parts = np.split(sums, np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "sums": pa.array([_pack(_small(p)) for p in parts], pa.binary())})


def score(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", leave_out: bool = True) -> DataFrame:
    """doc_id, n_words, n_backed_off (words scored below the full order), log_score (sum), mean_log_score: one row for each row of docs."""
    spark = docs.sparkSession
    blocks, _ = written(_blocks(id_text(docs, id_col, text_col)), "blocks")
    words = blocks.agg(F.sum("words")).first()[0] or 0
    # A word has one entry of each order at most.
    buckets = max(1, math.ceil(words * order / BUCKET))
    asked = _entries(blocks, order, buckets).repartition(buckets, "bucket")
    answers, _ = written(asked.groupBy("bucket").applyInArrow(_answered, "block long, bucket int, sums binary"), "counts")
    gathered = answers.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "sums"))), lambda x: x["sums"]).alias("sums"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data, bounds = _opened(batch.column(1)[k], batch.column(2)[k])
                answer = [_unpack(x) for x in batch.column(3)[k].as_py() or []]
                ids = batch.column(0)[k].values
                n, off, logs = _scores(data, bounds, np.concatenate(answer) if answer else np.zeros(0), words, order, leave_out)
                none = pa.array(n == 0)
                keep = lambda x: pc.if_else(none, pa.scalar(None, pa.float64()), pa.array(x))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(off), keep(logs), keep(logs / np.maximum(n, 1))], ["doc_id", "n_words", "n_backed_off", "log_score", "mean_log_score"])

    joined = blocks.join(gathered, "block", "left").select("doc_ids", "sizes", "text", "sums")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_backed_off long, log_score double, mean_log_score double")


def _scores(data: np.ndarray, bounds: np.ndarray, sums: np.ndarray, total: int, order: int, leave_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams, w = _grams(data, bounds, order)
    docs, doc = len(bounds) - 1, w.doc
    words = np.diff(w.first)
    if not len(w.start):
        return words, np.zeros(docs, np.int64), np.zeros(docs)
    rest = (total - words)[doc] if leave_out else np.full(len(doc), total)
    at_doc = np.concatenate([doc[at] for _, at in grams])
    by, new, _ = _distinct(np.concatenate([k for k, _ in grams]))
    found = np.repeat(sums.astype(np.int64), _lengths(new))
    if leave_out:
        # Equal n-grams stand in the order of their documents, so a document's own are a run.
        own = _lengths(new | textvec.starts_of_runs(at_doc[by]))
        found -= np.repeat(own, own)
    back = np.empty(len(by), np.int64)
    back[by] = found
    counts = []  # by order, for the n-gram that starts at each word; 0 where there is none
    for n, (_, at) in zip(np.split(back, np.cumsum([len(k) for k, _ in grams])[:-1]), grams):
        full = np.zeros(len(doc), np.int64)
        full[at] = n
        counts.append(full)
    value = np.where(counts[0] > 0, counts[0] / np.maximum(rest, 1), 1 / (rest + 1.0))
    done = np.where(counts[0] > 0, 1, 0)
    place = np.arange(len(doc)) - w.first[doc]
    # Going up, a longer n-gram that was seen overrides; one that wasn't costs the backoff factor.
    for k in range(2, order + 1):
        has = place >= k - 1
        first = np.arange(len(doc)) - (k - 1)
        n, context = counts[k - 1][first], counts[k - 2][first]
        seen = has & (n > 0)
        value = np.where(seen, n / np.maximum(context, 1), np.where(has, BACKOFF * value, value))
        done = np.where(seen, k, done)
    possible = np.minimum(place + 1, order)
    return words, np.bincount(doc, done < possible, docs).astype(np.int64), np.bincount(doc, np.log(value), docs)
