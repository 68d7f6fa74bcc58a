"""Near-duplicate classes by BagMinHash signatures, bands, and verified multiset overlap.

A document is the multiset of its five-word shingles (all its words, if it has one to four). Two
documents are linked if their weighted Jaccard similarity, sum of least counts over sum of
greatest counts, is 0.8 or more; a class is a connected component of the links.

Signature: the count of a shingle is cut at 1, 2, 4, 8, ... (the discretised weights). Each part
[2^(j-1), 2^j) carries a Poisson process with the rate of its length, seeded by shingle and part;
a point's place in the part follows from a descent through its halves, and the point counts if
that place lies below the shingle's count. Each point falls to one register, and a register
keeps its first point. Two documents agree in a register with a probability equal to their
weighted Jaccard similarity.

Plan: equal multisets collapse by a 128-bit sum before anything is compared, so that a group of
exact copies costs one row. Texts that share a band, directly or through others, form a candidate group (a
connected component over buckets, each a star). Groups are compared exactly on their shingles, in
blocks of bounded size: small groups share a block, a large one is dealt to blocks and
every pair of its blocks is a task. A task finds all overlaps of its rows with one product of 0/1
matrices (the j-th occurrence of a shingle is an element of its own, so that the product counts
multiset overlaps) and gives off the links that connect its rows, fewer than it has rows. No list of pairs
exists anywhere, no link between different texts is lost, and nothing is capped.

Cases: null or empty texts have no shingle and form a class of their own; so do rows with a null
doc_id, whose class_id is null. Repeated rows give repeated results. An empty table gives none.
The class id is the least doc_id of the class; where ids repeat with other texts, several classes may have the same, and class_key
tells them apart. Very long texts take time and memory in proportion to their length. Other columns are
never read, and `without_near_duplicates` keeps them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import in_filter, key_filter, mix, remove, text_slices, written
from .graph import components

#: Words of a shingle, and the least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Bands of ROWS registers; a pair of similarity 0.8 shares no band with a probability of 0.0002.
BANDS, ROWS = 16, 4
#: Bytes of text that a worker signs at once.
SLICE = 1 << 19
#: Rows and shingles of a block of a candidate group.
BLOCK_ROWS, BLOCK_ENTRIES = 512, 256_000

_G = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each shingle, by text."""
    w = textvec.words(data, bounds)
    h = textvec.hashes(data, w.start, w.end)
    out, at = textvec.windows(h, w.first, WORDS)
    hs, docs = [out], [w.doc[at]]
    n = np.diff(w.first)
    for k in range(1, WORDS):
        if len(short := np.flatnonzero(n == k)):
            first = np.concatenate([[0], np.cumsum(np.full(len(short), k))])
            own = h[(w.first[short][:, None] + np.arange(k)).ravel()]
            hs.append(textvec.windows(own, first, k)[0] + np.uint64(k))
            docs.append(short)
    hs, docs = np.concatenate(hs), np.concatenate(docs)
    if len(docs) > len(out):
        order = np.argsort(docs, kind="stable")
        hs, docs = hs[order], docs[order]
    return hs, docs


def counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts: hash, text, count."""
    with np.errstate(over="ignore"):
        _, at, n = np.unique(h ^ mix(doc.astype(np.uint64) * _G + _G), return_index=True, return_counts=True)
    return h[at], doc[at], n


def signatures(h: np.ndarray, doc: np.ndarray, n: np.ndarray, texts: int, size: int) -> np.ndarray:
    """(texts, size) registers: the identity of each register's first point; rows of texts without shingles mean nothing."""
    total = np.bincount(doc, n, texts)
    until = np.where(total > 0, size * (np.log(size) + 4) / np.maximum(total, 1), 0.0)
    out = np.zeros(texts * size, np.uint64)
    todo = np.flatnonzero(total > 0)
    chosen = np.ones(len(h), bool)
    while len(todo):
        full = _points(h[chosen], doc[chosen], n[chosen], until, out, size, texts)
        todo = todo[~full[todo]]
        until[todo] *= 2
        chosen = np.isin(doc, todo)
    return out.reshape(texts, size)


def _points(h, doc, n, until, out, size, texts) -> np.ndarray:
    """Points up to the time `until` of each text, put into the registers; which texts have all registers filled."""
    seeds, docs, counts, low, rate = [], [], [], [], []
    part = 0
    with np.errstate(over="ignore"):
        while True:
            lo = 0 if part == 0 else 1 << (part - 1)
            has = n > lo
            if not has.any():
                break
            seeds.append(mix(h[has] + _G * np.uint64(2 * part + 1)))
            docs.append(doc[has])
            counts.append(n[has])
            low.append(np.full(has.sum(), lo))
            rate.append(np.full(has.sum(), max(lo, 1)))
            part += 1
        seed, doc, n, low, rate = (np.concatenate(x) for x in (seeds, docs, counts, low, rate))
        t = np.zeros(len(seed))
        times, keys, names = [], [], []
        while len(seed):
            seed = mix(seed + _G)
            t = t - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            alive = t <= until[doc]
            seed, doc, n, low, rate, t = (x[alive] for x in (seed, doc, n, low, rate, t))
            more = mix(seed ^ _G)
            # The halves of the part that a point falls into, from the first bit to the last, are its place's bits.
            place = low + ((more >> np.uint64(32)).astype(np.int64) & (rate - 1))
            ok = place < n
            times.append(t[ok])
            keys.append((doc * size + ((more & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64))[ok])
            names.append(seed[ok])
        times, keys, names = (np.concatenate(x) if x else np.zeros(0) for x in (times, keys, names))
        order = np.argsort(-times, kind="stable")  # the first point is put last, and stays
        out[keys[order].astype(np.int64)] = names[order]
        filled = np.zeros(texts * size, bool)
        filled[keys.astype(np.int64)] = True
    return filled.reshape(texts, size).all(axis=1)


def bands(registers: np.ndarray, rows: int) -> np.ndarray:
    texts, size = registers.shape
    out = np.zeros((texts, size // rows), np.uint64)
    with np.errstate(over="ignore"):
        out += np.arange(1, size // rows + 1, dtype=np.uint64) * _G
        for k in range(rows):
            out = mix(out * np.uint64(0xD1342543DE82EF95) + registers[:, k::rows][:, : size // rows])
    return out


def _fingerprints(h: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """128-bit sums over the multiset of each text, as rows of 16 bytes."""
    out = np.zeros((texts, 2), np.uint64)
    with np.errstate(over="ignore"):
        if len(h):
            starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            for k, x in enumerate((mix(h), mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))):
                out[doc[starts], k] = np.add.reduceat(x, starts)
    return out


def _binary16(rows: np.ndarray, null: np.ndarray) -> pa.Array:
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
    return pc.if_else(pa.array(~null), fixed.cast(pa.binary()), pa.scalar(None, pa.binary()))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (as given), fp (16 bytes; null without shingles), fk (its first 8 as an integer), n (shingles), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in text_slices(batch, most=SLICE):
                texts = rows.num_rows
                h, doc = shingles(data, bounds)
                n = np.bincount(doc, minlength=texts)
                b = bands(signatures(*counted(h, doc), texts, BANDS * ROWS), ROWS)
                flat = pa.array(b.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(texts + 1, dtype=np.int32) * BANDS), flat)
                fps = _fingerprints(h, doc, texts)
                key = pa.array(np.ascontiguousarray(fps[:, 0]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), _binary16(fps, n == 0), key, pa.array(n), lists], ["doc_id", "text_hash", "fp", "fk", "n", "bands"]
                )

    return docs.mapInArrow(run, "doc_id long, text_hash long, fp binary, fk long, n long, bands array<long>")


def _shingled(docs: DataFrame, wanted) -> DataFrame:
    """fp, hashes, counts (packed, ascending by hash) of the documents that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(in_filter(wanted.value, mix(ids.astype(np.int64).view(np.uint64)))))
            for rows, data, bounds in text_slices(batch, most=SLICE):
                texts = rows.num_rows
                h, doc = shingles(data, bounds)
                fps = _binary16(_fingerprints(h, doc, texts), np.bincount(doc, minlength=texts) == 0)
                e, d, c = counted(h, doc)
                order = np.lexsort((e, d))
                e, d, c = e[order], d[order], c[order].astype(np.uint32)
                cut = np.searchsorted(d, np.arange(texts + 1))
                yield pa.RecordBatch.from_arrays(
                    [fps, *(pa.array([x[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()) for x in (e, c))], ["fp", "hashes", "counts"]
                )

    return docs.mapInArrow(run, "fp binary, hashes binary, counts binary")


def linked(overlap: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Whether overlaps of multisets of n1 and n2 elements make a similarity of SIMILARITY."""
    return overlap >= (n1 + n2) * SIMILARITY / (1 + SIMILARITY) - 1e-9


def _overlaps(hashes: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """Multiset overlaps of all rows with all rows."""
    rows = len(hashes)
    row = np.repeat(np.arange(rows), [int(c.sum()) for c in counts])
    flat, times = np.concatenate(hashes), np.concatenate(counts).astype(np.int64)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    with np.errstate(over="ignore"):
        element = np.where(turn > 0, mix(np.repeat(flat, times) + turn.astype(np.uint64) * _G), np.repeat(flat, times))
    _, place, df = np.unique(element, return_inverse=True, return_counts=True)
    shared = df > 1
    column = np.cumsum(shared) - 1
    keep = shared[place]
    row, column = row[keep], column[place[keep]]
    out = np.zeros((rows, rows), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    wide = max(1, (8 << 20) // rows)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        i, j = np.searchsorted(column, (low, low + wide))
        part = np.zeros((rows, min(wide, int(column[-1]) + 1 - low)), np.float32)
        part[row[i:j], column[i:j] - low] = 1
        out += part @ part.T
    return out


def _spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Links (from a symmetric matrix) of a forest that connects what they connect."""
    left, out = np.ones(len(links), bool), []
    for start in range(len(links)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            k = todo.pop()
            new = np.flatnonzero(links[k] & left)
            left[new] = False
            out += [(k, int(j)) for j in new]
            todo += new.tolist()
    return out


def _links(table: pa.Table) -> pa.Table:
    """a, b: links that connect the rows of each group, or for two blocks of a group, those from one to the other."""
    table = table.sort_by("comp")
    fps, blocks = table.column("fp").to_pylist(), table.column("block").to_numpy()
    comps = table.column("comp").to_pylist()
    hashes = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
    counts = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")]
    n = np.array([int(c.sum()) for c in counts])
    out: list[tuple] = []
    first = 0
    while first < len(fps):
        last = first
        while last < len(fps) and comps[last] == comps[first]:
            last += 1
        if last - first > 1:
            at = slice(first, last)
            good = linked(_overlaps(hashes[at], counts[at]), n[at][:, None], n[at][None, :])
            if len(set(blocks[at].tolist())) > 1:
                good &= blocks[at][:, None] != blocks[at][None, :]
            np.fill_diagonal(good, False)
            out += [(fps[first + i], fps[first + j]) for i, j in _spanning(good)]
        first = last
    return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})


def _verified(packed: DataFrame) -> DataFrame:
    """Links of (comp, fp, n, hashes, counts): within each candidate group, exactly."""
    sizes = packed.groupBy("comp").agg(F.count("*").alias("rows"), F.sum("n").alias("entries"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("entries") / BLOCK_ENTRIES)).cast("int")
    total = packed.agg(F.count("*"), F.sum("n")).first()
    bundles = max(1, (total[0] or 0) // (BLOCK_ROWS // 2) + 1, (total[1] or 0) // (BLOCK_ENTRIES // 2) + 1)
    dealt = packed.join(sizes.select("comp", blocks.alias("blocks")), "comp").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    wide = dealt.select("*", other).select(
        "comp", "fp", "hashes", "counts", "block",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(bundles))).otherwise(F.xxhash64("comp", F.least("block", "other"), F.greatest("block", "other"))).alias("task"),
    )
    return wide.groupBy("task").applyInArrow(_links, "a binary, b binary")


def _rooted(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, root (the fingerprint that stands for the row's class; null for rows that are a class of their own): one row for each row of docs."""
    spark = docs.sparkSession
    rows, _ = written(signed(docs), "signatures")
    known = rows.where("fp is not null and doc_id is not null")
    # Candidates are told apart by half a fingerprint: a false meeting costs a comparison, no result.
    members = known.select("fk", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("fk").alias("hub"), F.max("fk").alias("last")).where("hub < last").select("bucket", "hub")
    stars = members.join(shared, "bucket").where("fk <> hub").select(F.col("fk").alias("a"), F.col("hub").alias("b"))
    groups, groups_paths = components(stars)
    groups = groups.select(F.col("v").alias("fk"), F.col("root").alias("comp"))
    groups = groups.unionByName(groups.select(F.col("comp").alias("fk"), "comp").distinct())
    compared = known.join(groups, "fk").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("comp").alias("comp"))
    compared, compared_path = written(compared, "compared")
    remove(spark, *groups_paths)
    wanted = spark.sparkContext.broadcast(key_filter(compared.select("fp", "doc_id").mapInArrow(_mixed_ids, "key long"), "key"))
    packed = _shingled(docs, wanted).join(compared.select("fp", "n", "comp"), "fp").dropDuplicates(["fp"])
    packed, packed_path = written(packed, "shingles")
    edges, edges_path = written(_verified(packed), "links")
    remove(spark, compared_path, packed_path)
    roots, _ = components(edges)
    remove(spark, edges_path)
    return rows.join(roots.select(F.col("v").alias("fp"), "root"), "fp", "left").select(
        "doc_id", "text_hash", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "fp")).alias("root")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, class_size (rows of the class), n_shingles, class_key (tells classes apart whose least doc_ids are equal because ids repeat;
    null for rows that are a class of their own): one row for each row of docs."""
    rooted = _rooted(_keyed(docs, id_col, text_col))
    classes = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    # As a table of its own, so that the join may split the rows of a large class.
    classes, _ = written(classes, "classes")
    return rooted.join(classes, "root", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.col("n").alias("n_shingles"),
        F.lower(F.hex("root")).alias("class_key"),
    )


def _mixed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(mix(ids.astype(np.int64).view(np.uint64)).view(np.int64))], ["key"])


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: that of the least doc_id, and of texts that repeat this id, that of the least hash; of rows equal in both, one."""
    rooted, _ = written(_rooted(_keyed(docs, id_col, text_col)).where("root is not null"), "rooted")
    counts = rooted.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    keeps, _ = written(counts.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("keep")), "keeps")
    judged = counts.join(keeps, "root").withColumn("stays", F.struct("doc_id", "text_hash") == F.col("keep"))
    judged, _ = written(judged.where("not stays or rows > 1").select("doc_id", "text_hash", "stays"), "judged")
    # Names that no column of docs has, whatever these are.
    tag = "__" + "_".join(["dedup", *docs.columns])
    marked = docs.withColumn(tag, F.xxhash64(F.col(text_col).cast("string")))
    key = lambda rows: rows.select(F.col("doc_id").alias(f"{tag}i"), F.col("text_hash").alias(f"{tag}h"))
    same = (F.col(f"`{id_col}`").cast("long") == F.col(f"`{tag}i`")) & (F.col(f"`{tag}`") == F.col(f"`{tag}h`"))
    kept = marked.join(key(judged.where("not stays")), same, "left_anti")
    twice = key(judged.where("stays"))
    if not twice.isEmpty():
        again = kept.join(twice, same, "left_semi").dropDuplicates([id_col, tag])
        kept = kept.join(twice, same, "left_anti").unionByName(again)
    return kept.drop(tag)
