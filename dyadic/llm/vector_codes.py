"""Product codes of vectors: each of PARTS equal parts of a vector becomes the place of its nearest codebook entry.

Components are integers, floor(256 x), so distances, sums and floors are exact and results don't depend
on partitioning. A codebook starts as a part of the ENTRIES kept vectors with the least ids; a round
assigns all parts and moves each entry to the floor of its parts' mean.

The nearest entry is found as in a VA-file: the coordinates of a codebook's entries are quantised to
CELLS cells in each dimension, and each query gets a table of the least and the greatest squared distance
from its coordinate to each cell. Sums over the dimensions bound each entry's distance from both sides;
only entries whose lower bound isn't above the least upper bound are measured exactly.

Scale: a round is one pass over the vectors, in which each task sums its parts by (part, entry); what is
shuffled and what reaches the driver has PARTS x ENTRIES rows, whatever the data. The sums of error by
label are grouped before a join that may split a label with many rows.

Cases: rows whose vector is null or holds null or non-finite components are dropped, as the rule says.
Vectors are of the same length, that of the kept one with the least id; rows of another length, of one that
PARTS doesn't divide, or with components beyond LARGEST (whose distances leave 64 bits) have a null code
and error and don't take part. Fewer vectors than ENTRIES give a smaller codebook. Null ids come last;
rows that repeat an id are vectors of their own, in the order of their components. Equal distances go to
the lower entry. Columns of other names are never read; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the code: integer steps in a unit, parts, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Cells of a dimension; vectors handled at once; the largest integer component.
CELLS, ROWS, LARGEST = 8, 4096, 1 << 26


# --- one codebook ---------------------------------------------------------------------------------


class Cells:
    """The entries (m x d integers) of one part's codebook, and the cells that hold their coordinates."""

    def __init__(self, entries: np.ndarray, cells: int = CELLS):
        self.entries = entries.astype(np.int64)
        m, d = entries.shape
        order = np.sort(self.entries, axis=0)
        cuts = order[(np.arange(1, cells) * m) // cells] if m else np.zeros((cells - 1, d), np.int64)
        # A cell is a run of the sorted coordinates; its bounds are the least and greatest coordinate in it.
        self.cell = np.stack([np.searchsorted(cuts[:, j], self.entries[:, j], "right") for j in range(d)], axis=1)
        low, high = np.full((d, cells), np.iinfo(np.int64).max), np.full((d, cells), np.iinfo(np.int64).min)
        for j in range(d):
            np.minimum.at(low[j], self.cell[:, j], self.entries[:, j])
            np.maximum.at(high[j], self.cell[:, j], self.entries[:, j])
        empty = low > high
        self.low, self.high = np.where(empty, 0, low), np.where(empty, 0, high)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each query (n x d integers) the nearest entry, the first among equals, its squared distance, and how many distances were measured."""
        n, d = queries.shape
        q = queries[:, :, None]
        under, over = np.maximum(self.low - q, 0), np.maximum(q - self.high, 0)
        least = (under + over) ** 2  # n x d x cells: the query's lookup tables
        most = np.maximum(np.abs(q - self.low), np.abs(self.high - q)) ** 2
        lower = np.zeros((n, len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for j in range(d):
            lower += least[:, j, self.cell[:, j]]
            upper += most[:, j, self.cell[:, j]]
        who, which = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        exact = ((queries[who] - self.entries[which]) ** 2).sum(axis=1)
        # Candidates of a query follow each other, by entry.
        first = np.r_[0, np.flatnonzero(np.diff(who)) + 1]
        best = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == best[who])
        _, at = np.unique(who[hit], return_index=True)
        return which[hit[at]], best, len(exact)


def assigned(vectors: np.ndarray, books: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """codes (n x parts) and squared distances (n x parts) of integer vectors."""
    codes, errors = np.empty((len(vectors), len(books)), np.int64), np.empty((len(vectors), len(books)), np.int64)
    width = vectors.shape[1] // len(books)
    for p, book in enumerate(books):
        codes[:, p], errors[:, p], _ = book.nearest(vectors[:, p * width : (p + 1) * width])
    return codes, errors


# --- tables ---------------------------------------------------------------------------------------


def _usable(v: Column) -> Column:
    return F.size(v) == F.size(F.filter(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """vec_id, label, v (integer components) of the rows whose vector is whole; v is null where a component is beyond LARGEST."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label_col) if label_col else F.lit(None).cast("int")).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(F.col("x").isNotNull()).where(_usable(F.col("x")))
    fits = F.forall("x", lambda x: F.abs(x) * SCALE < LARGEST)
    return rows.select("vec_id", "label", F.when(fits, F.transform("x", lambda x: F.floor(x * SCALE).cast("long"))).alias("v"))


def _stacked(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def codebooks(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """parts x entries x width integers, from rows (vec_id, v). Only the first entries and grouped sums reach the driver."""
    first = rows.where("v is not null").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).select(F.size("v")).first()
    dim = first[0] if first else 0
    if not dim or dim % parts:
        return np.zeros((parts, 0, 0), np.int64)
    width = dim // parts
    same = rows.where(F.size("v") == dim)
    start = np.array([r["v"] for r in same.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()], np.int64)
    books = start.reshape(len(start), parts, width).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _moved(same.select("v"), books)
    return books


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every entry at the floor of its parts' mean, unused ones where they were."""
    parts, m, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n, total = [Cells(b) for b in books], np.zeros((parts, m), np.int64), np.zeros((parts, m, width), np.int64)
        for batch in _runs(batches):
            v = _stacked(batch.column(0), parts * width)
            codes, _ = assigned(v, cells)
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=m)
                np.add.at(total[p], codes[:, p], v[:, p * width : (p + 1) * width])
        p, e = np.nonzero(n)
        sums = pa.array(list(total[p, e]), pa.list_(pa.int64())) if len(p) else pa.array([], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), sums], ["part", "entry", "n", "total"])

    sums = rows.mapInArrow(run, "part long, entry long, n long, total array<long>").groupBy("part", "entry")
    out = books.copy()
    # parts x entries rows at most.
    for r in sums.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[j]) for j in range(width))).alias("total")).collect():
        out[r["part"], r["entry"]] = [t // r["n"] for t in r["total"]]
    return out


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of rows (vec_id, label, v)."""
    parts, m, width = books.shape
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books] if m else []
        for batch in _runs(batches):
            v = batch.column(2)
            fits = np.array(v.value_lengths().fill_null(-1)) == parts * width if m else np.zeros(len(v), bool)
            code, error = np.full(len(v), None, object), np.full(len(v), None, object)
            if fits.any():
                codes, errors = assigned(_stacked(v.filter(pa.array(fits)), parts * width), cells)
                code[fits], error[fits] = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()], errors.sum(axis=1).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes with the vector (integers / SCALE, at the middle of the step) that each code stands for."""
    parts, m, width = books.shape
    table = F.array(*(F.array(*(F.lit((float(x) + 0.5) / SCALE) for x in books[p, e])) for p in range(parts) for e in range(m)))
    places = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.get(table, p * m + F.conv(F.substring("code", 2 * p + 1, F.lit(2)), 16, 10).cast("int")))
    return codes.withColumn("vector", F.when(F.col("code").isNotNull(), F.flatten(places)))


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row for each vector that is whole."""
    rows = integers(vectors, id_col, vector_col, label_col)
    books = codebooks(rows)
    coded = encode(rows, books)
    # One row for each label; null labels meet through eqNullSafe. A label with many rows is split by the join.
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(books_text(books).encode()).hexdigest()).alias("codebooks_sha256"))
