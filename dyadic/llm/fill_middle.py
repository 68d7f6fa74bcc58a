"""Fill-in-middle: texts cut at two token bounds into prefix, middle and suffix, and put together in another order.

Tokens are runs of characters that are not white space with the white space before them (white space at
the end of a text is one of its own). The Split pre-tokenizer of the tokenizers library, with isolated
matches of the pattern, gives their offsets in code points; it needs no training. The number of
offsets is n, and offsets looked up by rank give the slices. Which documents are turned, where they are
cut and in which form they are written depends on (seed, doc_id) alone, so any part of a table can be
made again by itself.

Memory: a long text goes through the pre-tokenizer in pieces of about PIECE code points, each of which
ends at a token bound (a token never ends before anything but white space), so only its offsets, eight
bytes a token, and the text itself are held.

Cases: null and empty texts are plain and have no tokens. A text with one of the marks in it is plain,
so that every output can be turned back. A null doc_id draws as the empty string does. Repeated rows give
equal rows; ties don't occur. Columns of other names are never read; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, text_slices

#: Fixed values of the format: what a token is, the marks, and how often a form is drawn, in hundredths.
PATTERN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TURNED, SUFFIX_FIRST = 50, 80
SEED, PIECE = 42, 1 << 12

_BOUND = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(PATTERN), "isolated")


def _pieces(text: str, size: int) -> Iterator[tuple[int, str]]:
    """The text in pieces of `size` code points or a little more, each with its place."""
    at = 0
    while len(text) - at > size:
        found = _BOUND.search(text, at + size)
        if found is None:
            break
        yield at, text[at : found.start()]
        at = found.start()
    yield at, text[at:] if at else text


def token_ends(text: str, split=None, size: int = PIECE) -> np.ndarray:
    """Where each token of a text ends, in code points; the next one starts there."""
    from tokenizers import PreTokenizedString

    split = split or splitter()
    out = []
    for at, piece in _pieces(text, size):
        held = PreTokenizedString(piece)
        split.pre_tokenize(held)
        # Offsets in bytes are many times cheaper for the library than those in code points.
        ends = np.fromiter((s[1][1] for s in held.get_splits("original", "byte") if s[0]), np.int64)
        if not piece.isascii():
            data = np.frombuffer(piece.encode(), np.uint8)
            ends = np.cumsum((data & 0xC0) != 0x80)[ends - 1]
        out.append(ends + at)
    return np.concatenate(out)


def drawn(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """The four numbers that decide on a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def turned(doc_id: int | None, text: str, split=None, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, and the text as it is written."""
    ends = token_ends(text, split)
    n = len(ends)
    h1, h2, h3, h4 = drawn(doc_id, seed)
    if not text or h3 % 100 >= TURNED or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = (int(ends[k - 1]) if k else 0 for k in (a, b))
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", i, j - i, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", i, j - i, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output of a form was made from."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, middle = output[len(first) :].split(MIDDLE)
    one, two = head.split(second)
    return one + middle + two if form == "psm" else two + middle + one


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row for each row of docs, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for batch in batches:
            for rows, _, _ in text_slices(batch):
                ids = rows.column(0).to_pylist()
                out = [turned(i, t.as_py() or "", split, seed) for i, t in zip(ids, rows.column(1))]
                n, form, prefix, middle, output = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return id_text(docs, id_col, text_col).mapInArrow(run, _SCHEMA)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The transformed documents with digests of the output and of the text rebuilt from it in place of the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [
                (hashlib.sha256(o.encode()).hexdigest(), hashlib.sha256(restored(o, f).encode()).hexdigest())
                for o, f in ((o.as_py(), f.as_py()) for o, f in zip(batch.column(5), batch.column(2)))
            ]
            arrays = [*batch.columns[:5], pa.array([a for a, _ in sums], pa.string()), pa.array([b for _, b in sums], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:5], "output_sha256", "restored_sha256"])

    out = transform(docs, id_col, text_col, seed)
    return out.mapInArrow(run, _SCHEMA.replace("output string", "output_sha256 string, restored_sha256 string"))
