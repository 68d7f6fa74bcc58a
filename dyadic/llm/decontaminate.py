"""Benchmark decontamination on canonical templates, so that questions with new parameters are caught too.

Words become template tokens: numbers, names (capitals inside a sentence) and units (after a number)
turn into typed placeholders, other words into their lower-case form without outer punctuation.
Windows of eight tokens are hash-joined between documents and benchmark items. Matches of a
document and an item are lined up by their offset; along one offset every benchmark slot value
must map to one document value (two of them may get the same). An item leaks if one consistent offset matches half of
its windows, or 20 of them. Windows with fewer than half literals are matched with their exact slot values, so that
copies match them and other lists don't; as new parameters can't match them, half of an item's other windows is enough too. Texts with runs of one placeholder type ("Mary Ann") are also compared with each run
as one slot, so that a parameter may change its number of words; counts are of these windows only where
words one by one don't suffice.

Plan: a filter of fixed size over the benchmark's windows (a bit array, however large the benchmark is) runs beside the tokenizer,
so documents emit only windows that may match; the exact join follows, so a filter that fills up
costs rows, not results. Slots are compared only for matched windows.

Cases: null and empty texts have no windows. Items of four to seven tokens are one window of their
length; shorter ones match only documents that consist of their very words, as two words are in any text.
Rows with a null id are left out. Repeated rows count once; rows that repeat an id with another text are documents
(or items) of their own, and `without_leaks` drops only those that leak. Ties between offsets: the best one counts. Very long texts and words take
time in proportion to their length. Empty tables give no rows. `leaks` reads no other columns, and `without_leaks` keeps
them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import id_text, in_filter, key_filter, mix, text_slices

WIDTH, SHORTEST = 8, 4
#: An offset leaks with this share of the item's windows, or so many windows.
SHARE, ENOUGH = 0.5, 20

# Units and number words that a placeholder stands for.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g gram grams kg kilogram kilograms oz ounce ounces lb lbs "
    "pound pounds ton tons ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years dollar dollars euro euros cent cents usd eur percent % degree degrees kmh mph "
    "w kw mw gw v kv hz khz mhz ghz kb mb gb tb"
).split()
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half"
).split()

_NUM, _NAME, _UNIT = (np.uint64(k) for k in (11, 22, 33))
_b = np.arange(256)
_DIGIT = (_b >= 48) & (_b <= 57)
_UPPER = (_b >= 65) & (_b <= 90)
_LETTER = _UPPER | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
_OUTER = ~(_DIGIT | _LETTER)
_STOP = np.isin(_b, [ord(c) for c in ".!?:"])


def _hashed(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    w = textvec.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return np.sort(textvec.hashes(np.frombuffer(data, np.uint8), w.start, w.end))


_UNIT_HASHES, _NUMBER_HASHES = _hashed(UNITS), _hashed(NUMBERS)


def _lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in lower case, in place in the UTF-8 bytes."""
    out = data.copy()
    out[_UPPER[data]] += 32
    if len(data) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][latin] += 32
    return out


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, textvec.Words]:
    """Template token and slot value (0 for literals) of each word."""
    w = textvec.words(data, bounds)
    if not len(w.start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), w
    # Outer characters go, but for a last % and one character at least.
    end = _before(np.flatnonzero(~_OUTER[data] | (data == ord("%"))), w.start, w.end, w.start) + 1
    start = _after(np.flatnonzero(~_OUTER[data]), w.start, end, end - 1)
    core = textvec.hashes(_lower(data), start, end)
    number = _DIGIT[data[start]] | _among(core, _NUMBER_HASHES)
    first = np.zeros(len(start), bool)
    first[w.first[:-1][np.diff(w.first) > 0]] = True
    before = np.roll(number, 1) & ~first
    unit = ~number & before & _among(core, _UNIT_HASHES)
    # The last character that isn't a quote or bracket would be better; a full stop before one is rare enough.
    inside = ~first & ~np.roll(_STOP[data[w.end - 1]], 1)
    capital = _UPPER[data[start]]
    two = start + 1 < len(data)
    capital |= two & (data[start] == 0xC3) & (data[np.minimum(start + 1, len(data) - 1)] <= 0x9E)
    name = capital & inside & ~number & ~unit
    kind = np.select([number, unit, name], [_NUM, _UNIT, _NAME], np.uint64(0))
    return np.where(kind > 0, kind, core), np.where(kind > 0, mix(core ^ kind), np.uint64(0)), w


def _before(places: np.ndarray, start: np.ndarray, end: np.ndarray, none: np.ndarray) -> np.ndarray:
    """The last of ascending places in each range, or what `none` says."""
    at = np.searchsorted(places, end) - 1
    found = places[np.maximum(at, 0)] if len(places) else none
    return np.where((at >= 0) & (found >= start), found, none)


def _after(places: np.ndarray, start: np.ndarray, end: np.ndarray, none: np.ndarray) -> np.ndarray:
    """The first of ascending places in each range, or what `none` says."""
    at = np.searchsorted(places, start)
    found = places[np.minimum(at, len(places) - 1)] if len(places) else none
    return np.where((at < len(places)) & (found < end), found, none)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def forms(token: np.ndarray, slot: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """form of each text, token, slot, first, and the texts' rows: words one by one (form 1, or 3 without runs of a placeholder), then texts with runs with each run as one slot (2)."""
    length = np.diff(first)
    again = np.zeros(len(token), bool)
    again[1:] = (slot[1:] != 0) & (slot[:-1] != 0) & (token[1:] == token[:-1])
    again[first[:-1][length > 0]] = False
    runs = np.diff(np.r_[0, np.cumsum(again)][first])
    yield np.where(runs > 0, 1, 3), token, slot, first, np.arange(len(length))
    rows = np.flatnonzero(runs)
    if not len(rows):
        return
    own = np.repeat(runs > 0, length)
    token, slot, again = token[own], slot[own], again[own]
    begin = np.flatnonzero(~again)
    place = np.arange(len(token)) - np.repeat(begin, np.diff(np.r_[begin, len(token)]))
    # A slot's value alone, or joined with those that follow it.
    with np.errstate(over="ignore"):
        joined = np.add.reduceat(np.where(place > 0, mix(slot + place.astype(np.uint64)), slot), begin)
    yield np.full(len(rows), 2), token[begin], joined, np.r_[0, np.cumsum((length - runs)[rows])], rows


def windowed(rows: DataFrame, widths: list[int], own_width: bool = False, wanted=None) -> DataFrame:
    """id, row (a hash of the text), form, key, exact (dense in placeholders or short, so that the key holds their values), at, slots, n, n_open (windows of the text of that width, and those not exact): template windows; with own_width only those of the width that an item uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = wanted.value if wanted is not None else None
        for batch in batches:
            for part, data, bounds in text_slices(batch):
                token, slot, w = tokens(data, bounds)
                for form, token, slot, start, texts in forms(token, slot, w.first):
                    ids, hashes, length = part.column(0).take(pa.array(texts)), part.column(2).take(pa.array(texts)), np.diff(start)
                    doc = np.repeat(np.arange(len(length)), length)
                    literals = np.r_[0, np.cumsum(slot == 0)]
                    for width in widths:
                        key, at = textvec.windows(token, start, width)
                        with np.errstate(over="ignore"):
                            key = mix(key + np.uint64(width))
                            exact = ((literals[at + width] - literals[at]) * 2 < width) | (width < SHORTEST)
                            for k in range(width if exact.any() else 0):
                                key[exact] = mix(key[exact] * np.uint64(0xD1342543DE82EF95) + slot[at[exact] + k])
                        n_open = np.bincount(doc[at], ~exact, len(length)).astype(np.int64)
                        good = np.ones(len(key), bool) if filt is None else in_filter(filt, key)
                        if own_width:
                            good &= np.minimum(length[doc[at]], WIDTH) == width
                        elif width < SHORTEST:
                            good &= length[doc[at]] == width
                        key, at, exact = key[good], at[good], exact[good]
                        slots = slot[at[:, None] + np.arange(width)] if len(at) else np.zeros((0, width), np.uint64)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(slots.view(np.int64).ravel()))
                        d = doc[at]
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(pa.array(d)), hashes.take(pa.array(d)), pa.array(form[d].astype(np.int32)), pa.array(key.view(np.int64)), pa.array(exact),
                                pa.array(at - start[d]), lists, pa.array(length[d] - width + 1), pa.array(n_open[d]),
                            ],
                            ["id", "row", "form", "key", "exact", "at", "slots", "n", "n_open"],
                        )

    return rows.mapInArrow(run, "id long, row long, form int, key long, exact boolean, at long, slots array<long>, n long, n_open long")


def _caught(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """doc_id, row (hash of the text), item_id, form, matched, windows, same: a row for each document, item and consistent offset that leaks."""
    spark = docs.sparkSession
    keyed = lambda rows: rows.where("doc_id is not null").withColumn("row", F.xxhash64("text"))
    items, docs = keyed(id_text(benchmark, item_col, item_text)), keyed(id_text(docs, id_col, text_col))
    theirs = windowed(items, list(range(1, WIDTH + 1)), own_width=True).select(
        "key", "exact", F.col("id").alias("item_id"), F.col("row").alias("item_row"), F.col("form").alias("item_form"), F.col("at").alias("item_at"),
        F.col("slots").alias("item_slots"), F.col("n").alias("windows"), "n_open", F.size("slots").alias("width"),
    )
    used = sorted(r[0] for r in theirs.select("width").distinct().collect())  # eight widths at most
    if not used:
        used = [WIDTH]
    wanted = spark.sparkContext.broadcast(key_filter(theirs, "key"))
    ours = windowed(docs, used, wanted=wanted).select(F.col("id").alias("doc_id"), "row", "form", "key", "at", "slots")
    pair = F.filter(F.arrays_zip(F.col("item_slots").alias("b"), F.col("slots").alias("d")), lambda p: p["b"] != 0)
    lined = (
        ours.join(theirs, "key")
        .withColumn("form", F.col("form").bitwiseAND(F.col("item_form")))
        .where("form > 0")
        .groupBy("doc_id", "row", "item_id", "item_row", "form", (F.col("at") - F.col("item_at")).alias("offset"))
        .agg(
            F.count_distinct("item_at").alias("matched"), F.count_distinct(F.when(~F.col("exact"), F.col("item_at"))).alias("open"),
            F.max("windows").alias("windows"), F.max("n_open").alias("n_open"), F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("exact"), pair)))).alias("pairs"),
        )
    )
    one = F.size(F.array_distinct(F.transform("pairs", lambda p: p["b"]))) == F.size("pairs")
    enough = (F.col("matched") >= SHARE * F.col("windows")) | (F.col("matched") >= ENOUGH) | ((F.col("open") > 0) & (F.col("open") >= SHARE * F.col("n_open")))
    return lined.where(one & enough).withColumn("same", ~F.exists("pairs", lambda p: p["b"] != p["d"]))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, matched (windows), windows (of the item), verbatim: a row for each document and item that leaks into it."""
    best = lambda x: F.coalesce(F.max(F.when(F.col("form") != 2, x)), F.max(x))
    caught = _caught(docs, benchmark, id_col, text_col, item_col, item_text)
    return caught.groupBy("doc_id", "item_id").agg(best(F.col("matched")).alias("matched"), best(F.col("windows")).alias("windows"), best(F.col("same")).alias("verbatim"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that leak (by id and text); rows with a null id stay."""
    # Names that no column of docs has, whatever these are.
    tag = "__" + "_".join(["leak", *docs.columns])
    caught = _caught(docs, benchmark, id_col, text_col, item_col, item_text).select(F.col("doc_id").alias(f"{tag}i"), F.col("row").alias(f"{tag}h")).distinct()
    same = (F.col(f"`{id_col}`").cast("long") == F.col(f"`{tag}i`")) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(f"`{tag}h`"))
    return docs.join(caught, same, "left_anti")
