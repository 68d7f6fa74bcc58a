"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Base kinds: `assign` (a keyword, a separator and a value of 8 or more), `access` (key ids) and
`hex` (32 or more hexadecimal digits). The method adds `markov`: tokens of 20 or more key
characters with letters and digits whose mean log-likelihood ratio, between a Markov model of
random strings and one of ordinary identifiers, reaches a threshold. Both models are
character transitions counted from labelled samples; what leaves Spark is one ratio for each pair
of the alphabet (ALPHABET squared at most).

Native: DataFrame functions only, all within a document's own row: no shuffle. A text is searched
once for each kind; where that finds a match, two or three more scans take matches and gaps.
Positions are running sums of their lengths, so time is in proportion to a text's length, times the
logarithm of its matches, also for a token of megabytes. Only `redacted` cuts the text once for each match.

Positions are code points; end is exclusive. Matches of a kind are leftmost and don't overlap.
A method span that overlaps a base span is left out.

Cases: null and empty texts have no span. Spans of several kinds may start at one place (a tie); they come in the
order of KINDS. Repeated rows give repeated results; an empty table gives none. Other columns are never
read, and `redacted` keeps them. Very long texts are scanned whole, in time in proportion to their length and matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, running

# Fixed values of the base kinds, in their order.
KINDS = ["assign", "access", "hex", "markov"]
_KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
_ASSIGN = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{12,}"
_HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8

#: Characters of the models, and what a token needs to be scored.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
TOKEN_LEAST = 20
_TOKEN = rf"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*[0-9])[A-Za-z0-9+/=_-]{{{TOKEN_LEAST},}}"
#: Least mean log-likelihood ratio of a pair of characters, in nats.
THRESHOLD = 0.5

#: Parts of ordinary identifiers for the default samples.
PARTS = (
    "get set put add new old min max sum avg all any key map row col day run log max user name item list type data file path "
    "size time date text word page site host port code test node edge tree line part order price total count index value "
    "table query field model layer batch group cache store event state error debug input output image video audio title "
    "author number string object array buffer stream client server session request response message handler factory "
    "manager service config option default version release build report summary detail account payment customer "
    "product category country language address location transaction document collection repository application"
).split()


def default_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(text, label): random strings (1) in the usual encodings and ordinary identifiers (0), the same every time."""
    ids = spark.range(n)
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    packed = F.base64(F.unhex(digest("b")))
    random = ids.select(
        F.explode(F.array(digest("a"), packed, F.translate(packed, "+/=", "-_"), F.upper(F.substring(F.translate(packed, "+/=", "A0"), 1, 24)))).alias("text"),
        F.lit(1).alias("label"),
    )
    parts = F.array(*map(F.lit, PARTS))
    part = lambda k: F.get(parts, F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(PARTS))).cast("int"))
    number = F.pmod(F.xxhash64(F.lit("n"), "id"), F.lit(2030)).cast("string")
    ordinary = ids.select(
        F.explode(
            F.array(
                F.concat_ws("_", part(1), part(2), part(3), number),
                F.concat(part(4), F.initcap(part(5)), F.initcap(part(6)), number),
                F.concat_ws("-", part(7), part(8), part(9), F.lit("v"), F.substring(number, 1, 1)),
                F.concat(F.lit("/"), part(1), F.lit("/"), part(4), F.lit("/"), number, F.lit("-"), part(7)),
                F.upper(F.concat_ws("_", part(2), part(5), part(8))),
            )
        ).alias("text"),
        F.lit(0).alias("label"),
    )
    return random.unionByName(ordinary)


def train(samples: DataFrame) -> list[float]:
    """Log ratio of the transition probabilities (random over ordinary), by index of first and second character; add-half smoothing."""
    n = len(ALPHABET)
    pairs = samples.select("label", F.explode(F.expr(f"transform(sequence(1, greatest(length(text) - 1, 1)), i -> substring(text, i, 2))")).alias("pair"))
    rows = pairs.where(F.length("pair") == 2).groupBy("label", "pair").count().collect()
    count = [[[0.5] * n for _ in range(n)] for _ in range(2)]
    place = {c: k for k, c in enumerate(ALPHABET)}
    for label, pair, k in rows:
        if pair[0] in place and pair[1] in place and label is not None:
            count[label][place[pair[0]]][place[pair[1]]] += k
    share = [[[x / sum(row) for x in row] for row in table] for table in count]
    return [math.log(share[1][a][b] / share[0][a][b]) for a in range(n) for b in range(n)]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio over the pairs of characters of a token of ALPHABET."""
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in model)), ",").cast("array<double>")
    places = F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
    total = let(
        places,
        lambda p: F.aggregate(
            F.sequence(F.lit(0), F.size(p) - 2), F.lit(0.0), lambda a, i: a + F.get(table, F.get(p, i) * len(ALPHABET) + F.get(p, i + 1))
        ),
    )
    return F.when(F.length(token) > 1, total / (F.length(token) - 1)).otherwise(F.lit(0.0))


def _spans(text: Column, pattern: str, kind: str, found: Column, good) -> Column:
    """Array of (start, rank, end, kind) of a kind's matches for which good(match, value) holds."""
    # The end of the text is a match as well (without a hit): else each place behind the last hit would be tried to the end.
    whole = F.lit(rf"(?s).*?(?:({pattern})|\z)")
    take = lambda k: F.regexp_extract_all(text, whole, F.lit(k))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
    ends = running(F.transform(take(0), F.length), lambda a, b: a + b)
    value = [take(2).alias("value")] if kind == "assign" else []
    parts = F.arrays_zip(ends.alias("end"), take(1).alias("hit"), *value)
    hits = F.filter(parts, lambda x: (x["hit"] != "") & good(x["hit"], x["value"] if value else None))
    span = lambda x: F.struct((x["end"] - F.length(x["hit"])).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    return F.when(found, F.transform(hits, span)).otherwise(none)


def _apart(own: Column, base: Column) -> Column:
    """Those of the method's spans that overlap no base span: the furthest end of base spans that start before or with it, and the nearest start of
    those that start later, tell."""
    is_base = lambda x: x["rank"] < KINDS.index("markov")

    def judged(both: Column) -> Column:
        far = running(F.transform(both, lambda x: F.when(is_base(x), x["end"])), F.greatest)
        near = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(is_base(x), x["start"]))), F.least))
        rows = F.arrays_zip(both.alias("s"), far.alias("far"), near.alias("near"))
        alone = F.filter(rows, lambda r: ~is_base(r["s"]) & (F.coalesce(r["far"], F.lit(0)) <= r["s"]["start"]) & (F.coalesce(r["near"], r["s"]["end"]) >= r["s"]["end"]))
        return F.transform(alone, lambda r: r["s"])

    return F.when((F.size(own) == 0) | (F.size(base) == 0), own).otherwise(let(F.sort_array(F.concat(base, own)), judged))


def base_spans(text: Column) -> Column:
    kinds = [
        _spans(text, _ASSIGN, "assign", text.rlike(_ASSIGN[:-2] + f"{{{ASSIGN_LEAST},}})"), lambda hit, value: F.length(value) >= ASSIGN_LEAST),
        _spans(text, _ACCESS, "access", text.rlike(_ACCESS), lambda hit, value: F.lit(True)),
        _spans(text, _HEX, "hex", text.rlike(_HEX), lambda hit, value: F.lit(True)),
    ]
    return F.sort_array(F.concat(*kinds))


def all_spans(text: Column, model: list[float]) -> Column:
    """A struct of `base` and `all`, both arrays of (start, rank, end, kind) by start and kind."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of(t: Column) -> Column:
        likely = lambda hit, value: hit.rlike("[A-Za-z]") & (ratio(hit, model) >= THRESHOLD)
        own = _spans(t, _TOKEN, "markov", t.rlike(_TOKEN), likely)
        both = lambda p: F.struct(p["base"].alias("base"), F.sort_array(F.concat(p["base"], _apart(p["own"], p["base"]))).alias("all"))
        return let(F.struct(base_spans(t).alias("base"), own.alias("own")), both)

    return let(text, of)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    model = model or train(default_samples(docs.sparkSession))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), all_spans(F.col(text_col), model).alias("s"))
    count = lambda kind: F.size(F.filter(F.col("s.all"), lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    *base, own = map(count, KINDS)
    return found.select("doc_id", *base, F.sha2(_joined(F.col("s.base")), 256).alias("base_sha256"), _joined(F.col("s.all")).alias("spans"), own)


def redacted(docs: DataFrame, text_col: str = "text", model: list[float] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with each found span replaced by the mark; spans that overlap become one mark. A text without spans, or null, stays as it is."""
    model = model or train(default_samples(docs.sparkSession))
    text = F.col(text_col)

    def cut(spans: Column) -> Column:
        def of_ends(upto: Column) -> Column:
            before = lambda i: F.coalesce(F.get(upto, i - 1), F.lit(0))
            gap = lambda s, i: F.concat(F.substr(text, before(i) + 1, s["start"] - before(i)), F.lit(mark))
            kept = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), gap(s, i)).otherwise(F.lit("")))
            return F.concat(F.array_join(kept, ""), F.substr(text, F.array_max(upto) + 1, F.length(text)))

        ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        return F.when(F.size(spans) == 0, text).otherwise(let(ends, of_ends))

    return docs.withColumn(text_col, let(all_spans(text, model)["all"], cut))
