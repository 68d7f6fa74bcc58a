"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are masks over the bits.

The ledger has one row for each document: its measurements, and `fail_bits` with bit k set if
rule k failed. A policy is a named, versioned set of rules; it is applied with one bitwise AND,
and an ablation (what each rule decides alone) is an aggregation of bits. Neither reads a text.

Native: DataFrame functions only. All measurements of a text are array expressions in its own
row, so nothing is shuffled, and repeated windows are found by sorting, not by comparing all.

Cases: a null or empty text has no words, fails `few_words`, and is rejected. Repeated rows give
repeated results; an empty table gives none. Other columns are never read. Very long texts are measured whole, in
n log n time (windows are sorted) and memory in proportion to their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: White space and symbols of the base measurements, and words of a repeated window.
SPACE, SYMBOLS, WINDOW = r"[\x20\x09-\x0D]+", "[#*$%&|<>]", 5

#: Rule names in the order of their bits, each a condition on the measurements m.
RULES = {
    "few_words": lambda m: m["n_words"] < 10,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"],
    "symbols": lambda m: 100 * m["n_symbols"] > 10 * m["n_words"],
    "word_length": lambda m: (m["word_chars"] < 3 * m["n_words"]) | (m["word_chars"] > 10 * m["n_words"]),
    "repeated_lines": lambda m: (m["n_dup_lines"] >= 3) & (100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    "capitals": lambda m: 100 * m["n_capitals"] > 30 * m["word_chars"],
    "exclamations": lambda m: 100 * m["n_exclamations"] > 20 * m["n_words"],
    # Long texts repeat their words more, so short ones are held to a higher share.
    "few_distinct": lambda m: 100 * m["n_distinct"] < F.when(m["n_words"] < 100, 30).otherwise(10) * m["n_words"],
    "long_word": lambda m: m["longest_word"] > 1000,
}
#: Rules of each version of the policy.
POLICIES = {
    "v1": ["few_words", "repeated_windows"],
    "v2": ["few_words", "repeated_windows", "symbols", "word_length", "repeated_lines", "capitals", "exclamations", "few_distinct"],
    "v3": list(RULES),
}
POLICY = "v2"


def mask(policy: str) -> int:
    return sum(1 << k for k, rule in enumerate(RULES) if rule in POLICIES[policy])


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more, given the hash of the window at each word."""
    ordered = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda e, i: F.coalesce(F.get(s, i)["h"] == e["h"], F.lit(False))
        return F.filter(s, lambda e, i: ((i > 0) & same(e, i - 1)) | ((i < last) & same(e, i + 1)))

    at = F.sort_array(F.transform(let(ordered, repeated), lambda e: e["at"]))
    return F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct((a["n"] + x + WINDOW - F.greatest(x, a["upto"])).alias("n"), (x + WINDOW).alias("upto")),
        lambda a: a["n"],
    )


def _repeat_words(words: Column) -> Column:
    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_covered(w)))

    enough = F.size(words) > WINDOW
    return F.when(enough, let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).otherwise(0)


def measurements(text: Column) -> Column:
    """A struct of counts (long) for a text; null counts as empty."""

    def of_words(text: Column, words: Column, lines: Column) -> Column:
        long = lambda c: c.cast("long")
        solid = F.array_join(words, "")
        return F.struct(
            long(F.size(words)).alias("n_words"),
            long(F.length(solid)).alias("word_chars"),
            long(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
            long(F.size(lines)).alias("n_lines"),
            long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            long(_repeat_words(words)).alias("n_repeat_words"),
            long(F.length(F.regexp_replace(solid, r"\P{Lu}+", ""))).alias("n_capitals"),
            long(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).alias("n_exclamations"),
            long(F.size(F.array_distinct(words))).alias("n_distinct"),
            long(F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0))).alias("longest_word"),
        )

    def of_text(text: Column) -> Column:
        words = F.filter(F.split(text, SPACE), lambda w: w != "")
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(F.struct(words.alias("w"), lines.alias("l")), lambda p: of_words(text, p["w"], p["l"]))

    return let(F.coalesce(text.cast("string"), F.lit("")), of_text)


def ledger_column(text: Column, policy: str = POLICY) -> Column:
    """Measurements, fail_bits, base_failed and kept of a text, as one struct evaluated once."""
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclamations", "n_distinct", "longest_word"]

    def judged(m: Column) -> Column:
        bits = F.lit(0).cast("long")
        for k, rule in enumerate(RULES.values()):
            bits = bits.bitwiseOR(F.when(rule(m), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
        return let(bits, lambda b: F.struct(*(m[f].alias(f) for f in fields), b.alias("fail_bits"), passes(b, "v1").alias("base_ok"), (passes(b, "v1") & passes(b, policy)).alias("kept")))

    return let(measurements(text), judged)


def passes(fail_bits: Column, policy: str) -> Column:
    return fail_bits.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: str = POLICY) -> DataFrame:
    """doc_id, the base measurements, base_failed, kept, then the other measurements and fail_bits."""
    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), ledger_column(F.col(text_col), policy).alias("l"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rest = ["n_lines", "n_capitals", "n_exclamations", "n_distinct", "longest_word", "fail_bits"]
    return made.select("doc_id", *(f"l.{c}" for c in base), (~F.col("l.base_ok")).alias("base_failed"), "l.kept", *(f"l.{c}" for c in rest))


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """A ledger with the verdict of another policy; no text is read."""
    return rows.withColumn("kept", passes(F.col("fail_bits"), policy))


def ablation(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """rule, failed (rows that fail it), alone (rows that only this rule of the policy rejects, so that dropping it would keep them)."""
    used = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    by_bits = rows.groupBy(used.alias("bits")).agg(F.count("*").alias("n"))
    chosen = [(k, rule) for k, rule in enumerate(RULES) if rule in POLICIES[policy]]
    rules = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, rule in chosen))
    return (
        by_bits.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("alone"),
        )
    )


def kept_documents(docs: DataFrame, text_col: str = "text", policy: str = POLICY) -> DataFrame:
    """The rows of docs that the policy keeps, with all their columns."""
    return docs.where(ledger_column(F.col(text_col), policy)["kept"])
