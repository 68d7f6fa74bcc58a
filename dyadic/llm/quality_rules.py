"""Quality classifier: a sparse ensemble of rules from tree paths, with lasso logistic weights.

Trees of depth three are boosted on text statistics of a bounded labelled sample; every path from a root is a
conjunctive rule. A logistic regression with an L1 penalty weighs the rules (and drops most), and
what is left is compiled into Spark column expressions over the same statistics, so scoring is a
projection: no Python, no shuffle. Only statistics enter a score, never labels, lang, source or id.

The fit reads SAMPLE labelled documents at most (those with the least hashes of their ids) outside the
held-out fold, which is crc32(doc_id as text) mod 4 = 2.

Cases: null and empty texts have zero statistics and are scored as such. Rows with a null doc_id
are scored and not held out. Labels that are null, repeated or of documents that don't exist are
ignored (the least of repeated labels counts; a document that repeats an id counts once, with its least statistics). Without labels of both kinds every score is the share of label 1,
or 0.5. An empty table gives no rows. Very long texts are measured whole, in n log n time and memory in proportion to their length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .rule_ledger import measurements

SAMPLE, TREES, DEPTH, CUTS = 20_000, 40, 3, 24
PREDICTED_FROM = 0.7

#: Statistics by name, over the struct of measurements.
STATISTICS = {
    "words": lambda m: m["n_words"] + 0.0,
    "word_length": lambda m: m["word_chars"] / _least1(m["n_words"]),
    "symbols": lambda m: m["n_symbols"] / _least1(m["n_words"]),
    "repeated": lambda m: m["n_repeat_words"] / _least1(m["n_words"]),
    "same_lines": lambda m: m["n_dup_lines"] / _least1(m["n_lines"]),
    "line_words": lambda m: m["n_words"] / _least1(m["n_lines"]),
    "capitals": lambda m: m["n_capitals"] / _least1(m["word_chars"]),
    "exclamations": lambda m: m["n_exclamations"] / _least1(m["n_words"]),
    "distinct": lambda m: m["n_distinct"] / _least1(m["n_words"]),
    "longest": lambda m: m["longest_word"] + 0.0,
}


def _least1(c: Column) -> Column:
    return F.greatest(c, F.lit(1))


def statistics(text: Column) -> Column:
    return let(measurements(text), lambda m: F.struct(*(f(m).alias(name) for name, f in STATISTICS.items())))


@dataclass(frozen=True)
class Rule:
    """All of (statistic index, threshold, whether above): conjunction of x > t or x <= t."""

    terms: tuple[tuple[int, float, bool], ...]

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, t, above in self.terms:
            out &= (x[:, k] > t) == above
        return out

    def column(self, s: Column) -> Column:
        names = list(STATISTICS)
        out = None
        for k, t, above in self.terms:
            c = s[names[k]] > F.lit(t) if above else s[names[k]] <= F.lit(t)
            out = c if out is None else out & c
        return out


@dataclass
class Ensemble:
    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self, text: Column) -> Column:
        """The score of a text, from 0 to 1."""

        def scored(s: Column) -> Column:
            z = F.lit(self.intercept)
            for rule, w in zip(self.rules, self.weights):
                z = z + F.when(rule.column(s), F.lit(w)).otherwise(F.lit(0.0))
            return 1 / (1 + F.exp(-z))

        return let(statistics(text), scored)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z += w * rule.of(x)
        return 1 / (1 + np.exp(-z))


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, path: tuple, rules: set[Rule], rows: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Leaves (rows, value) of a tree that fits gradients g with curvatures h; its paths are added to the rules."""
    if path:
        rules.add(Rule(tuple(sorted(path))))
    total_g, total_h = g[rows].sum(), h[rows].sum()
    leaf = [(rows, total_g / (total_h + 1.0))]
    if depth == 0 or len(rows) < 20:
        return leaf
    best, split = 1e-6, None
    for k, edges in enumerate(cuts):
        place = np.searchsorted(edges, x[rows, k], "left")  # x <= edges[j] iff place <= j
        sg = np.bincount(place, g[rows], len(edges) + 1).cumsum()[:-1]
        sh = np.bincount(place, h[rows], len(edges) + 1).cumsum()[:-1]
        gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
        if len(gain) and gain.max() > best:
            best, split = gain.max(), (k, float(edges[int(gain.argmax())]))
    if split is None:
        return leaf
    k, t = split
    up = x[rows, k] > t
    if up.all() or not up.any():
        return leaf
    out = []
    for above in (False, True):
        out += _tree(x, g, h, cuts, depth - 1, (*path, (k, t, above)), rules, rows[up == above])
    return out


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1])) for k in range(x.shape[1])]
    # Junk is rare: cuts among its own values as well.
    cuts = [np.unique(np.r_[c, np.quantile(x[y == 0, k], np.linspace(0, 1, CUTS // 2 + 2)[1:-1])]) for k, c in enumerate(cuts)]
    rules: set[Rule] = set()
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        for rows, value in _tree(x, y - p, p * (1 - p), cuts, DEPTH, (), rules, np.arange(len(y))):
            z[rows] += 0.3 * value
    return sorted(rules, key=lambda r: r.terms)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all weights but the intercept, by accelerated proximal gradient."""
    n = len(y)
    full = np.c_[np.ones(n), a]
    rate = 4 * n / max(np.linalg.norm(full, 2) ** 2, 1e-9)
    w = v = np.zeros(full.shape[1])
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-full @ v))
        new = v - rate * (full.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        v, w = new + (k - 1) / (k + 2) * (new - w), new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Ensemble(float(np.log(share / (1 - share))))
    rules = tree_rules(x, y)
    a = np.stack([r.of(x) for r in rules], 1).astype(float)
    # Rules that hold for the same rows are one rule; the shortest stands for them.
    order = sorted(range(len(rules)), key=lambda k: len(rules[k].terms))
    _, first = np.unique(a[:, order], axis=1, return_index=True)
    chosen = [order[k] for k in sorted(first)]
    rules, a = [rules[k] for k in chosen], a[:, chosen]
    scale = np.sqrt(np.maximum(a.mean(0) * (1 - a.mean(0)), 1e-4))
    intercept, w = lasso(a / scale, y, penalty=2e-3)
    keep = np.flatnonzero(w)
    return Ensemble(intercept, [rules[k] for k in keep], [float(w[k] / scale[k]) for k in keep])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Ensemble:
    usable = (
        labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
        .groupBy("label_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(sample)
    )
    # The sample is bounded, so it can be sent to every executor. Where documents repeat an id, the row with the least statistics stands for it.
    rows = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(usable), "label_id")
    rows = rows.select("label_id", "label", statistics(F.col("text")).alias("s")).groupBy("label_id").agg(F.min("label").alias("label"), F.min("s").alias("s")).select("label", "s.*").toPandas()
    rows = rows.sort_values(list(rows.columns)).to_numpy(np.float64)
    return fit(rows[:, 1:], rows[:, 0])


def score(docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), model.column(F.col(text_col)).alias("score")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted")
    )
