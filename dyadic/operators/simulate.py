"""Generators of test data with known truth. Values follow from hashes of row numbers, so they don't depend on partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, name: str, *keys) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def normal(seed: int, name: str, *keys) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, name + "/r", *keys))) * F.cos(2 * np.pi * uniform(seed, name + "/a", *keys))


def pick(seed: int, name: str, n: int, *keys) -> Column:
    return F.least(F.floor(uniform(seed, name, *keys) * n), F.lit(n - 1)).cast("int") + 1


def dyadic(spark: SparkSession, rows: int, nodes: int = 203, contexts: tuple[int, int, int] = (4, 3, 11), factors: int = 2, var_y: float = 0.1, seed: int = 0) -> DataFrame:
    """(src_id, dst_id, src_context, dst_context, ctx_id, y): main effects by context and a three-way interaction, plus noise."""
    c = F.col
    obs = spark.range(rows).select(
        "id", pick(seed, "s", nodes, c("id")).alias("src_id"), pick(seed, "d", nodes, c("id")).alias("dst_id"),
        pick(seed, "sc", contexts[0], c("id")).alias("src_context"), pick(seed, "dc", contexts[1], c("id")).alias("dst_context"), pick(seed, "e", contexts[2], c("id")).alias("ctx_id"),
    )
    y = np.sqrt(0.5) * (normal(seed, "alpha", c("src_id"), c("src_context")) + normal(seed, "beta", c("dst_id"), c("dst_context")))
    for k in range(factors):
        y = y + normal(seed, f"u{k}", c("src_id")) * normal(seed, f"v{k}", c("dst_id")) * (1 + normal(seed, f"w{k}", c("ctx_id")))
    return obs.select("*", (y + np.sqrt(var_y) * normal(seed, "noise", c("id"))).alias("y"))


def multicontext(spark: SparkSession, rows: int, nodes: int = 203, contexts: tuple[int, int, int] = (4, 3, 11), factors: int = 2, var_y: float = 0.1, var_local: float = 0.1, loading: float = 1.0, seed: int = 0) -> DataFrame:
    """As dyadic, but with two-level main effects: an entity's effect in context c is (loading + c / 10) times its global effect, plus noise of variance var_local. Contexts are dealt so that most pairs of entity and context are rare."""
    c = F.col
    flat = dyadic(spark, rows, nodes, contexts, factors, var_y, seed).drop("y")
    level = lambda n, e, k: (loading + c(k) / 10) * normal(seed, f"{n}/g", c(e)) + np.sqrt(var_local) * normal(seed, n, c(e), c(k))
    y = level("alpha", "src_id", "src_context") + level("beta", "dst_id", "dst_context")
    for k in range(factors):
        y = y + normal(seed, f"u{k}", c("src_id")) * normal(seed, f"v{k}", c("dst_id")) * (1 + normal(seed, f"w{k}", c("ctx_id")))
    return flat.select("*", (y + np.sqrt(var_y) * normal(seed, "noise", c("id"))).alias("y"))


def two_level(spark: SparkSession, items: int, categories: int, repeats: int, var_b: float = 0.5, var_obs: float = 0.2, seed: int = 0) -> DataFrame:
    """(item, category, obs, var, a, b)."""
    c = F.col
    rows = spark.range(items * categories * repeats).select("id", (F.floor(c("id") / (categories * repeats)) + 1).cast("int").alias("item"), (F.pmod(F.floor(c("id") / repeats), F.lit(categories)) + 1).cast("int").alias("category"))
    rows = rows.withColumn("a", normal(seed, "a", c("item"))).withColumn("b", c("a") + np.sqrt(var_b) * normal(seed, "b", c("item"), c("category")))
    return rows.select("item", "category", (c("b") + np.sqrt(var_obs) * normal(seed, "o", c("id"))).alias("obs"), F.lit(var_obs).alias("var"), "a", "b")


def beta_binomial(spark: SparkSession, cells: int, rows: int, mean: float = 0.1, size: float = 20.0, trials: int = 100, seed: int = 0) -> DataFrame:
    """(p_node, t_node, n_pos, n_trials): each row draws its own rate from one Beta distribution."""
    schema = "p_node int, t_node int, n_pos long, n_trials long"

    def run(batches):
        for pdf in batches:
            out = []
            for k in pdf["id"]:
                rng = np.random.default_rng([seed, int(k)])
                n = int(rng.integers(1, trials + 1))
                out.append((int(k) % cells + 1, int(k) // cells % 3 + 1, int(rng.binomial(n, rng.beta(mean * size, (1 - mean) * size))), n))
            import pandas as pd

            yield pd.DataFrame(out, columns=["p_node", "t_node", "n_pos", "n_trials"])

    return spark.range(rows).mapInPandas(run, schema)


def topic_corpus(spark: SparkSession, items: int, terms: int, topics: int, words: int, seed: int = 0) -> DataFrame:
    """(item, term, weight): an item is mostly of topic item mod topics, whose terms are a contiguous share of the vocabulary."""
    c = F.col
    rows = spark.range(items * words).select("id", (F.floor(c("id") / words) + 1).cast("int").alias("item"))
    own = F.pmod(c("item"), F.lit(topics))
    topic = F.when(uniform(seed, "keep", c("id")) < 0.9, own).otherwise(pick(seed, "t", topics, c("id")) - 1)
    width = terms // topics
    term = F.concat(F.lit("t"), (topic * width + pick(seed, "w", width, c("id"))).cast("string"))
    return rows.select("item", term.alias("term")).groupBy("item", "term").agg(F.count("*").cast("double").alias("weight"))


def multi_app(spark: SparkSession, users: int, items: dict[str, int], n_global: int = 2, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """(user, app, item, y)."""
    c = F.col
    out = None
    for app, n in items.items():
        rows = spark.range(users * n).select((F.floor(c("id") / n) + 1).cast("int").alias("user"), F.lit(app).alias("app"), F.concat(F.lit("i"), F.pmod(c("id"), F.lit(n)).cast("string")).alias("item"))
        y = F.lit(0.0)
        for g in range(n_global):
            z = normal(seed, f"u{g}", c("user")) + 0.3 * normal(seed, f"z{app}{g}", c("user"))
            y = y + z * normal(seed, f"l{app}{g}", c("item"))
        own = rows.withColumn("y", y + np.sqrt(noise) * normal(seed, f"e{app}", c("user"), c("item")))
        out = own if out is None else out.unionByName(own)
    return out


def perturbed(df: DataFrame, column: str, sd: float, *keys: str, seed: int = 0) -> DataFrame:
    return df.withColumn(column, F.col(column) + sd * normal(seed, "perturb", *map(F.col, keys)))


def dirichlet(alpha: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    g = rng.gamma(alpha)
    return g / g.sum()


def gamma_by_moments(mean: float, var: float, n: int, rng: np.random.Generator) -> np.ndarray:
    return rng.gamma(mean * mean / var, var / mean, n)


def categorical(df: DataFrame, probs: str, out: str, key: str, seed: int = 0) -> DataFrame:
    """df with a draw (from 1 on) from each row's probabilities, which must sum to 1 up to 1e-9."""
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    u = uniform(seed, "categorical", F.col(key))
    step = F.aggregate(probs, F.struct(F.lit(0.0).alias("c"), F.lit(1).alias("k")), lambda a, p: F.struct((a["c"] + p).alias("c"), F.when(a["c"] + p < u, a["k"] + 1).otherwise(a["k"]).alias("k")), lambda a: a["k"])
    checked = F.when(F.abs(total - 1) > 1e-9, F.raise_error(F.lit("probabilities don't sum to 1")).cast("int")).otherwise(F.least(step, F.size(probs)))
    return df.withColumn(out, checked)
