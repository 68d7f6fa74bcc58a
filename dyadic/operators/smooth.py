"""Closed-form Gaussian smoothing: two-level items and categories, trees, and their EM fits."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import levels


@dataclass
class TwoLevel:
    """b_ik = q_k a_i + e, obs = b_ik + noise; a_i has variance var_a and b_ik given a_i var_b[k]."""

    var_a: float
    var_b: dict[str, float]
    q: dict[str, float]


def _by_category(values: dict, column: str) -> Column:
    table = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))))
    return F.element_at(table, F.col(column).cast("string"))


def two_level_posterior(data: DataFrame, model: TwoLevel, item: str = "item", category: str = "category", obs: str = "obs", var: str = "var") -> DataFrame:
    """(item, category, mean_a, var_a, mean_b, var_b, cov): posterior of the item effect and of each category with a prior, with or without data.

    Categories are few by nature (one entry of the model each); items are unbounded and are the grouping key.
    """
    cats = data.sparkSession.createDataFrame([(str(k), float(model.q[k]), float(model.var_b[k])) for k in model.q], "category string, q double, vb double")
    stats = data.groupBy(F.col(item).alias("item"), F.col(category).cast("string").alias("category")).agg(
        F.sum(F.col(obs) / F.col(var)).alias("c"), F.sum(1 / F.col(var)).alias("f")
    )
    a = 1 / F.col("vb") + F.col("f")
    known = stats.join(F.broadcast(cats), "category")
    # Categories without data add nothing to an item's effect.
    tops = known.groupBy("item").agg(
        F.sum(F.col("q") * F.col("q") / F.col("vb") * (1 - 1 / (a * F.col("vb")))).alias("p"), F.sum(F.col("c") * F.col("q") / (a * F.col("vb"))).alias("s")
    )
    tops = tops.select("item", (1 / (1 / F.lit(model.var_a) + F.col("p"))).alias("var_a"), "s").withColumn("mean_a", F.col("var_a") * F.col("s"))
    full = tops.crossJoin(F.broadcast(cats)).join(stats, ["item", "category"], "left").fillna(0.0, ["c", "f"])
    inv = 1 / (1 / F.col("vb") + F.col("f"))
    d = inv * F.col("q") / F.col("vb")
    return full.select(
        "item", "category", "mean_a", "var_a",
        (d * F.col("mean_a") + inv * F.col("c")).alias("mean_b"), (inv + d * d * F.col("var_a")).alias("var_b"), (d * F.col("var_a")).alias("cov"),
    )


@dataclass
class TwoLevelFit:
    model: TwoLevel
    history: list[dict] = field(default_factory=list)


def fit_two_level(data: DataFrame, iterations: int = 10, item: str = "item", category: str = "category", obs: str = "obs", var: str = "var", ridge: float = 0.0, fix_q: bool = False, fix_var_a: bool = True) -> TwoLevelFit:
    """EM: the posterior is a table, the M-step needs five sums for each category."""
    cats = [r[0] for r in data.select(F.col(category).cast("string")).distinct().orderBy(category).collect()]
    first = {r[0]: r[1] for r in data.groupBy(F.col(category).cast("string")).agg(F.coalesce(F.var_samp(obs), F.lit(1.0))).collect()}
    model = TwoLevel(1.0, {c: max(first.get(c, 1.0), 1e-6) for c in cats}, dict.fromkeys(cats, 1.0))
    out = TwoLevelFit(model)
    seen = data.select(F.col(item).alias("item"), F.col(category).cast("string").alias("category")).distinct()
    for k in range(iterations):
        post = two_level_posterior(data, model, item, category, obs, var).join(seen, ["item", "category"], "left_semi")
        e = lambda x, y, c: F.sum(x * y + c)
        sums = post.groupBy("category").agg(
            F.count("*").alias("n"), e(F.col("mean_a"), F.col("mean_a"), F.col("var_a")).alias("aa"), e(F.col("mean_a"), F.col("mean_b"), F.col("cov")).alias("ab"), e(F.col("mean_b"), F.col("mean_b"), F.col("var_b")).alias("bb")
        ).collect()
        q, vb = dict(model.q), dict(model.var_b)
        for r in sums:
            c = r["category"]
            q[c] = q[c] if fix_q else (r["ab"] + ridge) / (r["aa"] + ridge)
            vb[c] = max((r["bb"] - 2 * q[c] * r["ab"] + q[c] ** 2 * r["aa"]) / r["n"], 1e-9)
        var_a = model.var_a
        if not fix_var_a:
            var_a = post.select("item", "mean_a", "var_a").distinct().agg(F.avg(F.col("mean_a") * F.col("mean_a") + F.col("var_a"))).first()[0]
        model = TwoLevel(var_a, vb, q)
        out.model = model
        out.history.append({"iteration": k + 1, "var_a": var_a, "expected_loglik": sum(-0.5 * r["n"] * np.log(vb[r["category"]]) - 0.5 * (r["bb"] - 2 * q[r["category"]] * r["ab"] + q[r["category"]] ** 2 * r["aa"]) / vb[r["category"]] for r in sums)})
    return out


def predict_two_level(rows: DataFrame, posterior: DataFrame, item: str = "item", category: str = "category") -> DataFrame:
    """rows with pred: the posterior mean of the cell, 0 for items that weren't seen."""
    right = posterior.select(F.col("item").alias(item), F.col("category").alias("__c"), F.col("mean_b").alias("pred"))
    return rows.join(right, (rows[item] == right[item]) & (rows[category].cast("string") == right["__c"]), "left").drop(right[item]).drop("__c").fillna(0.0, ["pred"])


def pre_aggregated(data: DataFrame, keys: list[str], obs: str = "obs", var: str = "var") -> DataFrame:
    """One row for each cell that carries the same information: the precision-weighted mean and its variance."""
    return data.groupBy(*keys).agg((F.sum(F.col(obs) / F.col(var)) / F.sum(1 / F.col(var))).alias(obs), (1 / F.sum(1 / F.col(var))).alias(var))


def baselines(train: DataFrame, test: DataFrame, item: str, category: str, y: str) -> DataFrame:
    """test with item_mean (the overall mean for new items) and cell_mean (the item's mean for new cells)."""
    overall = train.agg(F.avg(y).alias("__all"))
    items = train.groupBy(item).agg(F.avg(y).alias("__item"))
    cells = train.groupBy(item, category).agg(F.avg(y).alias("__cell"))
    out = test.join(items, item, "left").join(cells, [item, category], "left").crossJoin(F.broadcast(overall))
    return out.withColumn("item_mean", F.coalesce("__item", "__all")).withColumn("cell_mean", F.coalesce("__cell", "__item", "__all")).drop("__all", "__item", "__cell")


def main_effect(obs: DataFrame, by: str, o: str, var: str | float, prior: Column | float, prior_var: float, multiplier: Column | None = None) -> DataFrame:
    """(by, mean, var) of an effect with a Gaussian prior, given residuals o with noise variance: precision-weighted, one grouped sum."""
    s2 = F.col(var) if isinstance(var, str) else F.lit(float(var))
    m = multiplier if multiplier is not None else F.lit(1.0)
    sums = obs.groupBy(by).agg(F.sum(m * m / s2).alias("p"), F.sum(F.col(o) * m / s2).alias("s"))
    v = 1 / (F.col("p") + 1 / prior_var)
    prior = prior if isinstance(prior, Column) else F.lit(float(prior))
    return sums.select(by, (v * (F.col("s") + prior / prior_var)).alias("mean"), v.alias("var"))


def tree_posterior(tree: DataFrame, data: DataFrame, step_var: float | list[float], root_mean: float, root_var: float, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """(node, mean, var, cov) on a tree: a child is its parent plus noise of step_var (or of step_var[depth - 1]), data (node, obs, var) sit on any node; cov is the
    posterior covariance with the parent, null at the root.

    Messages go up level by level and come down again; a level is a join and a grouped sum.
    """
    from .graph import cut, forget

    depth = levels(tree, node, parent).withColumnRenamed("level", "depth")
    edges = tree.where(f"{parent} is not null").select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    own = data.groupBy("node").agg(F.sum(1 / F.col("var")).alias("p"), F.sum(F.col("obs") / F.col("var")).alias("s"))
    state = cut(depth.join(edges, "node", "left").join(own, "node", "left").fillna(0.0, ["p", "s"]))
    deepest = state.agg(F.max("depth")).first()[0] or 0
    steps = [float(v) for v in step_var] if isinstance(step_var, (list, tuple)) else [float(step_var)] * deepest
    if len(steps) < deepest:
        raise ValueError(f"{deepest} levels below the root need as many variances")
    for d in range(deepest, 0, -1):
        # Information of a child, seen through the step's noise.
        q = steps[d - 1]
        up = state.where(F.col("depth") == d).select(F.col("parent").alias("node"), (F.col("p") / (1 + q * F.col("p"))).alias("mp"), (F.col("s") / (1 + q * F.col("p"))).alias("ms"))
        up = up.groupBy("node").agg(F.sum("mp").alias("mp"), F.sum("ms").alias("ms"))
        last, state = state, cut(state.join(up, "node", "left").withColumn("p", F.col("p") + F.coalesce("mp", F.lit(0.0))).withColumn("s", F.col("s") + F.coalesce("ms", F.lit(0.0))).drop("mp", "ms"))
        forget(last)
    v = 1 / (1 / root_var + F.col("p"))
    done = cut(state.where("depth = 0").select("node", (v * (root_mean / root_var + F.col("s"))).alias("mean"), v.alias("var"), F.lit(None).cast("double").alias("cov")))
    out = done
    for d in range(1, deepest + 1):
        q = steps[d - 1]
        above = done.select(F.col("node").alias("parent"), F.col("mean").alias("pm"), F.col("var").alias("pv"))
        gain = 1 / (1 / q + F.col("p"))
        slope = gain / q
        done = cut(
            state.where(F.col("depth") == d).join(above, "parent").select("node", (gain * (F.col("s") + F.col("pm") / q)).alias("mean"), (gain + slope * slope * F.col("pv")).alias("var"), (slope * F.col("pv")).alias("cov"))
        )
        out = out.unionByName(done)
    return out
