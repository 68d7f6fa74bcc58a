"""Logistic models: adaptive rejection sampling, Bayesian regression, and dyadic effects by sampling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut, forget


def adaptive_rejection(logf: Callable[[float], tuple[float, float]], start: list[float], rng: np.random.Generator, low: float = -np.inf, high: float = np.inf, most: int = 200) -> float:
    """One draw from a log-concave density given log f and its slope: rejection from a piecewise-exponential hull of tangents (Gilks and Wild, 1992)."""
    xs = sorted(set(start))
    hs, ds = map(list, zip(*(logf(x) for x in xs)))
    # The hull needs a rising tangent on an open left side and a falling one on an open right side.
    step = 1.0
    while not np.isfinite(low) and ds[0] <= 0:
        xs.insert(0, xs[0] - step)
        h, d = logf(xs[0])
        hs.insert(0, h)
        ds.insert(0, d)
        step *= 2
    step = 1.0
    while not np.isfinite(high) and ds[-1] >= 0:
        xs.append(xs[-1] + step)
        h, d = logf(xs[-1])
        hs.append(h)
        ds.append(d)
        step *= 2
    for _ in range(most):
        x, h, d = (np.array(v) for v in (xs, hs, ds))
        gap = d[:-1] - d[1:]
        z = np.where(np.abs(gap) > 1e-12, (h[1:] - h[:-1] - x[1:] * d[1:] + x[:-1] * d[:-1]) / np.where(np.abs(gap) > 1e-12, gap, 1), (x[:-1] + x[1:]) / 2)
        edges = np.r_[low, z, high]
        # The hull's greatest value lies where two tangents meet (or at a bound): where a density is narrow, far above all values of log f.
        top = max(h.max(), (h[:-1] + d[:-1] * (z - x[:-1])).max(initial=-np.inf), *(h[i] + d[i] * (e - x[i]) for i, e in ((0, low), (-1, high)) if np.isfinite(e)))
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            left = np.where(np.isfinite(edges[:-1]), np.exp(h + d * (edges[:-1] - x) - top), 0.0)
            right = np.where(np.isfinite(edges[1:]), np.exp(h + d * (edges[1:] - x) - top), 0.0)
            mass = np.where(np.abs(d) > 1e-10, (right - left) / np.where(np.abs(d) > 1e-10, d, 1), np.exp(h - top) * (edges[1:] - edges[:-1]))
        mass = np.maximum(np.nan_to_num(mass), 0)
        k = int(rng.choice(len(x), p=mass / mass.sum()))
        u = rng.random()
        if abs(d[k]) > 1e-10:
            e = left[k] + u * (right[k] - left[k])
            new = x[k] + (np.log(max(e, 1e-300)) + top - h[k]) / d[k]
        else:
            new = edges[k] + u * (edges[k + 1] - edges[k])
        value, slope = logf(new)
        if np.log(rng.random()) <= value - (h[k] + d[k] * (new - x[k])):
            return float(new)
        at = int(np.searchsorted(x, new))
        xs.insert(at, float(new))
        hs.insert(at, value)
        ds.insert(at, slope)
    return float(xs[int(np.argmax(hs))])


def logistic_terms(y: np.ndarray, offset: np.ndarray, x: np.ndarray, mean: float, var: float, n: np.ndarray | float = 1.0) -> Callable[[float], tuple[float, float]]:
    """Log posterior of a coefficient t with scores offset + x t and a Gaussian prior, and its slope; n: how often each row occurs."""

    def f(t: float) -> tuple[float, float]:
        s = offset + x * t
        p = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
        return float((n * (y * s - np.logaddexp(0, s))).sum() - (t - mean) ** 2 / (2 * var)), float((n * x * (y - p)).sum() - (t - mean) / var)

    return f


def spline_terms(y: np.ndarray, offset: np.ndarray, x: np.ndarray, mean: float, var: float, a: float, n: np.ndarray | float = 1.0) -> Callable[[float], tuple[float, float]]:
    """The same with the two-sided link whose value at 0 is a (1/2 is the logistic one with doubled scores)."""

    def prob(s: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.where(s < 0, 2 * a / (1 + np.exp(-2 * (1 - a) * s)), 2 * a - 1 + 2 * (1 - a) / (1 + np.exp(-2 * a * s)))

    def value(t: float) -> float:
        p = np.clip(prob(offset + x * t), 1e-12, 1 - 1e-12)
        return float((n * (y * np.log(p) + (1 - y) * np.log1p(-p))).sum() - (t - mean) ** 2 / (2 * var))

    return lambda t: (value(t), (value(t + 1e-5) - value(t - 1e-5)) / 2e-5)


def bayes_logistic(x: np.ndarray, y: np.ndarray, prior_mean: np.ndarray, prior_var: np.ndarray, samples: int = 200, burn_in: int = 50, seed: int = 0, n: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and variance of coefficients by Gibbs sampling, each coefficient by adaptive rejection; n: how often each row occurs."""
    rng, b, draws = np.random.default_rng(seed), prior_mean.astype(float).copy(), []
    score = x @ b
    for t in range(burn_in + samples):
        for k in range(x.shape[1]):
            rest = score - x[:, k] * b[k]
            new = adaptive_rejection(logistic_terms(y, rest, x[:, k], prior_mean[k], prior_var[k], n), [b[k] - 1, b[k], b[k] + 1], rng)
            score, b[k] = rest + x[:, k] * new, new
        if t >= burn_in:
            draws.append(b.copy())
    return np.mean(draws, 0), np.var(draws, 0, ddof=1)


def regression_by_group(df: DataFrame, by: list[str], features: str, y: str, prior_var: float = 10.0, samples: int = 200, burn_in: int = 50) -> DataFrame:
    """by..., mean, var: a Bayesian logistic regression for each group. Equal rows are counted together first, which bounds a group by its distinct rows."""
    counted = df.groupBy(*by, features, y).agg(F.count("*").alias("k"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema if f.name in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, t = np.stack(pdf[features].to_numpy()).astype(float), pdf[y].to_numpy().astype(float)
        seed = xxhash.xxh32_intdigest("|".join(str(pdf[c].iat[0]) for c in by))
        mean, var = bayes_logistic(x, t, np.zeros(x.shape[1]), np.full(x.shape[1], prior_var), samples, burn_in, seed, pdf["k"].to_numpy().astype(float))
        return pd.DataFrame({**{c: [pdf[c].iat[0]] for c in by}, "mean": [mean], "var": [var]})

    return counted.groupBy(*by).applyInPandas(run, f"{schema}, mean array<double>, var array<double>")


def effects_step(obs: DataFrame, by: str, offset: str, old: DataFrame, var: float, seed: int, sweep: int | str, multiplier: str | None = None, knot: float | None = None) -> DataFrame:
    """(by, value): a draw for each entity from its log-concave conditional; obs has y (0 or 1) and an offset. Entities without data keep their value in `old`.

    knot: the value at 0 of the two-sided link, instead of the logistic one. An entity's distinct rows are one group; for entities without a bound on them,
    `factor.fit` with is_logistic and samples draws from the same posterior through sums.
    """
    rows = obs.select(by, "y", F.col(offset).alias("o"), (F.col(multiplier) if multiplier else F.lit(1.0)).alias("m")).groupBy(by, "y", "o", "m").agg(F.count("*").alias("k"))
    kind = dict(obs.dtypes)[by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "o", "m"])
        y, o, m, k = (pdf[c].to_numpy().astype(float) for c in ("y", "o", "m", "k"))
        terms = logistic_terms(y, o, m, 0.0, var, k) if knot is None else spline_terms(y, o, m, 0.0, var, knot, k)
        rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}|{sweep}|{by}|{pdf[by].iat[0]}"))
        return pd.DataFrame({by: [pdf[by].iat[0]], "value": [adaptive_rejection(terms, [-1.0, 0.0, 1.0], rng)]})

    new = rows.groupBy(by).applyInPandas(run, f"{by} {kind}, value double")
    return old.join(new.withColumnRenamed("value", "__new"), by, "left").select(by, F.coalesce("__new", "value").alias("value"))


def fit_effects(obs: DataFrame, samples: int = 10, burn_in: int = 5, var: float = 1.0, seed: int = 0, centred: bool = True) -> tuple[DataFrame, DataFrame, float]:
    """Source and destination effects (id, value) of y ~ logistic(b + alpha + beta), means over draws; centred after each draw, which makes b identifiable."""
    p = obs.agg(F.avg(F.col("y").cast("double"))).first()[0]
    b = float(np.log(p / (1 - p)))
    alpha = cut(obs.select("src_id").distinct().withColumn("value", F.lit(0.0)))
    beta = cut(obs.select("dst_id").distinct().withColumn("value", F.lit(0.0)))
    from .factor import mean_of_draws, with_draw

    sums: dict[str, DataFrame] = {}
    for t in range(burn_in + samples):
        for by, other in (("src_id", "dst_id"), ("dst_id", "src_id")):
            mine, theirs = (alpha, beta) if by == "src_id" else (beta, alpha)
            rows = obs.join(theirs.withColumnRenamed("value", "o"), other).withColumn("o", F.col("o") + b)
            new = cut(effects_step(rows, by, "o", mine, var, seed, t))
            forget(mine)
            if centred:
                drawn = new
                new = cut(drawn.withColumn("value", F.col("value") - drawn.agg(F.avg("value")).first()[0]))
                forget(drawn)
            alpha, beta = (new, beta) if by == "src_id" else (alpha, new)
            if t >= burn_in:
                sums[by] = with_draw(sums.get(by), new.select(by, F.col("value").alias("mean")), [by])
    out = [cut(mean_of_draws(sums[by], [by], False).select(by, F.col("mean").alias("value"))) for by in ("src_id", "dst_id")]
    forget(alpha, beta, *sums.values())
    return out[0], out[1], b


def fit_factors(obs: DataFrame, n_factors: int, samples: int = 10, burn_in: int = 5, var: float = 1.0, seed: int = 0, knot: float | None = None) -> tuple[dict[str, DataFrame], float]:
    """Means over draws of alpha, beta (id, value) and u, v (id, value, an array) of y ~ link(b + alpha + beta + <u, v>), and b: every coordinate of every effect is drawn by
    adaptive rejection in turn, its multiplier being the other end's coordinate."""
    from ..functions.columns import dot

    p = obs.agg(F.avg(F.col("y").cast("double"))).first()[0]
    b = float(np.log(p / (1 - p))) if knot is None else 0.0
    ends = {"src_id": ("alpha", "u"), "dst_id": ("beta", "v")}
    start = lambda by: F.array(*(((F.pmod(F.xxhash64(F.lit(seed), F.lit(by), F.lit(k), by), F.lit(1 << 20)) / float(1 << 20)) - 0.5 for k in range(n_factors))))
    state: dict[str, DataFrame] = {}
    for by, (main, vector) in ends.items():
        ids = obs.select(by).distinct()
        state[main] = cut(ids.withColumn("value", F.lit(0.0)))
        state[vector] = cut(ids.withColumn("value", start(by)))
    sums: dict[str, DataFrame] = {}

    def scored() -> DataFrame:
        out = obs
        for by, names in ends.items():
            for n in names:
                out = out.join(state[n].withColumnRenamed("value", n), by)
        return out.withColumn("score", b + F.col("alpha") + F.col("beta") + dot(F.col("u"), F.col("v")))

    def put(name: str, new: DataFrame) -> None:
        old, state[name] = state[name], cut(new)
        forget(old)

    for t in range(burn_in + samples):
        for by, (main, vector) in ends.items():
            other = "v" if vector == "u" else "u"
            put(main, effects_step(scored().withColumn("o", F.col("score") - F.col(main)), by, "o", state[main], var, seed, f"{t}|{main}", knot=knot))
            for k in range(n_factors):
                rows = scored().withColumn("m", F.col(other)[k]).withColumn("o", F.col("score") - F.col(vector)[k] * F.col(other)[k])
                own = state[vector].select(by, F.col("value")[k].alias("value"))
                new = effects_step(rows, by, "o", own, var, seed, f"{t}|{vector}{k}", "m", knot).withColumnRenamed("value", "__new")
                put(vector, state[vector].join(new, by).select(by, F.transform("value", lambda x, i: F.when(i == k, F.col("__new")).otherwise(x)).alias("value")))  # noqa: B023
        if t >= burn_in:
            for by, names in ends.items():
                for n in names:
                    one = state[n].withColumn("value", F.array("value") if n in ("alpha", "beta") else F.col("value"))
                    if n not in sums:
                        sums[n] = cut(one)
                        continue
                    old = sums[n]
                    sums[n] = cut(old.join(one.withColumnRenamed("value", "__v"), by).select(by, F.zip_with("value", "__v", lambda x, y: x + y).alias("value")))
                    forget(old)
    mean = {n: s.withColumn("value", F.transform("value", lambda x: x / samples)) for n, s in sums.items()}
    return {n: s.withColumn("value", F.col("value")[0]) if n in ("alpha", "beta") else s for n, s in mean.items()}, b


def spline_knot(scored: DataFrame, y: str, score: str, low: float = 0.001, high: float = 0.8, steps: int = 20) -> float:
    """The link's value at 0 with the best likelihood, by golden section; a probe is one aggregate."""
    from ..functions.columns import spline_link

    def loss(a: float) -> float:
        p = F.greatest(F.least(spline_link(a, F.col(score)), F.lit(1 - 1e-12)), F.lit(1e-12))
        return -scored.agg(F.avg(F.when(F.col(y) > 0, F.log(p)).otherwise(F.log(1 - p)))).first()[0]

    g = (5**0.5 - 1) / 2
    a, b = low, high
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = loss(c), loss(d)
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = loss(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = loss(d)
    return (a + b) / 2


def bounded_regression(df: DataFrame, features: str, y: str, low: list[float], high: list[float], l2: float = 0.0):
    """Logistic regression with bounds on coefficients (pyspark.ml)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Matrices

    rows = df.select(array_to_vector(features).alias("features"), F.col(y).cast("double").alias("label"))
    k = len(low)
    return LogisticRegression(regParam=l2, lowerBoundsOnCoefficients=Matrices.dense(1, k, low), upperBoundsOnCoefficients=Matrices.dense(1, k, high)).fit(rows)
