"""Beta-Binomial rates over DAGs: moment estimates, posterior modes, held-out likelihood and coverage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import betabinom_cdf, betabinom_loglik
from .graph import closure, cut, forget, leaves, levels

# Bounds of the correlation between draws of one rate.
RHO_LEAST, RHO_MOST = 1e-20, 1 - 1e-20


def moment_sums(x: Column, n: Column, w: Column) -> list[Column]:
    """Sums that moment estimates need, mergeable over parts of the data; rows with n = 0 must be gone."""
    p = x / n
    named = {"N": F.lit(1.0), "w": w, "ww": w * w, "wp": w * p, "wpp": w * p * p, "wn": w / n, "wwn": w * w / n}
    return [F.sum(v).alias(f"m_{k}") for k, v in named.items()]


def moment_estimates(sums: DataFrame) -> DataFrame:
    """Adds mean and size to rows of moment sums: the size matches the weighted spread of rates."""
    c = lambda k: F.col(f"m_{k}")
    mean = c("wp") / c("w")
    pq = mean * (1 - mean)
    spread = (c("wpp") - c("w") * mean * mean) * (c("N") - 1) / c("N")
    noise = c("wn") - c("wwn") / c("w")
    rho = F.try_divide(spread - pq * noise, pq * (c("w") - c("ww") / c("w") - noise))
    rho = F.least(F.greatest(rho, F.lit(RHO_LEAST)), F.lit(RHO_MOST))
    return sums.withColumn("mean", mean).withColumn("size", 1 / rho - 1)


def estimate(obs: DataFrame, by: list[str], x: str = "n_pos", n: str = "n_trials", refine: bool = False) -> DataFrame:
    """(by..., N, mean, size) with weights n; refined, once more with n / (1 + (n - 1) / (size + 1))."""
    rows = obs.where(F.col(n) > 0)
    cx, cn = F.col(x).cast("double"), F.col(n).cast("double")
    first = moment_estimates(rows.groupBy(*by).agg(*moment_sums(cx, cn, cn)))
    if not refine:
        return first.select(*by, F.col("m_N").cast("long").alias("N"), "mean", "size")
    again = rows.join(first.select(*by, F.col("size").alias("__s")), by)
    w = cn / (1 + (cn - 1) / (F.col("__s") + 1))
    return moment_estimates(again.groupBy(*by).agg(*moment_sums(cx, cn, w))).select(*by, F.col("m_N").cast("long").alias("N"), "mean", "size")


def naive_estimate(obs: DataFrame, by: list[str], x: str = "n_pos", n: str = "n_trials") -> DataFrame:
    """(by..., mean, size) from the unweighted mean and variance of rates."""
    p = F.col(x) / F.col(n)
    out = obs.where(F.col(n) > 0).groupBy(*by).agg(F.avg(p).alias("mean"), F.var_samp(p).alias("__v"))
    pq = F.col("mean") * (1 - F.col("mean"))
    size = F.when(F.col("__v") >= pq, 1e-20).when(F.col("__v") == 0, 1e20).otherwise(pq / F.col("__v") - 1)
    return out.select(*by, "mean", size.alias("size"))


#: What becomes of a cell: a moment estimate, a posterior mode, too little data, no valid estimate, only a moment estimate where a mode is wanted, a mode that failed.
OK, MODE, LOW_SUPPORT, NO_ESTIMATE, MOMENT_ONLY, MODE_FAILED = 1, 2, 0, -1, -2, -3


def dag_moments(obs: DataFrame, pop_up: DataFrame, tre_up: DataFrame, min_obs: int = 1, min_pos: float = 0, min_trials: float = 0) -> DataFrame:
    """(p_node, t_node, N, mean, size, status) of every pair of ancestors: observations (p_node, t_node, n_pos, n_trials) meet both closures."""
    sums = moment_sums(F.col("n_pos").cast("double"), F.col("n_trials").cast("double"), F.col("n_trials").cast("double"))
    wide = (
        obs.where("n_trials > 0")
        .join(pop_up.select(F.col("node").alias("p_node"), F.col("ancestor").alias("pa")), "p_node")
        .join(tre_up.select(F.col("node").alias("t_node"), F.col("ancestor").alias("ta")), "t_node")
    )
    cells = moment_estimates(wide.groupBy(F.col("pa").alias("p_node"), F.col("ta").alias("t_node")).agg(*sums, F.sum("n_pos").alias("x"), F.sum("n_trials").alias("n")))
    low = (F.col("m_N") < min_obs) | (F.col("x") < min_pos) | (F.col("n") < min_trials)
    valid = (F.col("m_N") > 2) & (F.col("m_wp") > 0) & (F.col("mean") > 0) & (F.col("mean") < 1) & (F.col("size") > 0)
    status = F.when(low, LOW_SUPPORT).when(~F.coalesce(valid, F.lit(False)), NO_ESTIMATE).otherwise(OK)
    return cells.select("p_node", "t_node", F.col("m_N").cast("long").alias("N"), "mean", "size", status.alias("status"))


# --- posterior modes -----------------------------------------------------------------------------


#: Values up to which log Gamma terms are summed one by one; greater ones go through Stirling's series, so memory grows with the number of distinct values and not with the values.
SMALL = 256


@dataclass
class Counts:
    """How often values occur: small[j] is the (weighted) number of small values that exceed j; large values and their numbers stand apart."""

    small: np.ndarray
    large: np.ndarray
    times: np.ndarray

    def sum(self) -> float:
        return float(self.small.sum() + (self.large * self.times).sum())


def tails(v: np.ndarray, weight: np.ndarray | None = None, small: int = SMALL) -> Counts:
    """Values as the likelihood needs them."""
    v = v.astype(np.int64)
    w = np.ones(len(v)) if weight is None else np.asarray(weight, float)
    big = v > small
    few = v[~big]
    c = np.bincount(few, w[~big], few.max() + 1) if len(few) else np.zeros(1)
    return Counts(c[::-1].cumsum()[::-1][1:], v[big].astype(float), w[big])


def gamma_steps(z: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log Gamma(z + v) - log Gamma(z), and the differences of its first and second derivatives (the last one negated), for v >= 0, without cancellation where z is large."""
    shift = 16
    j = np.arange(shift)
    # From z to z + 16 on both sides, then Stirling's series.
    lo, hi = z + shift, z + v + shift
    near = z + v[:, None] + j
    value = np.log(z + j).sum() - np.log(near).sum(1)
    first = (1 / (z + j)).sum() - (1 / near).sum(1)
    second = (1 / (z + j) ** 2).sum() - (1 / near**2).sum(1)
    tail = lambda x: 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    step = np.log1p(v / lo)
    value += (hi - 0.5) * step + v * np.log(lo) - v + tail(hi) - tail(lo)
    d1 = lambda x: -1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    first += step + d1(hi) - d1(lo)
    d2 = lambda x: 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7)
    second += v / (lo * hi) + d2(lo) - d2(hi)
    return value, first, second


def _series(c: Counts, z: float) -> tuple[float, float, float]:
    """Sums over all values v and j < v of log(z + j), 1 / (z + j) and 1 / (z + j)^2."""
    j = z + np.arange(len(c.small))
    out = (c.small * np.log(j)).sum(), (c.small / j).sum(), (c.small / j**2).sum()
    if not len(c.large):
        return out
    return tuple(a + (c.times * b).sum() for a, b in zip(out, gamma_steps(z, c.large)))


def loglik_terms(theta: np.ndarray, tx: Counts, ty: Counts, tn: Counts, prior: tuple | None) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood (without binomial coefficients) at (logit mean, log size), its gradient and Hessian, from the counts of x, n - x and n."""
    m, g = 1 / (1 + np.exp(-theta[0])), np.exp(theta[1])
    (vx, ax, axx), (vy, by, byy), (vn, gn, gnn) = _series(tx, m * g), _series(ty, (1 - m) * g), _series(tn, g)
    value = vx + vy - vn
    # First in (mean, size), then by the chain rule.
    dm, dg = g * (ax - by), m * ax + (1 - m) * by - gn
    dmm, dgg, dmg = -g * g * (axx + byy), -(m * m) * axx - (1 - m) ** 2 * byy + gnn, ax - by - g * (m * axx - (1 - m) * byy)
    u = m * (1 - m)
    grad = np.array([dm * u, dg * g])
    hess = np.array([[dmm * u * u + dm * u * (1 - 2 * m), dmg * u * g], [dmg * u * g, dgg * g * g + dg * g]])
    if prior is not None:
        (m0, s0), (vm, vs) = prior
        d = theta - np.array([m0, s0])
        value -= d[0] ** 2 / (2 * vm) + d[1] ** 2 / (2 * vs)
        grad -= d / np.array([vm, vs])
        hess -= np.diag([1 / vm, 1 / vs])
    return value, grad, hess


def _uphill(hess: np.ndarray, grad: np.ndarray, limit: float) -> np.ndarray:
    """A Newton step for a maximum that goes uphill whatever the Hessian's signs, shortened as a whole: cutting its elements one by one could turn it downhill."""
    values, vectors = np.linalg.eigh(hess)
    size = np.maximum(np.abs(values), 1e-12 * max(np.abs(values).max(), 1e-300))
    delta = -vectors @ ((vectors.T @ grad) / size)
    return delta * min(1.0, limit / max(np.abs(delta).max(), 1e-300))


def newton(start: np.ndarray, terms: Callable, steps: int, search: bool, limit: float = 2.0, eps: float = 1e-8) -> tuple[np.ndarray, bool]:
    theta = start.copy()
    value, grad, hess = terms(theta)
    for _ in range(steps):
        try:
            delta = _uphill(hess, grad, limit) if search else np.linalg.solve(hess, grad)
        except np.linalg.LinAlgError:
            return theta, False
        if not search:
            if delta @ grad > 0:  # not uphill: follow the gradient
                delta = -grad / max(np.abs(np.diag(hess)).max(), 1e-12)
            delta = np.clip(delta, -limit, limit)
        size = 1.0
        new = theta - delta
        new_value, new_grad, new_hess = terms(new)
        # Near the top of a large sum, values differ by their rounding alone; there the gradient tells whether a step is one upwards.
        up = lambda: new_value >= value or (new_value >= value - 1e-10 * max(abs(value), 1.0) and np.abs(new_grad).max() < np.abs(grad).max())  # noqa: B023, E731
        while search and not up() and size > 1e-6:
            size /= 2
            new = theta - size * delta
            new_value, new_grad, new_hess = terms(new)
        if search and not up():
            # Neither value nor gradient gets better along a way that is uphill: the gradient is rounding, if what it promises is.
            return theta, bool(-(grad @ delta) <= 1e-12 * max(abs(value), 1.0))
        if not np.isfinite(new_value):
            return theta, False
        # A shortened step says nothing of how far the mode is.
        done = np.abs(delta).max() < eps
        theta, value, grad, hess = new, new_value, new_grad, new_hess
        if done:
            return theta, True
    return theta, False


def posterior_mode(x: np.ndarray, n: np.ndarray, prior_mean: float | None = None, prior_size: float | None = None, var_logit: float = 1.0, var_log: float = 1.0, start: tuple[float, float] | None = None, weight: np.ndarray | None = None) -> tuple[float, float, float, bool]:
    """(mean, size, log-likelihood without prior, converged); without a prior the maximum-likelihood estimate."""
    return mode_of_tails(tails(x, weight), tails(n - x, weight), tails(n, weight), prior_mean, prior_size, var_logit, var_log, start)


def mode_of_tails(tx: Counts, ty: Counts, tn: Counts, prior_mean: float | None = None, prior_size: float | None = None, var_logit: float = 1.0, var_log: float = 1.0, start: tuple[float, float] | None = None) -> tuple[float, float, float, bool]:
    """The same from the counts of x, n - x and n, which are all that the likelihood needs. Starts: moments and prior, first plain, then with a line search."""
    prior = None
    starts = []
    if start is not None:
        starts.append(start)
    if prior_mean is not None and prior_size is not None:
        prior = ((np.log(prior_mean / (1 - prior_mean)), np.log(prior_size)), (var_logit, var_log))
        starts.append((prior_mean, prior_size))
    share = float(np.clip(tx.sum() / max(tn.sum(), 1), 1e-6, 1 - 1e-6))
    starts = starts or [(share, 10.0)]
    terms = lambda t: loglik_terms(t, tx, ty, tn, prior)
    best, best_value, ok = None, -np.inf, False
    for steps, search in ((20, False), (100, True)):
        for m, s in starts:
            m, s = float(np.clip(m, 1e-9, 1 - 1e-9)), float(np.clip(s, 1e-9, 1e12))
            with np.errstate(all="ignore"):
                theta, done = newton(np.array([np.log(m / (1 - m)), np.log(s)]), terms, steps, search)
                value = terms(theta)[0]
            if done and value > best_value:
                best, best_value, ok = theta, value, True
        if ok:
            break
    if best is None:
        best = np.array([np.log(share / (1 - share)), np.log(starts[0][1])])
    mean, size = 1 / (1 + np.exp(-best[0])), float(np.exp(best[1]))
    return float(mean), size, float(loglik_terms(best, tx, ty, tn, None)[0]), ok


def histograms(obs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., kind, v, k): how often each group has a value v of x (kind 0), n - x (1) and n (2). A group is bounded by its distinct values, whatever its rows and however large these are."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(v).cast("long").alias("v")) for k, v in enumerate(("n_pos", "__rest", "n_trials"))))
    rows = obs.where("n_trials > 0").withColumn("__rest", F.col("n_trials") - F.col("n_pos"))
    return rows.select(*by, F.inline(kinds)).groupBy(*by, "kind", "v").agg(F.count("*").alias("k"))


def _tails_of(group: pd.DataFrame) -> list[Counts]:
    return [tails(own["v"].to_numpy(), own["k"].to_numpy()) for own in (group[group["kind"] == k] for k in range(3))]


def fit_cells(obs: DataFrame, by: list[str], priors: DataFrame | None = None, var_logit: float = 1.0, var_log: float = 1.0) -> DataFrame:
    """(by..., mean, size, loglik, ok): a mode for each group, from the histograms of its values."""
    counted = histograms(obs, by)
    if priors is not None:
        counted = counted.join(priors.select(*by, "prior_mean", "prior_size"), by, "left")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema if f.name in by)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        prior = (group["prior_mean"].iat[0], group["prior_size"].iat[0]) if "prior_mean" in group and pd.notna(group["prior_mean"].iat[0]) else (None, None)
        mean, size, value, ok = mode_of_tails(*_tails_of(group), *prior, var_logit, var_log)
        return pd.DataFrame({**{c: [group[c].iat[0]] for c in by}, "mean": [mean], "size": [size], "loglik": [value], "ok": [ok]})

    return counted.groupBy(*by).applyInPandas(run, f"{schema}, mean double, size double, loglik double, ok boolean")


def likelihood_terms(obs: DataFrame, by: list[str], mean: float, size: float) -> DataFrame:
    """(by..., loglik, d_mean, d_size): log-likelihood without binomial coefficients at one point, and its gradient in logit mean and log size."""
    counted = histograms(obs, by)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema if f.name in by)
    theta = np.array([np.log(mean / (1 - mean)), np.log(size)])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        value, grad, _ = loglik_terms(theta, *_tails_of(group), None)
        return pd.DataFrame({**{c: [group[c].iat[0]] for c in by}, "loglik": [value], "d_mean": [grad[0]], "d_size": [grad[1]]})

    return counted.groupBy(*by).applyInPandas(run, f"{schema}, loglik double, d_mean double, d_size double")


def likeliest_parent(own: DataFrame, parents: DataFrame) -> DataFrame:
    """A prior setter: the parameters of the parent under which the node's data are likeliest."""
    value = betabinom_loglik(F.col("n_pos").cast("double"), F.col("n_trials").cast("double"), F.col("pm"), F.col("ps"), choose=False)
    fit = own.join(parents, "p_node").groupBy("p_node", "up", "pm", "ps").agg(F.sum(value).alias("v"))
    return fit.groupBy("p_node").agg(F.max_by(F.struct("pm", "ps"), F.struct("v", "up")).alias("b")).select("p_node", F.col("b.pm").alias("prior_mean"), F.col("b.ps").alias("prior_size"))


def average_parent(own: DataFrame, parents: DataFrame) -> DataFrame:
    """A prior setter: the mean of the parents' means and the geometric mean of their sizes."""
    return parents.groupBy("p_node").agg(F.avg("pm").alias("prior_mean"), F.exp(F.avg(F.log("ps"))).alias("prior_size"))


#: Sets priors: a level's data (p_node, n_pos, n_trials) and its nodes' fitted parents (p_node, up, pm, ps) -> (p_node, prior_mean, prior_size).
PriorSetter = Callable[[DataFrame, DataFrame], DataFrame]


def dag_posterior_modes(
    obs: DataFrame, pop: DataFrame, pop_up: DataFrame, root_mean: float, root_size: float, var_logit: float, var_log: float, node: str = "node_id", parent: str = "parent_id", set_priors: PriorSetter = likeliest_parent
) -> DataFrame:
    """(p_node, mean, size, loglik, ok) from the root down: a node's prior comes from its parents by `set_priors`.

    Levels follow one another; the cells of a level are independent groups.
    """
    depth = cut(levels(pop, node, parent))
    wide = cut(obs.join(pop_up.select(F.col("node").alias("p_node"), F.col("ancestor").alias("cell")), "p_node").select(F.col("cell").alias("p_node"), "n_pos", "n_trials"))
    last = depth.agg(F.max("level")).first()[0] or 0
    out = None
    for k in range(last + 1):
        nodes = depth.where(F.col("level") == k).select(F.col("node").alias("p_node"))
        own = wide.join(nodes, "p_node", "left_semi")
        if k == 0:
            priors = nodes.select("p_node", F.lit(root_mean).alias("prior_mean"), F.lit(root_size).alias("prior_size"))
        else:
            up = pop.where(f"{parent} is not null").select(F.col(node).alias("p_node"), F.col(parent).alias("up"))
            cand = up.join(nodes, "p_node", "left_semi").join(out.where("ok").select(F.col("p_node").alias("up"), F.col("mean").alias("pm"), F.col("size").alias("ps")), "up")
            priors = set_priors(own, cand.select("p_node", "up", "pm", "ps"))
        done = cut(fit_cells(own, ["p_node"], priors, var_logit, var_log))
        out = done if out is None else out.unionByName(done)
    forget(depth, wide)
    return out


# --- pairs of two DAGs ---------------------------------------------------------------------------


@dataclass
class PairRule:
    """When a cell has support, when its moment estimate is enough, and the range of valid estimates."""

    min_obs: int = 3
    min_pos: float = 0
    min_trials: float = 10
    moment_obs: float = float("inf")
    moment_trials: float = 0
    least: tuple[float, float] = (1e-10, 1e-10)
    most: tuple[float, float] = (1 - 1e-10, 1e10)


def _wide(obs: DataFrame, pop_up: DataFrame, tre_up: DataFrame) -> DataFrame:
    """(pa, ta, ...): rows of cells at every pair of ancestors."""
    up = obs.join(pop_up.select(F.col("node").alias("p_node"), F.col("ancestor").alias("pa")), "p_node").join(tre_up.select(F.col("node").alias("t_node"), F.col("ancestor").alias("ta")), "t_node")
    return up.drop("p_node", "t_node").withColumnsRenamed({"pa": "p_node", "ta": "t_node"})


def pair_histograms(obs: DataFrame, pop_up: DataFrame, tre_up: DataFrame) -> DataFrame:
    """(p_node, t_node, kind, v, k) of every pair of ancestors: leaf cells are counted first, then their counts are added upwards."""
    base = histograms(obs, ["p_node", "t_node"])
    return _wide(base, pop_up, tre_up).groupBy("p_node", "t_node", "kind", "v").agg(F.sum("k").alias("k"))


def _best_prior(tails_: list[Counts], candidates: list) -> tuple[float, float] | None:
    """The parent under which a cell's data are likeliest; ties go to the first in the order of the nodes' names."""
    best, found = -np.inf, None
    for c in sorted(candidates, key=lambda c: str(c["up"])):
        m, s = c["pm"], c["ps"]
        value = loglik_terms(np.array([np.log(m / (1 - m)), np.log(s)]), *tails_, None)[0]
        if value > best:
            best, found = value, (m, s)
    return found


def pair_modes(
    obs: DataFrame, pop: DataFrame, tre: DataFrame, root_mean: float, root_size: float, var_logit: float, var_log: float, rule: PairRule | None = None, node: str = "node_id", parent: str = "parent_id", fixed_prior: bool = False
) -> DataFrame:
    """(p_node, t_node, n_obs, mean, size, loglik, status) of every pair of nodes of two DAGs that observations (p_node, t_node, n_pos, n_trials) reach.

    The pair of roots has the given prior; another cell's prior is the fitted one among its immediate parents on either side (a parent of p_node with t_node, p_node with a parent of t_node)
    under which its data are likeliest, or the given one for all if fixed_prior. Cells of one sum of levels are independent, so waves over this sum follow one another; a cell meets its
    task as a histogram of distinct values. Without a valid parent a cell is fitted to the given prior and marked as failed. Pairs that no observation reaches have no row.
    """
    rule = rule or PairRule()
    pop_up, tre_up = closure(pop, node, parent), closure(tre, node, parent)
    depth_p, depth_t = cut(levels(pop, node, parent)), cut(levels(tre, node, parent))
    rows = obs.where("n_trials > 0")
    sums = moment_sums(F.col("n_pos").cast("double"), F.col("n_trials").cast("double"), F.col("n_trials").cast("double"))
    leaf = rows.groupBy("p_node", "t_node").agg(*sums, F.sum("n_pos").alias("x"), F.sum("n_trials").alias("n"))
    cells = moment_estimates(_wide(leaf, pop_up, tre_up).groupBy("p_node", "t_node").agg(*(F.sum(c).alias(c) for c in leaf.columns if c not in ("p_node", "t_node"))))
    low = (F.col("m_N") < rule.min_obs) | (F.col("x") < rule.min_pos) | (F.col("n") < rule.min_trials)
    inside = F.col("mean").between(rule.least[0], rule.most[0]) & F.col("size").between(rule.least[1], rule.most[1]) & (F.col("m_N") > 2)
    enough = (F.col("m_N") >= rule.moment_obs) & (F.col("n") / F.col("m_N") >= rule.moment_trials)
    status = F.when(low, LOW_SUPPORT).when(F.coalesce(inside & enough, F.lit(False)), OK).when(F.coalesce(inside, F.lit(False)), MOMENT_ONLY).otherwise(NO_ESTIMATE)
    cells = cells.join(depth_p.select(F.col("node").alias("p_node"), F.col("level").alias("lp")), "p_node").join(depth_t.select(F.col("node").alias("t_node"), F.col("level").alias("lt")), "t_node")
    cells = cut(cells.select("p_node", "t_node", F.col("m_N").cast("long").alias("n_obs"), "mean", "size", status.alias("status"), (F.col("lp") + F.col("lt")).alias("wave")))
    counted = cut(pair_histograms(rows, pop_up, tre_up).join(cells.where(F.col("status") < 0).select("p_node", "t_node", "wave"), ["p_node", "t_node"]))
    blank = F.lit(None).cast("double")
    out = cut(cells.where("status >= 0").select("p_node", "t_node", "n_obs", F.when(F.col("status") == OK, F.col("mean")).alias("mean"), F.when(F.col("status") == OK, F.col("size")).alias("size"), blank.alias("loglik"), "status"))
    ups = {k: cut(d.where(f"{parent} is not null").select(F.col(node).alias(f"{k}_node"), F.col(parent).alias("up"))) for k, d in (("p", pop), ("t", tre))}
    p_type, t_type = cells.schema["p_node"].dataType.simpleString(), cells.schema["t_node"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own, cand = _tails_of(group), group["priors"].iat[0]
        cand = [] if cand is None else list(cand)
        prior = (root_mean, root_size) if fixed_prior or not group["wave"].iat[0] else _best_prior(own, cand)
        mean, size, value, ok = mode_of_tails(*own, *(prior or (root_mean, root_size)), var_logit, var_log)
        mean, size = float(np.clip(mean, rule.least[0], rule.most[0])), float(np.clip(size, rule.least[1], rule.most[1]))
        return pd.DataFrame({"p_node": group["p_node"].iloc[:1], "t_node": group["t_node"].iloc[:1], "mean": mean, "size": size, "loglik": value, "status": MODE if ok and prior else MODE_FAILED})

    for wave in range((cells.agg(F.max("wave")).first()[0] or 0) + 1):
        own = counted.where(F.col("wave") == wave)
        mine = cells.where((F.col("wave") == wave) & (F.col("status") < 0))
        fitted = out.where("status > 0").select(F.col("p_node").alias("fp"), F.col("t_node").alias("ft"), F.col("mean").alias("pm"), F.col("size").alias("ps"))
        by_p = mine.join(ups["p"], "p_node").join(fitted, (F.col("up") == F.col("fp")) & (F.col("t_node") == F.col("ft")))
        by_t = mine.join(ups["t"], "t_node").join(fitted, (F.col("up") == F.col("ft")) & (F.col("p_node") == F.col("fp")))
        named = lambda df, k: df.select("p_node", "t_node", F.concat(F.lit(f"{k}/"), F.col("up").cast("string")).alias("up"), "pm", "ps")
        # A cell has as many candidates as it has parents.
        cand = named(by_p, "p").unionByName(named(by_t, "t")).groupBy("p_node", "t_node").agg(F.collect_list(F.struct("up", "pm", "ps")).alias("priors"))
        done = own.join(cand, ["p_node", "t_node"], "left").groupBy("p_node", "t_node").applyInPandas(run, f"p_node {p_type}, t_node {t_type}, mean double, size double, loglik double, status int")
        done = done.join(mine.select("p_node", "t_node", "n_obs"), ["p_node", "t_node"]).select("p_node", "t_node", "n_obs", "mean", "size", "loglik", "status")
        last, out = out, cut(out.unionByName(done))
        forget(last)
    forget(depth_p, depth_t, cells, counted, *ups.values())
    return out


def mode_gradients(counted: DataFrame, modes: DataFrame, prior_mean: float, prior_size: float, var_logit: float, var_log: float) -> DataFrame:
    """(p_node, t_node, slope): the greatest partial derivative of each cell's log-posterior, in logit mean and log size, at its mode: sums of reciprocals in plain columns, apart from the code that found it."""
    a, g = F.col("mean") * F.col("size"), F.col("size")
    theta = (F.log(F.col("mean") / (1 - F.col("mean"))), F.log("size"))
    rows = counted.join(modes.select("p_node", "t_node", "mean", "size"), ["p_node", "t_node"])
    z = F.when(F.col("kind") == 0, a).when(F.col("kind") == 1, g - a).otherwise(g)
    v = F.col("v").cast("double")
    # Sum of 1 / (z + j) for j < v.
    step = F.aggregate(F.sequence(F.lit(0), F.greatest(F.col("v") - 1, F.lit(0))), F.lit(0.0), lambda s, j: s + 1 / (z + j))
    digamma = F.when(v > 0, step).otherwise(0.0) * F.col("k")
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, digamma).otherwise(0.0))
    sums = rows.groupBy("p_node", "t_node", "mean", "size").agg(part(0).alias("dx"), part(1).alias("dy"), part(2).alias("dn"))
    m = F.col("mean")
    by_mean = g * m * (1 - m) * (F.col("dx") - F.col("dy")) - (theta[0] - float(np.log(prior_mean / (1 - prior_mean)))) / var_logit
    by_size = g * (m * F.col("dx") + (1 - m) * F.col("dy") - F.col("dn")) - (theta[1] - float(np.log(prior_size))) / var_log
    return sums.select("p_node", "t_node", F.greatest(F.abs(by_mean), F.abs(by_size)).alias("slope"))


def pair_loglik(test: DataFrame, params: DataFrame, pop: DataFrame, tre: DataFrame, node: str = "node_id", parent: str = "parent_id") -> dict[str, float]:
    """Mean log-likelihood per observation of held-out rows, averaged over cells with an estimate: over all (entire), over those whose t_node is a leaf (leaf), and over these and the cells that have
    held-out rows in a child without support (frontier)."""
    pop_up, tre_up = closure(pop, node, parent), closure(tre, node, parent)
    wide = _wide(test.where("n_trials > 0"), pop_up, tre_up)
    each = cut(heldout_loglik(wide, params.where("status > 0"), ["p_node", "t_node"]))
    ends = leaves(tre, node, parent).select(F.col(node).alias("t_node"), F.lit(True).alias("leaf"))
    poor = params.where(F.col("status") == LOW_SUPPORT).join(wide.select("p_node", "t_node").distinct(), ["p_node", "t_node"])
    above = poor.join(tre.where(f"{parent} is not null").select(F.col(node).alias("t_node"), F.col(parent).alias("up")), "t_node").select("p_node", F.col("up").alias("t_node"), F.lit(True).alias("edge")).distinct()
    marked = each.join(ends, "t_node", "left").join(above, ["p_node", "t_node"], "left")
    leaf, edge = F.coalesce("leaf", F.lit(False)), F.coalesce("edge", F.lit(False))
    row = marked.agg(F.avg("loglik").alias("entire"), F.avg(F.when(leaf | edge, F.col("loglik"))).alias("frontier"), F.avg(F.when(leaf, F.col("loglik"))).alias("leaf")).first()
    forget(each)
    return row.asDict()


def tuned_pairs(
    train: DataFrame, tune: DataFrame, pop: DataFrame, tre: DataFrame, root: tuple[float, float], grid: list[tuple[float, float]], criterion: str = "entire", rule: PairRule | None = None
) -> tuple[DataFrame, list[dict]]:
    """The fit with the best held-out likelihood by the criterion (entire, frontier or leaf), and a summary row for each point (var_logit, var_log) of the grid."""
    if criterion not in ("entire", "frontier", "leaf"):
        raise ValueError("criterion is entire, frontier or leaf")
    best, rows = None, []
    for vm, vs in grid:
        params = pair_modes(train, pop, tre, *root, vm, vs, rule)
        counts = {r[0]: r[1] for r in params.groupBy("status").count().collect()}
        rows.append({"var_logit": vm, "var_log": vs, "low": counts.get(LOW_SUPPORT, 0), "failed": counts.get(MODE_FAILED, 0), **pair_loglik(tune, params, pop, tre)})
        value = rows[-1][criterion]
        if best is None or (value is not None and value > (best[1] if best[1] is not None else -np.inf)):
            if best:
                forget(best[0])
            best = (params, value)
        else:
            forget(params)
    return best[0], rows


# --- evaluation ----------------------------------------------------------------------------------


def heldout_loglik(test: DataFrame, params: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, loglik): mean log-likelihood for each cell; `overall` averages cells."""
    value = betabinom_loglik(F.col("n_pos").cast("double"), F.col("n_trials").cast("double"), F.col("mean"), F.col("size"))
    return test.where("n_trials > 0").join(params.select(*by, "mean", "size"), by).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("loglik"))


def coverage(test: DataFrame, params: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """(by..., covered): mean share of observations inside [low, high] of their predictive distribution; an atom that a bound cuts counts by the part inside."""
    x, n = F.col("n_pos").cast("double"), F.col("n_trials").cast("double")
    upto = betabinom_cdf(x, n, F.col("mean"), F.col("size"))
    below = betabinom_cdf(x - 1, n, F.col("mean"), F.col("size"))
    rows = test.where("n_trials > 0").join(params.select(*by, "mean", "size"), by).withColumn("__hi", upto).withColumn("__lo", below)
    inside = F.greatest(F.least(F.col("__hi"), F.lit(high)) - F.greatest(F.col("__lo"), F.lit(low)), F.lit(0.0))
    share = F.when(F.col("__hi") > F.col("__lo"), inside / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(0.0))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(share).alias("covered"))


def tuned(train: DataFrame, tune: DataFrame, pop: DataFrame, pop_up: DataFrame, root: tuple[float, float], var_logits: list[float], var_logs: list[float]) -> tuple[tuple[float, float], list[dict]]:
    """The grid point with the best held-out likelihood over cells, and all of them."""
    train, tune = train.cache(), tune.cache()
    wide = tune.join(pop_up.select(F.col("node").alias("p_node"), F.col("ancestor").alias("cell")), "p_node").select(F.col("cell").alias("p_node"), "n_pos", "n_trials")
    rows = []
    for vm, vs in product(var_logits, var_logs):
        params = dag_posterior_modes(train, pop, pop_up, *root, vm, vs)
        rows.append({"var_logit": vm, "var_log": vs, "loglik": heldout_loglik(wide, params, ["p_node"]).agg(F.avg("loglik")).first()[0]})
    train.unpersist()
    tune.unpersist()
    best = max(rows, key=lambda r: r["loglik"])
    return (best["var_logit"], best["var_log"]), rows


def save_fit(params: DataFrame, summary: list[dict], path: str) -> None:
    """Parameters of the chosen fit as a table, and a row for each grid point added to the summary."""
    params.write.mode("overwrite").parquet(f"{path}/model")
    rows = [(float(r["var_logit"]), float(r["var_log"]), float(r["loglik"])) for r in summary]
    params.sparkSession.createDataFrame(rows, "var_logit double, var_log double, loglik double").write.mode("append").parquet(f"{path}/summary")


def size_of_moments(mean: Column, var_of_mean: Column) -> Column:
    """alpha + beta of the Beta distribution with these moments."""
    return F.try_divide(mean * (1 - mean), var_of_mean) - 1


def cube_moments(base: DataFrame, dims: dict[str, DataFrame], x: str = "n_pos", n: str = "n_trials") -> DataFrame:
    """Moment estimates of every cell of a cube over tree dimensions: base rows are summed by their own cells first, and the sums are merged upwards."""
    from functools import reduce

    keys = list(dims)
    cx, cn = F.col(x).cast("double"), F.col(n).cast("double")
    sums = base.where(F.col(n) > 0).groupBy(*keys).agg(*moment_sums(cx, cn, cn))
    wide = reduce(lambda df, k: df.join(dims[k].select(F.col("node").alias(k), F.col("ancestor").alias(f"__{k}")), k), keys, sums)
    merged = wide.groupBy(*(F.col(f"__{k}").alias(k) for k in keys)).agg(*(F.sum(c).alias(c) for c in sums.columns if c.startswith("m_")))
    return moment_estimates(merged).select(*keys, F.col("m_N").cast("long").alias("N"), "mean", "size")
