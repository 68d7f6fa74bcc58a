"""Models against dense brute force, invariants, and recovery of simulated truth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadic.operators import betabinom as B
from dyadic.operators import factor as X
from dyadic.operators import graph as G
from dyadic.operators import logistic as L
from dyadic.operators import multiapp as A
from dyadic.operators import multicontext as M
from dyadic.operators import simulate as sim
from dyadic.operators import smooth as S
from dyadic.operators import topics as P
from dyadic.operators.regressors import ElasticNet, Forest, Ridge, best_ridge
from dyadic.streaming import online


def gaussian_posterior(prior, design, y, noise):
    inv = np.linalg.inv(prior)
    cov = np.linalg.inv(inv + design.T @ np.diag(1 / noise) @ design)
    return cov @ design.T @ (y / noise), cov


def test_two_level_posterior_equals_dense(spark):
    data = [(1, "A", 1.0, 0.5), (1, "A", 2.0, 1.0), (1, "B", -1.0, 0.3), (2, "B", 0.7, 0.9)]
    model = S.TwoLevel(2.0, {"A": 0.5, "B": 1.5}, {"A": 1.2, "B": -0.7})
    rows = S.two_level_posterior(spark.createDataFrame(data, "item int, category string, obs double, var double"), model).collect()
    q, vb = np.array([1.2, -0.7]), np.array([0.5, 1.5])
    prior = np.zeros((3, 3))
    prior[0, 0] = 2.0
    prior[0, 1:] = prior[1:, 0] = 2.0 * q
    prior[1:, 1:] = 2.0 * np.outer(q, q) + np.diag(vb)
    for item in (1, 2):
        own = [r for r in data if r[0] == item]
        design = np.zeros((len(own), 3))
        for k, r in enumerate(own):
            design[k, 1 + "AB".index(r[1])] = 1
        mean, cov = gaussian_posterior(prior, design, np.array([r[2] for r in own]), np.array([r[3] for r in own]))
        for r in (r for r in rows if r.item == item):
            k = 1 + "AB".index(r.category)
            assert np.allclose([r.mean_a, r.var_a, r.mean_b, r.var_b, r.cov], [mean[0], cov[0, 0], mean[k], cov[k, k], cov[0, k]])


def test_tree_posterior_equals_dense(spark):
    parents = {"a": "r", "b": "r", "c": "a", "d": "a", "e": "b"}
    tree = spark.createDataFrame(list(parents.items()), "node_id string, parent_id string")
    data = [("c", 1.0, 0.5), ("c", 2.0, 0.7), ("d", -1.0, 1.0), ("b", 0.4, 2.0), ("e", 3.0, 0.2)]
    rows = S.tree_posterior(tree, spark.createDataFrame(data, "node string, obs double, var double"), [0.8, 0.3], 0.5, 3.0).collect()
    got, with_parent = {r.node: (r.mean, r.var) for r in rows}, {r.node: r.cov for r in rows}
    names = ["r", "a", "b", "c", "d", "e"]
    up = np.zeros((6, 6))
    for k, n in enumerate(names):
        while n != "r":
            up[k, names.index(n)] = 1
            n = parents[n]
    prior = 3.0 + up @ np.diag([0, 0.8, 0.8, 0.3, 0.3, 0.3]) @ up.T
    design = np.zeros((len(data), 6))
    for k, (n, _, _) in enumerate(data):
        design[k, names.index(n)] = 1
    mean, cov = gaussian_posterior(prior, design, np.array([x for _, x, _ in data]) - 0.5, np.array([v for _, _, v in data]))
    for k, n in enumerate(names):
        assert np.allclose(got[n], (mean[k] + 0.5, cov[k, k]))
        assert with_parent[n] is None if n == "r" else np.isclose(with_parent[n], cov[k, names.index(parents[n])])


def test_two_level_fit_improves_and_beats_cell_means(spark):
    data = sim.two_level(spark, 80, 4, 3).cache()
    fit = S.fit_two_level(data, 4)
    assert all(0.1 < v < 2 for v in fit.model.var_b.values())
    pred = S.predict_two_level(data.where("category < 3"), S.two_level_posterior(data, fit.model))
    smooth = pred.agg(F.avg((F.col("pred") - F.col("b")) ** 2)).first()[0]
    cells = S.baselines(data, data.where("category < 3"), "item", "category", "obs").agg(F.avg((F.col("cell_mean") - F.col("b")) ** 2)).first()[0]
    assert smooth < cells


def test_moments_and_modes_recover_a_rate(spark):
    data = sim.beta_binomial(spark, 1, 3000, 0.2, 15.0).cache()
    m = B.estimate(data, ["p_node"], refine=True).first()
    assert abs(m.mean - 0.2) < 0.01 and 10 < m["size"] < 22
    p = B.fit_cells(data, ["p_node"]).first()
    assert p.ok and abs(p.mean - 0.2) < 0.01 and 12 < p["size"] < 19
    cover = B.coverage(data, B.fit_cells(data, ["p_node"]), ["p_node"], 0.05, 0.95).first().covered
    assert 0.87 < cover < 0.93


def test_gradient_and_hessian():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 40, 30)
    x = rng.binomial(n, 0.3)
    t = (B.tails(x), B.tails(n - x), B.tails(n))
    prior = ((-1.0, 2.0), (0.7, 1.3))
    theta, e = np.array([-0.8, 1.9]), 1e-5
    f = lambda v: B.loglik_terms(v, *t, prior)
    _, grad, hess = f(theta)
    for k in range(2):
        d = np.eye(2)[k] * e
        assert np.isclose((f(theta + d)[0] - f(theta - d)[0]) / (2 * e), grad[k], rtol=1e-5)
        assert np.allclose((f(theta + d)[1] - f(theta - d)[1]) / (2 * e), hess[k], rtol=1e-4, atol=1e-5)


def test_loglik_columns_agree_with_gamma_functions(spark):
    from dyadic.functions import columns as C

    cases = [(0, 5, 0.2, 3.0), (5, 5, 0.5, 100.0), (40, 200, 0.1, 7.5), (150, 1000, 0.9, 0.4)]
    df = spark.createDataFrame([(float(x), float(n), m, s) for x, n, m, s in cases], "x double, n double, m double, s double")
    got = [r[0] for r in df.select(C.betabinom_loglik(*map(F.col, "xnms"))).collect()]
    for value, (x, n, m, s) in zip(got, cases):
        a, b, g = m * s, s - m * s, math.lgamma
        exact = g(n + 1) - g(x + 1) - g(n - x + 1) + g(x + a) - g(a) + g(n - x + b) - g(b) - g(n + s) + g(s)
        assert value == pytest.approx(exact, rel=1e-9, abs=1e-8)
    total = spark.range(21).select(C.betabinom_cdf(F.col("id").cast("double"), F.lit(20.0), F.lit(0.3), F.lit(4.0)).alias("p")).orderBy("id").collect()
    assert total[-1].p == 1.0 and all(a.p < b.p for a, b in zip(total, total[1:]))


def test_dag_modes_pull_to_their_parents(spark):
    pop = spark.createDataFrame([("a", "root"), ("b", "root")], "node_id string, parent_id string")
    obs = spark.createDataFrame([("a", 30, 100)] * 20 + [("b", 2, 5)], "p_node string, n_pos long, n_trials long")
    up = G.closure(pop)
    got = {r.p_node: r for r in B.dag_posterior_modes(obs, pop, up, 0.3, 30.0, 0.05, 0.5).collect()}
    assert set(got) == {"root", "a", "b"} and all(r.ok for r in got.values())
    assert abs(got["b"].mean - got["root"].mean) < 0.05
    best, grid = B.tuned(obs, obs, pop, up, (0.3, 30.0), [0.05, 1.0], [0.5])
    assert best[0] in (0.05, 1.0) and len(grid) == 2


@pytest.mark.parametrize("z", [1e-8, 0.3, 7.0, 1e4, 1e12])
def test_gamma_steps(z):
    v = np.array([0.0, 1, 2, 17, 300, 5000])
    value, first, second = B.gamma_steps(z, v)
    for k, n in enumerate(v.astype(int)):
        j = z + np.arange(n)
        assert np.allclose([value[k], first[k], second[k]], [np.log(j).sum(), (1 / j).sum(), (1 / j**2).sum()], rtol=1e-9, atol=1e-12)


def test_large_counts_take_constant_memory():
    """A row of 10^9 trials: equal to log Gamma, and one tail array whatever the counts."""
    x, n = np.array([3, 250_000_000, 40_000]), np.array([10, 1_000_000_000, 90_000])
    t = (B.tails(x), B.tails(n - x), B.tails(n))
    assert all(len(c.small) <= B.SMALL for c in t)
    value = B.loglik_terms(np.array([0.0, np.log(4.0)]), *t, None)[0]
    lg = math.lgamma
    want = sum(lg(2 + a) + lg(2 + b - a) - lg(4 + b) - 2 * lg(2) + lg(4) for a, b in zip(x.tolist(), n.tolist()))
    assert value == pytest.approx(want, rel=1e-9)
    small, big = (B.mode_of_tails(*(B.tails(v, small=s) for v in (np.arange(5, 60), np.arange(100, 45, -1), np.full(55, 105))), 0.3, 10.0) for s in (256, 0))
    assert np.allclose(small[:3], big[:3], rtol=1e-7)


def test_modes_of_large_flat_likelihoods():
    """Wide counts without overdispersion: a long ridge on which steps cut element by element turned downhill and the search ended without a mode."""
    rng = np.random.default_rng(0)
    n = rng.poisson(2304, 93750)
    own = slice(35, None, 150)
    x, n = rng.binomial(n, 0.25)[own], n[own]
    mean, size, _, ok = B.posterior_mode(x, n, 0.25, 20.0)
    _, slope, hess = B.loglik_terms(np.array([np.log(mean / (1 - mean)), np.log(size)]), B.tails(x), B.tails(n - x), B.tails(n), ((np.log(1 / 3), np.log(20.0)), (1.0, 1.0)))
    assert ok and np.abs(slope).max() < 1e-4 and np.linalg.eigvalsh(hess).max() < 0


def test_pair_modes_against_brute_force(spark):
    """A small product of two DAGs, one of them with a node of two parents."""
    pop = spark.createDataFrame([("a", "root"), ("b", "root"), ("c", "a"), ("c", "b")], "node_id string, parent_id string")
    tre = spark.createDataFrame([("x", "all"), ("y", "all"), ("z", "y")], "node_id string, parent_id string")
    rng = np.random.default_rng(3)
    rows = [(p, t, int(rng.binomial(n, r)), int(n)) for p, t, r in (("a", "x", 0.2), ("b", "z", 0.5), ("c", "x", 0.4), ("c", "z", 0.1), ("b", "x", 0.9)) for n in rng.integers(5, 40, 2 if (p, t) == ("b", "x") else 8)]
    obs = spark.createDataFrame(rows, "p_node string, t_node string, n_pos long, n_trials long")
    got = {(r["p_node"], r["t_node"]): r for r in B.pair_modes(obs, pop, tre, 0.3, 10.0, 0.5, 0.5).collect()}
    up_p = {"root": ["root"], "a": ["a", "root"], "b": ["b", "root"], "c": ["c", "a", "b", "root"]}
    up_t = {"all": ["all"], "x": ["x", "all"], "y": ["y", "all"], "z": ["z", "y", "all"]}
    parents_p, parents_t = {"a": ["root"], "b": ["root"], "c": ["a", "b"], "root": []}, {"x": ["all"], "y": ["all"], "z": ["y"], "all": []}
    data = {}
    for p, t, x, n in rows:
        for pa in up_p[p]:
            for ta in up_t[t]:
                data.setdefault((pa, ta), []).append((x, n))
    assert set(got) == set(data)
    level_p, level_t = {"root": 0, "a": 1, "b": 1, "c": 2}, {"all": 0, "x": 1, "y": 1, "z": 2}
    fitted = {}
    for cell in sorted(data, key=lambda c: level_p[c[0]] + level_t[c[1]]):
        x, n = np.array(data[cell]).T
        if len(x) < 3 or n.sum() < 10:
            assert got[cell]["status"] == B.LOW_SUPPORT and got[cell]["mean"] is None
            continue
        t = (B.tails(x), B.tails(n - x), B.tails(n))
        near = [(f"p/{q}", fitted.get((q, cell[1]))) for q in parents_p[cell[0]]] + [(f"t/{q}", fitted.get((cell[0], q))) for q in parents_t[cell[1]]]
        near = sorted((k, v) for k, v in near if v)
        values = [B.loglik_terms(np.array([np.log(m / (1 - m)), np.log(s)]), *t, None)[0] for _, (m, s) in near]
        prior = (0.3, 10.0) if cell == ("root", "all") else near[int(np.argmax(values))][1]
        mean, size, *_ = B.posterior_mode(x, n, *prior, 0.5, 0.5)
        fitted[cell] = (mean, size)
        assert got[cell]["status"] == B.MODE and got[cell]["mean"] == pytest.approx(mean, rel=1e-6) and got[cell]["size"] == pytest.approx(size, rel=1e-5)
    # Enough rows: the moment estimate stands, unless it is out of range.
    rule = B.PairRule(min_obs=9, moment_obs=12, moment_trials=1)
    assert {r["status"] for r in B.pair_modes(obs, pop, tre, 0.3, 10.0, 0.5, 0.5, rule).collect()} >= {B.OK, B.LOW_SUPPORT}
    best, grid = B.tuned_pairs(obs, obs, pop, tre, (0.3, 10.0), [(0.01, 0.01), (1.0, 1.0)], "frontier")
    assert len(grid) == 2 and all(g["frontier"] is not None and g["leaf"] is not None for g in grid) and best.count() == len(got)
    assert max(g["frontier"] for g in grid) == grid[1]["frontier"]


def test_factor_model_recovers_structure(spark):
    data = sim.dyadic(spark, 6000, nodes=40, contexts=(2, 2, 3), factors=1, seed=3).cache()
    train, test = data.where("id % 4 > 0"), data.where("id % 4 = 0")
    plain = X.fit(train, X.Setting(n_factors=0, has_gamma=False, sweeps=2), test, iterations=1)
    full = X.fit(train, X.Setting(n_factors=1, has_gamma=False, sweeps=3), test, iterations=3)
    assert full.history[-1]["test_loss"] < 0.8 * plain.history[-1]["test_loss"]
    assert full.history[-1]["train_loss"] <= full.history[0]["train_loss"] + 1e-6
    assert np.isfinite(X.complete_loglik(train, full))


def test_regression_priors_serve_new_entities(spark):
    """Source effects are 2 x1 - x2 plus noise; sources that only the test has get them from their features."""
    c = F.col
    sources = spark.range(1, 61).select(c("id").cast("int").alias("src_id"), F.array(F.lit(1.0), sim.normal(0, "x1", c("id")), sim.normal(0, "x2", c("id"))).alias("x"))
    rows = spark.range(2400).select(c("id"), sim.pick(1, "s", 60, c("id")).alias("src_id"), sim.pick(1, "d", 20, c("id")).alias("dst_id")).join(sources, "src_id")
    y = 2 * c("x")[1] - c("x")[2] + 0.2 * sim.normal(2, "a", c("src_id")) + 0.3 * sim.normal(2, "e", c("id"))
    rows = rows.withColumn("y", y).drop("x").cache()
    train, test = rows.where("src_id <= 45"), rows.where("src_id > 45").drop("id")
    for fit in (lambda s: M.fit(train, s, iterations=2, features={"src": sources}), lambda s: X.fit(train.drop("id"), X.Setting(n_factors=0), iterations=2, features={"alpha": sources})):
        model = fit(X.Setting(n_factors=0, samples=5, burn_in=2))
        assert np.allclose(np.ravel(model.coefficients["alpha"])[1:], [2, -1], atol=0.25)
        assert X.loss(test, X.with_priors(model, {"alpha": sources}))["rmse"] < 0.6 < X.loss(test, model)["rmse"]


def test_sampling_does_not_depend_on_partitioning(spark):
    data = sim.dyadic(spark, 600, nodes=12, contexts=(2, 2, 2), factors=1).select("src_id", "dst_id", "y")
    setting = X.Setting(n_factors=2, samples=2, burn_in=1, seed=5)
    one = X.predict(data, X.fit(data.repartition(1), setting, iterations=1)).agg(F.sum("pred")).first()[0]
    two = X.predict(data, X.fit(data.repartition(7), setting, iterations=1)).agg(F.sum("pred")).first()[0]
    assert one == pytest.approx(two, rel=1e-6)


def test_self_interaction_and_logistic(spark):
    data = sim.dyadic(spark, 1500, nodes=15, factors=1).select("src_id", "dst_id", "y").where("src_id <> dst_id")
    own = X.fit(data, X.Setting(n_factors=1, has_u=False, sweeps=3), iterations=1)
    assert np.isfinite(own.history[-1]["train_loss"])
    labels = data.withColumn("y", (F.col("y") > 0).cast("double"))
    fit = X.fit(labels, X.Setting(n_factors=0, is_logistic=True, sweeps=2), iterations=2)
    assert fit.history[-1]["train_loss"] < math.log(2)
    assert X.predict(labels.drop("y"), fit).where("pred < 0 or pred > 1").isEmpty()


def test_colours_of_neighbours_differ(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (150, 2))] + [(0, k) for k in range(1, 60)] + [(70, 70)]
    got = {r["node"]: r["colour"] for r in G.colours(spark.createDataFrame(pairs, "from int, to int")).collect()}
    assert set(got) == {x for p in pairs for x in p} and all(got[a] != got[b] for a, b in pairs if a != b)
    assert max(got.values()) < 15 and min(got.values()) == 0


def test_self_interaction_has_the_posterior_variance(spark):
    """A star and isolated pairs: draws' moments against the dense posterior where the data say little, and one step given the others against plain algebra."""
    rows = [(k, 200 + k, 0.0, 1e9) for k in range(200)]
    obs = spark.createDataFrame(rows, "src_id int, dst_id int, o double, s2 double").withColumn("y", F.col("o"))
    setting = X.Setting(n_factors=1, has_u=False, samples=1, seed=3)
    ids = spark.range(400).select(F.col("id").cast("int").alias("dst_id"), F.array(F.lit(0.0)).alias("mean"), F.array(F.lit(0.0)).alias("var"))
    model = X.Model(setting, X.Params(), {"v": ids})
    classes = G.colours(obs, "src_id", "dst_id")
    values = []
    for sweep in range(4):
        X.sweep_once(obs, model, sweep, classes=classes)
        values += [r[0][0] for r in model.factors["v"].select("mean").collect()]
    assert len(values) == 1600 and abs(np.var(values) - 1) < 0.12
    # A triangle with data, no draws: at the fixpoint each node is the least-squares answer given the others.
    tri = spark.createDataFrame([(0, 1, 2.0, 0.1), (1, 2, 1.0, 0.1), (2, 0, 3.0, 0.1)], "src_id int, dst_id int, o double, s2 double").withColumn("y", F.col("o"))
    start = spark.createDataFrame([(k, [1.0], [0.0]) for k in range(3)], "dst_id int, mean array<double>, var array<double>")
    model = X.Model(X.Setting(n_factors=1, has_u=False), X.Params(var_v=1.0), {"v": start})
    classes = {r["node"]: r["colour"] for r in G.colours(tri, "src_id", "dst_id").collect()}
    X.sweep_once(tri, model, 0, classes=spark.createDataFrame(list(classes.items()), "node int, colour int"))
    v, var, y = {k: 1.0 for k in range(3)}, {k: 0.0 for k in range(3)}, {(0, 1): 2.0, (1, 2): 1.0, (2, 0): 3.0}
    for node in sorted(classes, key=classes.get):
        near = [(b if a == node else a, o) for (a, b), o in y.items() if node in (a, b)]
        precision = 1 + sum((v[m] ** 2 + var[m]) / 0.1 for m, _ in near)
        v[node], var[node] = sum(v[m] * o / 0.1 for m, o in near) / precision, 1 / precision
    got = {r["dst_id"]: r for r in model.factors["v"].collect()}
    assert all(abs(got[k]["mean"][0] - v[k]) < 1e-9 and abs(got[k]["var"][0] - var[k]) < 1e-9 for k in v)


def _dense(n, c, k, seed):
    """Random sums of one entity's rows in c contexts with vectors of k: the design of its effects, and its global effect as one more unknown."""
    rng = np.random.default_rng(seed)
    oc, x, r, wt = rng.integers(0, c, n), rng.normal(size=(n, k)), rng.normal(size=n), rng.uniform(0.5, 2, n)
    return M.Rows(np.zeros(n, int), oc, np.zeros(n, int), r, x, wt, None, None, r)


@pytest.mark.parametrize("c,k,n", [(3, 2, 12), (4, 0, 5), (1, 3, 9), (5, 2, 1)])
def test_joint_draw_against_the_dense_posterior(c, k, n):
    rows = _dense(n, c, k, c + k)
    side = M.Side(np.linspace(0.5, 1.5, c), np.linspace(0.2, 0.6, c), np.zeros((0, c + k)), 0.7, c > 1)
    shape, m = M.Shape(c, k, 0), np.linspace(-1, 1, c + k)
    # Unknowns: effects, vector, global effect.
    w = c + k + 1
    a, right = np.zeros((w, w)), np.zeros(w)
    for i in range(n):
        z = np.zeros(w)
        z[rows.oc[i]], z[c : c + k] = 1, rows.x[i]
        a += rows.weight[i] * np.outer(z, z)
        right += rows.weight[i] * rows.r[i] * z
    for j in range(c):
        z = np.zeros(w)
        z[j], z[-1] = 1, -side.q[j] * side.two_level
        a += np.outer(z, z) / side.var[j]
        right += z * m[j] / side.var[j]
    a[-1, -1] += 1
    a[range(c, c + k), range(c, c + k)] += 1 / 0.7
    right[c : c + k] += m[c:] / 0.7
    mean, cov = np.linalg.solve(a, right), np.linalg.inv(a)
    sums = M.sums_of(rows, 1, shape)
    got, glob = M.draw_side(sums, m[None], side, shape, None)
    assert np.allclose(got[0], mean[:-1]) and (not side.two_level or np.allclose(glob[0], mean[-1]))
    z = np.random.default_rng(0).normal(size=(40_000, w))
    drawn, glob = M.draw_side(np.repeat(sums, 40_000, 0), np.repeat(m[None], 40_000, 0), side, shape, z)
    both = np.concatenate([drawn, glob[:, None]], axis=1)[:, : w if side.two_level else -1]
    size = both.shape[1]
    assert np.allclose(np.cov(both.T), cov[:size, :size], atol=0.05 * np.abs(cov).max()) and np.allclose(both.mean(0), mean[:size], atol=0.03 * (1 + np.sqrt(np.diag(cov)).max()))


def test_two_level_effects_help_rare_contexts(spark):
    """Truth recovered where most pairs of entity and context have no row or one, and better than by independent contexts."""
    data = sim.multicontext(spark, 3000, nodes=60, contexts=(12, 12, 1), factors=0, var_local=0.05, seed=4).drop("ctx_id").cache()
    train, test = data.where("id % 4 > 0"), data.where("id % 4 = 0")
    setting = X.Setting(n_factors=0, samples=3, burn_in=2)
    deep = M.fit(train, setting, test, iterations=3)
    flat = M.fit(train, setting, test, iterations=3, two_level=False)
    assert deep.history[-1]["test_loss"] < 0.6 * flat.history[-1]["test_loss"] and deep.history[-1]["test_loss"] < 0.75
    q = [x[1] for x in deep.loadings["alpha"]]
    assert np.corrcoef(q, range(12))[0, 1] > 0.8 and all(0 < x[2] < 0.6 for x in deep.loadings["alpha"])
    assert deep.globals["alpha"].count() == deep.factors["alpha"].select("src_id").distinct().count() and deep.factors["alpha"].count() == 12 * deep.globals["alpha"].count()


def test_sweeps_move_no_observations_and_split_hot_entities(spark):
    data = sim.multicontext(spark, 2000, nodes=25, contexts=(2, 3, 2), factors=1, seed=2)
    hot = data.withColumn("src_id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("src_id"))).cache()
    setting = X.Setting(n_factors=1, samples=1, seed=5)
    whole, split = M.fit(hot, setting, iterations=1), M.fit(hot, setting, iterations=1, block_rows=100)
    assert whole.history[0]["train_loss"] == pytest.approx(split.history[0]["train_loss"], rel=1e-6)
    layout = M.lay_out(hot, block_rows=100)
    assert layout.split("src") and layout.rows == 2000
    shape = M.Shape(3, 1, 0)
    state = M._start(layout, "dst", M.Shape(3, 1, 0), None, 0)
    plan = M._met(layout, "src", M._sent(layout, "dst", state, shape, 0))._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("_blocks")
    before = plan[:scan]
    # What stands above the scan of the blocks is a merge join; the one exchange belongs to what was sent.
    assert plan.count("Exchange") == 1 and "Exchange" not in before and "BroadcastHashJoin" not in plan
    layout.drop()
    layout = M.lay_out(hot)
    states = {s: M._start(layout, s, shape, None, 0) for s in M.SIDES}
    plan = M._joined_at_once(layout, "src", states)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "BroadcastHashJoin" not in plan and plan.count("Bucketed: true") == 2
    layout.drop()


def test_parts_grow_with_rows_and_keep_nearby_ids_together(spark, monkeypatch):
    """A task's blocks are bounded by rows whatever the number of partitions, and ids that meet only their neighbours are sent to few blocks."""
    data = sim.multicontext(spark, 4000, nodes=400, contexts=(2, 3, 2), factors=1, seed=2).withColumn("dst_id", F.col("src_id") + F.col("id") % 3).cache()
    setting = X.Setting(n_factors=1, samples=1, seed=5)
    whole = M.fit(data, setting, iterations=1)
    monkeypatch.setattr(M, "PART_ROWS", 200)
    parted = M.fit(data, setting, iterations=1)
    assert whole.history[0]["train_loss"] == pytest.approx(parted.history[0]["train_loss"], rel=1e-9)
    layout = M.lay_out(data, keyed=False)
    blocks = layout.blocks["src"].select("n", F.size("others").alias("k")).collect()
    assert layout.buckets >= 20 and max(b.n for b in blocks) < 600 and max(b.k for b in blocks) <= 3
    assert sum(b.n for b in blocks) == 4000
    layout.drop()


def test_multicontext_logistic_and_regressors(spark, tmp_path):
    data = sim.multicontext(spark, 4000, nodes=30, contexts=(2, 2, 2), factors=0, seed=6).withColumn("y", (F.col("y") > 0).cast("double")).cache()
    model = M.fit(data.where("id % 4 > 0"), X.Setting(n_factors=0, samples=3, burn_in=2, is_logistic=True), data.where("id % 4 = 0"), iterations=1)
    assert model.history[-1]["test_loss"] < 0.6 and model.history[-1]["train_loss"] < 0.55
    X.save(model, f"{tmp_path}/m")
    back = X.load(spark, f"{tmp_path}/m")
    assert back.loadings == model.loadings and back.globals["beta"].count() == model.globals["beta"].count()
    # A source's effect is a step function of its feature: a forest finds it, a line doesn't.
    c = F.col
    sources = spark.range(1, 301).select(c("id").cast("int").alias("src_id"), F.array((c("id") / 150 - 1).cast("double")).alias("x"))
    rows = spark.range(1500).select("id", sim.pick(1, "s", 300, c("id")).alias("src_id"), sim.pick(1, "d", 10, c("id")).alias("dst_id")).join(sources, "src_id")
    step = F.when(F.floor((c("x")[0] + 1) * 3) % 2 == 0, 2.0).otherwise(-2.0)
    rows = rows.withColumn("true", step).withColumn("y", step + 2.0 * sim.normal(2, "e", c("id"))).cache()
    setting = X.Setting(n_factors=0, samples=3)
    error = []
    for learners in ({}, {"alpha": Forest(30)}):
        found = M.fit(rows.drop("x", "true"), setting, iterations=3, features={"src": sources}, regressors=learners)
        effects = rows.select("src_id", "true").distinct().join(found.factors["alpha"], "src_id")
        error.append(effects.agg(F.avg((c("true") - c("mean")) ** 2)).first()[0])
    assert error[1] < 0.75 * error[0]


def test_models_are_saved_and_loaded(spark, tmp_path):
    data = sim.dyadic(spark, 400, nodes=10, factors=1)
    model = X.fit(data, X.Setting(n_factors=1, sweeps=1), iterations=1)
    keep = X.Checkpoints(str(tmp_path), keep_all=True)
    keep.add(model, 1, 1.0)
    keep.add(model, 2, 2.0)
    back = X.load(spark, f"{tmp_path}/model.min_test_loss")
    a, b = (X.predict(data, m).agg(F.sum("pred")).first()[0] for m in (model, back))
    assert a == pytest.approx(b)
    with pytest.raises(Exception):
        X.load(spark, f"{tmp_path}/nowhere")


def test_multiapp_weights_and_logistic_rows(spark):
    """Weights count as repeated rows do where they may; the bound never falls; probabilities are found again."""
    rows = sim.multi_app(spark, 60, {"p": 5, "q": 3}, noise=0.2).cache()
    marked = rows.withColumn("w", F.lit(1.0)).withColumn("lg", F.col("app") == "q").withColumn("y", F.when(F.col("app") == "q", (F.col("y") > 0).cast("double")).otherwise(F.col("y")))
    model = A.fit(marked, 2, 2, iterations=5, weight="w", logistic="lg")
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(model.history, model.history[1:])) and model.history[-1] > model.history[0] + 10
    pred = A.predict(marked, A.factors(A.prepared(marked, "w", "lg"), model), model).where("lg")
    assert pred.agg(F.avg(((F.col("pred") > 0) == (F.col("y") > 0.5)).cast("double"))).first()[0] > 0.8
    # A logistic row of weight 2 is two rows of weight 1; Gaussian weights scale the noise, so equal ones leave the factors as they are.
    step = A.initial(A.prepared(marked, "w", "lg"), 2, 2)
    double = marked.withColumn("w", F.when(F.col("lg"), 2.0).otherwise(1.0))
    twice = marked.unionByName(marked.where("lg"))
    one, two = (A.factors(A.prepared(df, "w", "lg"), step).orderBy("user", "app").collect() for df in (double, twice))
    assert np.allclose([r.z for r in one], [r.z for r in two])
    gauss = rows.withColumn("w", F.lit(3.0))
    a, b = A.fit(gauss, 2, 2, iterations=3, weight="w"), A.fit(rows, 2, 2, iterations=3)
    x, y = (A.predict(rows, A.factors(A.prepared(df, w), m), m).agg(F.avg((F.col("y") - F.col("pred")) ** 2)).first()[0] for df, m, w in ((gauss, a, "w"), (rows, b, None)))
    assert x == pytest.approx(y, rel=0.3)


def test_multiapp_em_never_loses_likelihood(spark, tmp_path):
    rows = sim.multi_app(spark, 60, {"p": 4, "q": 3}).cache()
    model = A.fit(rows, 2, 2, iterations=4)
    assert all(b >= a - 1e-6 for a, b in zip(model.history, model.history[1:]))
    pred = A.predict(rows, A.factors(rows, model), model)
    err = pred.agg(F.avg((F.col("y") - F.col("pred")) ** 2), F.var_pop("y")).first()
    assert err[0] < 0.7 * err[1]
    A.save(spark, model, f"{tmp_path}/apps")
    back = A.load(spark, f"{tmp_path}/apps")
    assert A.check(rows, back).isEmpty() and back.history == model.history
    found = A.factors(rows, back)
    total, u2 = A.observed_loglik(rows, found, back), {}
    for r in found.collect():
        app = back.apps[r["app"]]
        e = np.array(r["z"]) - app.a @ np.array(r["u"])
        total -= 0.5 * (e @ e / app.var_z + len(e) * np.log(2 * np.pi * app.var_z))
        u2[r["user"]] = np.array(r["u"])
    total -= sum(0.5 * (u @ u / back.var_u + len(u) * np.log(2 * np.pi * back.var_u)) for u in u2.values())
    assert A.complete_loglik(rows, found, back) == pytest.approx(total, rel=1e-9)


def test_multiapp_posterior_equals_dense():
    rng = np.random.default_rng(1)
    apps = {n: A.App(rng.standard_normal((k, 2)), 0.7) for n, k in (("p", 2), ("q", 3))}
    model = A.MultiApp(apps, None, 2, 1.3)
    # Two users: one with data in both applications, one in the first alone.
    users = [{n: (rng.standard_normal(m), rng.random(m) + 0.2, rng.standard_normal((m, len(apps[n].a)))) for n, m in sizes} for sizes in ((("p", 4), ("q", 2)), (("p", 3),))]
    data = {}
    for n, app in apps.items():
        k = len(app.a)
        p, h, has = np.zeros((2, k, k)), np.zeros((2, k)), np.zeros(2)
        for i, own in enumerate(users):
            if n in own:
                d, noise, c = own[n]
                p[i], h[i], has[i] = (c.T / noise) @ c, (c.T / noise) @ d, 1
        data[n] = (p, h, has)
    u, var_u, local, value = A.posterior(model, data)
    # Stack u, z_p, z_q.
    prior = np.zeros((7, 7))
    prior[:2, :2] = 1.3 * np.eye(2)
    spots = {"p": slice(2, 4), "q": slice(4, 7)}
    for n, s in spots.items():
        prior[:2, s] = 1.3 * apps[n].a.T
        prior[s, :2] = prior[:2, s].T
        for m, t in spots.items():
            prior[s, t] = 1.3 * apps[n].a @ apps[m].a.T + (0.7 * np.eye(len(apps[n].a)) if n == m else 0)
    for i, own in enumerate(users):
        d, noise = (np.concatenate([own[n][k] for n in own]) for k in (0, 1))
        design, at = np.zeros((len(d), 7)), 0
        for n, (_, _, c) in own.items():
            design[at : at + len(c), spots[n]] = c
            at += len(c)
        mean, cov = gaussian_posterior(prior, design, d, noise)
        assert np.allclose(u[i], mean[:2]) and np.allclose(var_u[i], cov[:2, :2])
        for n in own:
            z, var_z, c = (x[i] for x in local[n])
            s = spots[n]
            assert np.allclose(z, mean[s]) and np.allclose(var_z, cov[s, s]) and np.allclose(c, cov[s, :2])
        total = design @ prior @ design.T + np.diag(noise)
        loglik = -0.5 * (np.linalg.slogdet(total)[1] + d @ np.linalg.solve(total, d) + len(d) * np.log(2 * np.pi))
        assert np.isclose(value[i] - 0.5 * np.sum(d * d / noise + np.log(2 * np.pi * noise)), loglik)


def test_adaptive_rejection_draws_from_its_density():
    rng = np.random.default_rng(0)
    f = lambda t: (-0.5 * (t - 2) ** 2 / 0.25, -(t - 2) / 0.25)
    x = np.array([L.adaptive_rejection(f, [0.0, 1.0], rng) for _ in range(1500)])
    assert abs(x.mean() - 2) < 0.05 and abs(x.std() - 0.5) < 0.04


def test_bayesian_logistic_regression():
    rng = np.random.default_rng(2)
    x = np.c_[np.ones(300), rng.standard_normal(300)]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [0.5, 1.5])))).astype(float)
    mean, var = L.bayes_logistic(x, y, np.zeros(2), np.full(2, 10.0), 120, 30)
    assert np.abs(mean - [0.5, 1.5]).max() < 0.6 and (var > 0).all()


def test_logistic_effects(spark):
    data = sim.dyadic(spark, 600, nodes=8, factors=0).withColumn("y", (F.col("y") > 0).cast("int")).select("src_id", "dst_id", "y")
    a, b, _ = L.fit_effects(data, samples=2, burn_in=1)
    assert a.count() == 8 and abs(a.agg(F.avg("value")).first()[0]) < 0.5
    assert b.count() == 8


def test_spline_knot_of_the_ordinary_link(spark):
    rows = spark.range(4000).select(F.col("id"), (sim.normal(1, "s", F.col("id")) * 2).alias("s"))
    rows = rows.withColumn("y", (sim.uniform(1, "y", F.col("id")) < 1 / (1 + F.exp(-F.col("s")))).cast("int"))
    assert abs(L.spline_knot(rows, "y", "s", steps=10) - 0.5) < 0.06


def test_topics_are_recovered(spark):
    corpus = sim.topic_corpus(spark, 40, 60, 3, 60).cache()
    state = P.gibbs_lda(corpus, 3, sweeps=8)
    n = P.counters(state)
    assert n["topic"].agg(F.sum("n")).first()[0] == corpus.agg(F.sum("weight")).first()[0]
    # Items of one true topic mostly share their main topic.
    main = n["item_topic"].groupBy("item").agg(F.max_by("topic", "n").alias("t")).withColumn("true", F.col("item") % 3)
    share = main.groupBy("true", "t").count().groupBy("true").agg(F.max("count").alias("m")).agg(F.sum("m")).first()[0] / 40
    assert share > 0.7


def test_topic_draws_follow_their_conditional(spark):
    """Frequencies of many draws of one term's topic against the weights that SQL columns give, with ratings."""
    rng = np.random.default_rng(4)
    state = spark.createDataFrame([(1, "a", 2.0, 1), (2, "a", 1.0, 2), (2, "b", 3.0, 1), (2, "c", 1.0, 3), (3, "c", 2.0, 3)], "item int, term string, weight double, topic int")
    half = rng.standard_normal((3, 3))
    xx, xo = half @ half.T, rng.standard_normal(3) * 2
    up = np.triu_indices(3)
    ratings = spark.createDataFrame([(1, xx[up].tolist(), xo.tolist())], "item int, xx array<double>, xo array<double>")
    logits = {r.topic: r.logit for r in P.conditional(state, 3, 3, 0.3, 0.2, ratings).where("item = 1").collect()}
    p = np.exp(np.array([logits[k] for k in (1, 2, 3)]))
    n = 20_000
    z = np.zeros(n, np.int64)
    # Item 1 has one term, so n copies of it are n draws.
    P.draw_topics(np.arange(n + 1), np.full(n, 2.0), z, np.tile([2.0, 1.0, 0.0], (n, 1)), np.array([5.0, 1.0, 3.0]), 3, 0.3, 0.2, np.arange(n).astype(np.uint64), np.tile(xx, (n, 1, 1)), np.tile(xo, (n, 1)))
    assert np.abs(np.bincount(z, minlength=3) / n - p / p.sum()).max() < 0.015


def test_topic_sweep_like_one_item_at_a_time(spark):
    """Items that advance together get what each gets alone."""
    rng = np.random.default_rng(5)
    length = np.array([4, 0, 7, 1, 3])
    first = np.r_[0, np.cumsum(length)]
    n, k = first[-1], 3
    w, z, kt, nk, key = rng.integers(1, 4, n).astype(float), rng.integers(0, k, n), rng.random((n, k)) * 9, np.array([30.0, 40, 50]), rng.integers(0, 2**63, 5).astype(np.uint64)
    half = rng.standard_normal((5, k, k))
    xx, xo = half @ half.transpose(0, 2, 1), rng.standard_normal((5, k))
    together = z.copy()
    P.draw_topics(first, w, together, kt, nk, 10, 0.1, 0.1, key, xx, xo)
    for j in range(5):
        s = slice(first[j], first[j + 1])
        own = z[s].copy()
        P.draw_topics(np.array([0, length[j]]), w[s], own, kt[s], nk, 10, 0.1, 0.1, key[j : j + 1], xx[j : j + 1], xo[j : j + 1])
        assert (own == together[s]).all()


def test_placed_blocks_have_buckets_of_their_own(spark):
    from dyadic.operators.place import block_names, place

    assert len(set(block_names(spark, 37))) == 37
    rows = place(spark.range(5000).withColumn("v", F.col("id") % 7), "id")
    held = rows.rows.groupBy(F.pmod(F.hash("block"), F.lit(rows.buckets)).alias("bucket")).agg(F.count_distinct("block").alias("n")).collect()
    assert len(held) == rows.buckets and {r["n"] for r in held} == {1}
    assert rows.rows.agg(F.count("*"), F.sum("v")).first() == (5000, sum(k % 7 for k in range(5000)))
    rows.drop()


def test_parts_of_sweeps_have_buckets_of_their_own(spark):
    rows = spark.range(6000).select((F.col("id") % 400).alias("src_id"), (F.col("id") % 130).alias("dst_id"), F.lit(1.0).alias("y"))
    layout = M.lay_out(rows)
    for side in M.SIDES:
        held = layout.blocks[side].groupBy(F.pmod(F.hash("block"), F.lit(layout.buckets)).alias("bucket")).agg(F.count("*").alias("n"), F.sum("n").alias("rows")).collect()
        assert len(held) == layout.buckets and {r["n"] for r in held} == {1} and sum(r["rows"] for r in held) == 6000
    layout.drop()


def test_held_out_rows_of_sweeps_stay_where_they_are(spark, monkeypatch):
    rows = spark.range(600).select((F.col("id") % 20).alias("src_id"), (F.col("id") % 7).alias("dst_id"), (F.col("id") % 5 + F.col("id") % 7).cast("double").alias("y"), "id")
    seen, loss = [], X.loss

    def spy(test, model):
        out = loss(test, model)
        seen.append((isinstance(test, X.Placed), out["loss"], loss(rows.where("id % 4 = 0"), model)["loss"]))
        return out

    monkeypatch.setattr(X, "loss", spy)
    M.fit(rows.where("id % 4 > 0"), X.Setting(n_factors=0, samples=1), rows.where("id % 4 = 0"), iterations=1)
    assert seen and all(placed and abs(a - b) < 1e-9 for placed, a, b in seen)


def test_topic_factors_query_leaves_no_draws_out(monkeypatch):
    """The query fits with the operator's own iterations, draws and burn-in."""
    import inspect
    from unittest.mock import MagicMock

    from dyadic.plans import model_queries

    given, own = {}, inspect.signature(P.fit_topic_factors)

    def fit(*args, **more):
        given.update({k: v for k, v in own.bind(*args, **more).arguments.items() if k in ("iterations", "samples", "burn_in")})

    for name in ("place", "_document_ratings", "corpus"):
        monkeypatch.setattr(model_queries, name, MagicMock())
    monkeypatch.setattr(P, "fit_topic_factors", fit)
    monkeypatch.setattr(P, "predict", MagicMock())
    model_queries.topic_factors(MagicMock(), "")
    assert all(own.parameters[k].default <= v for k, v in given.items())


def test_topic_factors(spark):
    """Ratings that follow topics: the fit predicts held-out ratings, and those of items that have text alone."""
    corpus = sim.topic_corpus(spark, 30, 40, 2, 40).cache()
    rows = spark.range(1500).select("id", sim.pick(0, "u", 20, F.col("id")).alias("user"), sim.pick(0, "i", 30, F.col("id")).alias("item"))
    like = F.when((F.col("item") % 2) == (F.col("user") % 2), 2.0).otherwise(-2.0)
    rows = rows.withColumn("y", like + 0.3 * sim.normal(0, "y", F.col("id")))
    train, test = rows.where("item < 26 and id % 5 <> 0").select("user", "item", "y").cache(), rows.where("item < 26 and id % 5 = 0")
    out = P.fit_topic_factors(train, corpus.where("item < 26"), 2, iterations=2, samples=2, burn_in=2, grid=[0.05, 0.1, 0.5])
    error = lambda df: df.agg(F.avg((F.col("y") - F.col("pred")) ** 2)).first()[0]
    assert error(P.predict(test, out)) < 1.0 and len(out.history) == 2 and out.history[1]["loglik"] > out.history[0]["loglik"]
    assert P.predict(train.select("user", "item").distinct(), out).where("pred is null").isEmpty()
    assert out.tastes.count() == 20 and P.uncovered_items(train, corpus).isEmpty()
    new = rows.where("item >= 26").select("user", "item", "y")
    found = P.predict_samples(new, train, corpus, out, samples=3, burn_in=2)
    assert found.columns == ["user", "item", "y", "pred"] or set(found.columns) == {"user", "item", "y", "pred"}
    assert error(found) < 0.5 * new.agg(F.var_pop("y")).first()[0]
    # With the topics left alone, an item's prediction doesn't depend on other new items.
    key = lambda df: sorted((r.user, r.item, round(r.pred, 9)) for r in df.where("item = 27").collect())
    together, apart = P.predict_frozen(new, corpus, out, 4, 2), P.predict_frozen(new.where("item = 27"), corpus.where("item <= 25 or item = 27"), out, 4, 2)
    assert key(together) == key(apart) and len(key(apart)) > 0
    assert error(together) < 0.6 * new.agg(F.var_pop("y")).first()[0]
    shares = P.cold_start_shares(corpus, P.phi(P.counters(out.last.topics)["topic_term"], 40, 0.1), spark.createDataFrame([(1, 0.5), (2, 0.5)], "topic int, p double"))
    assert abs(shares.groupBy("item").agg(F.sum("share").alias("s")).agg(F.max(F.abs(F.col("s") - 1))).first()[0]) < 1e-9


def test_regressors(spark):
    rows = spark.range(600).select(F.array(F.lit(1.0), sim.normal(0, "a", F.col("id")), sim.normal(0, "b", F.col("id"))).alias("x"), F.lit(1.0).alias("w"), "id")
    rows = rows.withColumn("y", 2 + 3 * F.col("x")[1] + 0.1 * sim.normal(0, "e", F.col("id")))
    assert np.allclose(Ridge().train(rows, "x", "y"), [2, 3, 0], atol=0.05)
    for r in (Ridge(), ElasticNet(penalties=(0.001, 0.1), folds=2), Forest(10)):
        pred = r.predict(r.train(rows, "x", "y", "w"), rows, "x", "p")
        assert pred.agg(F.avg((F.col("y") - F.col("p")) ** 2)).first()[0] < 6  # of a variance of 9
    best, _ = best_ridge(rows, "x", "y", [0.0, 1e4])
    assert best == 0.0
    best, tried = best_ridge(rows, "x", "y", [1e-3, 10.0, 1e4], splits=2, rounds=2)
    assert len(tried) > 4 and best <= 10.0 and min(e for _, e in tried) == dict(tried)[best]


def test_online_regression_batch_and_stream(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 2).alias("item"), F.col("id").alias("seq"), F.array(F.lit(1.0), (F.col("id") % 5).cast("double")).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    batch = online.predict_batches(rows, "item", ["seq"], "x", "y", 4, 100, [0.0, 0.0], 2.0, 0.9).orderBy("item", "seq").collect()
    lam, eta, beta = np.eye(2) / 2, np.zeros(2), np.zeros(2)
    own = [r for r in rows.orderBy("seq").collect() if r["item"] == 0]
    expected = []
    for k, r in enumerate(own):
        if k and k % 4 == 0:
            beta = np.linalg.solve(lam, eta)
            if (np.diag(lam) * 0.9 >= 0.5).all():
                lam, eta = lam * 0.9, eta * 0.9
        x = np.array(r["x"])
        expected.append(x @ beta)
        lam, eta = lam + np.outer(x, x), eta + x * r["y"]
    assert np.allclose([r.pred for r in batch if r["item"] == 0], expected)
    rows.where("seq < 25").coalesce(1).write.parquet(f"{tmp_path}/in")
    rows.where("seq >= 25").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = online.predict_stream(stream, "item", "seq", "x", "y", 4, [0.0, 0.0], 2.0, 0.9).writeStream.format("memory").queryName("online_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("online_out").orderBy("item", "seq").collect()
    assert np.allclose([r.pred for r in got], [r.pred for r in batch])


def test_weights_of_logistic_rows_follow_their_distribution(spark):
    for c in (0.0, 1.5, -6.0):
        w = spark.range(40_000).select(X.polya_gamma(F.lit(c), F.lit(1), F.col("id")).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
        mean = 0.25 if c == 0 else math.tanh(c / 2) / (2 * c)
        var = 1 / 24 if c == 0 else (math.sinh(abs(c)) - abs(c)) / (4 * abs(c) ** 3 * math.cosh(c / 2) ** 2)
        assert w[0] == pytest.approx(mean, rel=0.02) and w[1] == pytest.approx(var, rel=0.08)


def _labels(spark, rows=3000, nodes=15):
    data = spark.range(rows).select("id", sim.pick(3, "s", nodes, F.col("id")).alias("src_id"), sim.pick(3, "d", nodes, F.col("id")).alias("dst_id"))
    own = lambda name, by: sim.normal(3, name, F.col(by))
    score = 0.8 * own("a", "src_id") + 0.8 * own("b", "dst_id") + 1.5 * own("u", "src_id") * own("v", "dst_id")
    return data.withColumn("truth", 1 / (1 + F.exp(-score))).withColumn("y", (sim.uniform(3, "y", F.col("id")) < F.col("truth")).cast("double")).cache()


def test_logistic_factors_by_sampling(spark):
    data = _labels(spark)
    train, test = data.where("id % 5 > 0").select("src_id", "dst_id", "y"), data.where("id % 5 = 0").select("src_id", "dst_id", "y")
    model = X.fit(train, X.Setting(n_factors=2, is_logistic=True, samples=5, burn_in=5), test, iterations=1)
    effects = X.fit(train, X.Setting(n_factors=0, is_logistic=True, samples=3, burn_in=2), test, iterations=1)
    assert model.history[-1]["test_loss"] < effects.history[-1]["test_loss"] < math.log(2)


@pytest.mark.parametrize("knot", [None, 0.5])
def test_logistic_factors_by_adaptive_rejection(spark, knot):
    data = _labels(spark, 500, 6)
    found, b = L.fit_factors(data.select("src_id", "dst_id", "y"), 1, samples=2, burn_in=1, knot=knot)
    rows = data
    for name, by in (("alpha", "src_id"), ("u", "src_id"), ("beta", "dst_id"), ("v", "dst_id")):
        rows = rows.join(found[name].withColumnRenamed("value", name), by)
    p = 1 / (1 + F.exp(-(b + F.col("alpha") + F.col("beta") + F.col("u")[0] * F.col("v")[0])))
    assert rows.agg(F.corr(p, "truth")).first()[0] > 0.5


def test_counted_rows_weigh_as_repeated_ones():
    rng = np.random.default_rng(3)
    x, y, n = rng.standard_normal((6, 2)), np.array([0, 1, 1, 0, 1, 0.0]), np.array([3, 1, 2, 5, 4, 1])
    a = L.bayes_logistic(x, y, np.zeros(2), np.full(2, 4.0), 40, 5, n=n.astype(float))
    b = L.bayes_logistic(np.repeat(x, n, 0), np.repeat(y, n), np.zeros(2), np.full(2, 4.0), 40, 5)
    assert np.allclose(a[0], b[0], atol=0.02)
    k, t = rng.integers(0, 9, 30), rng.integers(9, 30, 30)
    w = rng.integers(1, 5, 30)
    assert np.allclose(B.posterior_mode(k, t, weight=w)[:3], B.posterior_mode(np.repeat(k, w), np.repeat(t, w))[:3])


def test_weighted_factorisation_reaches_a_stationary_point(spark):
    data = sim.dyadic(spark, 500, nodes=10, factors=1).select("src_id", "dst_id", "y").withColumn("w", 1.0 + F.col("src_id") % 3)
    u, v = X.least_squares_factors(data, 2, 0.3, iterations=6, weight="w")
    pu = {r.src_id: np.array(r["mean"]) for r in u.collect()}
    pv = {r.dst_id: np.array(r["mean"]) for r in v.collect()}
    rows = data.collect()
    grad = {j: np.zeros(2) for j in pv}
    for r in rows:
        e = r.y - pu[r.src_id] @ pv[r.dst_id]
        grad[r.dst_id] += -r.w * e * pu[r.src_id] + 0.3 * pv[r.dst_id]
    assert max(np.abs(g).max() for g in grad.values()) < 1e-6
    loss = lambda a, b: sum(r.w * (r.y - a[r.src_id] @ b[r.dst_id]) ** 2 + 0.3 * (a[r.src_id] @ a[r.src_id] + b[r.dst_id] @ b[r.dst_id]) for r in rows)
    zero = {k: np.zeros(2) for k in (*pu, *pv)}
    assert loss(pu, pv) < loss(zero, zero)


def test_prior_setters(spark, tmp_path):
    pop = spark.createDataFrame([("x", "root"), ("y", "root"), ("c", "x"), ("c", "y")], "node_id string, parent_id string")
    obs = spark.createDataFrame([("x", 30, 100)] * 30 + [("y", 60, 100)] * 30 + [("c", 3, 10)] * 2, "p_node string, n_pos long, n_trials long")
    up = G.closure(pop)
    likely, average = ({r.p_node: r for r in B.dag_posterior_modes(obs, pop, up, 0.4, 20.0, 0.01, 0.01, set_priors=s).collect()} for s in (B.likeliest_parent, B.average_parent))
    # The likelier parent is x; the average lies between x and y.
    assert likely["c"]["mean"] < average["c"]["mean"] and abs(likely["c"]["mean"] - likely["x"]["mean"]) < 0.02
    params = spark.createDataFrame([tuple(r) for r in likely.values()], "p_node string, mean double, size double, loglik double, ok boolean")
    B.save_fit(params, [{"var_logit": 1, "var_log": 2, "loglik": -3}], str(tmp_path))
    B.save_fit(params, [{"var_logit": 2, "var_log": 2, "loglik": -2}], str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/model").count() == 4 and spark.read.parquet(f"{tmp_path}/summary").count() == 2
    size = spark.range(1).select(B.size_of_moments(F.lit(0.25), F.lit(0.25 * 0.75 / 21)).alias("s")).first().s
    assert size == pytest.approx(20)


def test_kendall_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(rng.integers(0, 6)), float(rng.integers(0, 5))) for g in range(4) for _ in range([1, 2, 17, 60][g])] + [(2, None, 1.0)]
    got = {r.g: r.tau for r in kendall_of(spark.createDataFrame(rows, "g int, x double, y double")).collect()}
    for g in range(1, 4):
        own = [(x, y) for k, x, y in rows if k == g and x is not None]
        pairs = [np.sign(a[0] - b[0]) * np.sign(a[1] - b[1]) for i, a in enumerate(own) for b in own[:i]]
        assert got[g] == pytest.approx(sum(pairs) / len(pairs))
    assert 0 not in got


def kendall_of(df):
    from dyadic.operators import metrics

    return metrics.kendall(df, "x", "y", "g")


def test_variational_topics(spark):
    model, rows = P.variational_lda(sim.topic_corpus(spark, 12, 20, 2, 30), 2, iterations=2)
    assert model.topicsMatrix().numCols == 2 and rows.count() == 12


def test_two_level_vectors_equal_dense(spark):
    """One entity with data in two of three contexts against the posterior of the stacked vectors."""
    rng = np.random.default_rng(9)
    loading, local = {"a": 1.0, "b": -0.5, "c": 2.0}, {"a": 0.3, "b": 0.6, "c": 0.2}
    data = [(7, c, rng.standard_normal(2).tolist(), float(rng.standard_normal()), 0.5) for c in "aabbb"]
    rows = A.two_level_vectors(spark.createDataFrame(data, "e int, c string, x array<double>, r double, s2 double"), "e", "c", "x", loading, local, 1.5, 2).collect()
    spots = {"a": slice(2, 4), "b": slice(4, 6)}
    prior = np.zeros((6, 6))
    prior[:2, :2] = 1.5 * np.eye(2)
    for n, s in spots.items():
        prior[s, :2] = prior[:2, s] = 1.5 * loading[n] * np.eye(2)
        for m, t in spots.items():
            prior[s, t] = (1.5 * loading[n] * loading[m] + (local[n] if n == m else 0)) * np.eye(2)
    design = np.zeros((5, 6))
    for i, (_, c, x, _, _) in enumerate(data):
        design[i, spots[c]] = x
    mean, cov = gaussian_posterior(prior, design, np.array([r[3] for r in data]), np.full(5, 0.5))
    assert {r.app for r in rows} == {"a", "b"}
    for r in rows:
        z = mean[spots[r.app]]
        zz = np.outer(np.r_[1, z], np.r_[1, z])
        zz[1:, 1:] += cov[spots[r.app], spots[r.app]]
        assert np.allclose(r.u, mean[:2]) and np.allclose(r.z, z) and np.allclose(r.zz, zz[np.triu_indices(3)])


def test_topic_tastes_follow_user_features(spark):
    """Tastes are a function of users' features: the regressions find it, and users that only have features are predicted."""
    corpus = sim.topic_corpus(spark, 20, 40, 2, 40).cache()
    users = spark.range(1, 41).select(F.col("id").cast("int").alias("user"), F.array(F.lit(1.0), F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)).alias("x")).cache()
    rows = spark.range(2400).select("id", sim.pick(0, "u", 40, F.col("id")).alias("user"), sim.pick(0, "i", 20, F.col("id")).alias("item"))
    y = F.when((F.col("item") % 2) == (F.col("user") % 2), 2.0).otherwise(-2.0) + 0.3 * sim.normal(0, "y", F.col("id"))
    rows = rows.withColumn("y", y).cache()
    train, new = rows.where("user <= 30").select("user", "item", "y"), rows.where("user > 30").select("user", "item", "y")
    features = {"user": users}
    model = P.fit_topic_factors(train, corpus, 2, iterations=2, samples=2, burn_in=2, features=features)
    error = lambda df: df.agg(F.avg((F.col("y") - F.col("pred")) ** 2)).first()[0]
    assert len(model.params.user_coefficients) == 2 and len(model.params.user_coefficients[0]) == 3
    assert error(P.predict(new, model, features=features)) < 0.5 * error(P.predict(new, model))


def test_adaptive_rejection_of_narrow_densities():
    # Rows that stand for millions: between the first tangents the hull rises far above every value of log f.
    for scale in (1e6, 1e9):
        y, n = np.array([1.0, 0.0]), np.array([0.6, 0.4]) * scale
        f, rng = L.logistic_terms(y, np.zeros(2), np.ones(2), 0.0, 10.0, n), np.random.default_rng(1)
        x = np.array([L.adaptive_rejection(f, [-1.0, 0.0, 1.0], rng) for _ in range(300)])
        sd = 1 / np.sqrt(0.24 * scale)
        assert abs(x.mean() - np.log(1.5)) < 5 * sd / np.sqrt(300) and 0.85 < x.std() / sd < 1.15
    x = np.array([[1.0, 0.0], [1.0, 0.0], [1.0, 1.0], [1.0, 1.0]])
    mean, var = L.bayes_logistic(x, np.array([0.0, 1.0, 0.0, 1.0]), np.zeros(2), np.full(2, 10.0), 20, 5, n=np.array([2, 3, 3, 2]) * 1e6)
    assert np.allclose(mean, [np.log(1.5), -2 * np.log(1.5)], atol=0.02) and (var > 0).all()


def test_newton_goes_on_where_values_differ_by_rounding():
    # A short step that rounding makes look best isn't the end: the gradient has to vanish.
    top = np.array([0.7, -1.2])

    def terms(t):
        e = t - top
        noise = 1e-3 * np.sin(1e9 * t.sum())
        return -1e8 - 500 * e @ e + noise, -1000 * e, -np.diag([900.0, 1100.0])

    theta, done = B.newton(np.zeros(2), terms, 100, True)
    assert done and np.abs(theta - top).max() < 1e-8


def _shuffles(df, spark) -> int:
    """Shuffles in the plan of df where nothing is broadcast by its size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("logistic", [False, True])
def test_fits_move_no_observations(spark, logistic):
    data = sim.dyadic(spark, 800, nodes=20, contexts=(2, 2, 2), factors=1, seed=4).withColumn("y", (F.col("y") > 0).cast("double") if logistic else F.col("y"))
    setting = X.Setting(n_factors=1, samples=1, burn_in=1, is_logistic=logistic)
    rows = X.placed(data, setting)
    model = X.fit(rows, setting, iterations=1)
    assert _shuffles(X.predict(rows, model), spark) == 0 < _shuffles(X.predict(data, model), spark)
    assert _shuffles(X._main_step(X.pseudo_response(rows, X.Model(X.Setting(), model.params, model.factors)), model, "beta", 0), spark) == 1
    one, two = ({r["id"]: r["score"] for r in X.predict(t, model).collect()} for t in (data, rows))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)


def test_half_steps_move_no_rows(spark):
    data = sim.dyadic(spark, 400, nodes=12, factors=1).select("src_id", "dst_id", "y").withColumn("weight", 1.0 + F.col("src_id") % 3)
    theirs = G.cut(data.select("dst_id").distinct().withColumn("mean", F.array(0.5 + F.col("dst_id") % 5, 1.0 - F.col("dst_id") % 3)))
    rows = X.place(data, "src_id")
    met = X.meet(rows, rows.rows, "dst_id", theirs, ["dst_id"], "inner")
    assert _shuffles(met, spark) == 0 < _shuffles(data.join(theirs, "dst_id"), spark)
    one, two = ({r[0]: r["mean"] for r in X.half_step(t, "src_id", "dst_id", theirs, 2, 0.3).collect()} for t in (data, rows))
    assert one.keys() == two.keys() and all(np.allclose(one[k], two[k]) for k in one)


def test_topic_sweeps_move_no_terms(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit("t"), F.translate((F.xxhash64("id", F.lit(k)) % 9).cast("string"), "-0123456789", "abcdefghijk")) for k in range(12))).alias("text"))
    start = P.random_topics(P.corpus_of(docs), 2)
    placed = P.place(start, "item")
    new = P.topic_sweep(placed, 9, 2, 0.1, 0.1, 0, 0)
    assert _shuffles(new, spark) == 0 < _shuffles(P.topic_sweep(start, 9, 2, 0.1, 0.1, 0, 0), spark)
    rows = lambda df: sorted(map(tuple, df.select("item", "term", "weight", "topic").collect()))
    assert rows(new) == rows(P.topic_sweep(start, 9, 2, 0.1, 0.1, 0, 0))
