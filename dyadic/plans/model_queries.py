"""Queries of the graph, cube, smoothing and model layers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import betabinom as B
from ..operators import cube as U
from ..operators import factor as X
from ..operators import graph as G
from ..operators import logistic as L
from ..operators import multiapp as A
from ..operators import multicontext as M
from ..operators import smooth as S
from ..operators import topics as P
from ..operators.place import place
from ..streaming import online
from .registry import query, round_all, rounded
from .views import BINOM, CORPUS, EDGES, OBS, POP, TRE, binom, corpus, edges, obs, pop_dag, read, tre_tree

Spark = SparkSession

_UP = """up AS (SELECT node_id AS node, parent_id AS ancestor FROM pop UNION SELECT a.node_id, b.parent_id FROM pop a JOIN pop b ON a.parent_id = b.node_id
 UNION SELECT node_id, node_id FROM pop UNION SELECT parent_id, parent_id FROM pop)"""
_TUP = """tup AS (SELECT node_id AS node, parent_id AS ancestor FROM tre UNION SELECT a.node_id, b.parent_id FROM tre a JOIN tre b ON a.parent_id = b.node_id
 UNION SELECT node_id, node_id FROM tre UNION SELECT parent_id, parent_id FROM tre)"""


# --- factors -------------------------------------------------------------------------------------

_MEANS = f"""{OBS}, g AS (SELECT avg(y) AS m, var_pop(y) AS v FROM obs),
 a AS (SELECT src_id, sum(y - m) / any_value(v) / (count(*) / any_value(v) + 1.0) AS alpha FROM obs, g GROUP BY 1),
 b AS (SELECT dst_id, sum(y - m - alpha) / any_value(v) / (count(*) / any_value(v) + 1.0) AS beta FROM obs JOIN a USING (src_id), g GROUP BY 1)"""


def _effects(spark: Spark, d: str) -> tuple[DataFrame, float, float, DataFrame, DataFrame]:
    rows = obs(spark, d)
    m, v = rows.agg(F.avg("y"), F.var_pop("y")).first()
    alpha = S.main_effect(rows.withColumn("o", F.col("y") - m), "src_id", "o", float(v), 0.0, 1.0)
    rest = rows.join(alpha.select("src_id", F.col("mean").alias("alpha")), "src_id").withColumn("o", F.col("y") - m - F.col("alpha"))
    beta = S.main_effect(rest, "dst_id", "o", float(v), 0.0, 1.0)
    return rows, m, v, alpha, beta


@query(f"WITH {_MEANS} SELECT row_id, round(m + alpha + beta, 6) + 0.0 AS score FROM obs JOIN a USING (src_id) JOIN b USING (dst_id), g")
def factor_score(spark: Spark, d: str) -> DataFrame:
    rows, m, _, alpha, beta = _effects(spark, d)
    scored = rows.join(alpha.select("src_id", F.col("mean").alias("a")), "src_id").join(beta.select("dst_id", F.col("mean").alias("b")), "dst_id")
    return scored.select("row_id", rounded(m + F.col("a") + F.col("b")).alias("score"))


@query(f"WITH {_MEANS} SELECT round(sqrt(avg((y - m - alpha - beta) ** 2)), 6) + 0.0 AS rmse, round(avg(abs(y - m - alpha - beta)), 6) + 0.0 AS mae FROM obs JOIN a USING (src_id) JOIN b USING (dst_id), g")
def factor_loss(spark: Spark, d: str) -> DataFrame:
    rows, m, v, alpha, beta = _effects(spark, d)
    model = X.Model(X.Setting(n_factors=0), X.Params(b=m, var_y=v), {"alpha": alpha, "beta": beta})
    plain = rows.drop("src_context", "dst_context")
    scored = X.predict(plain, model)
    e = F.col("y") - F.col("pred")
    return scored.agg(rounded(F.sqrt(F.avg(e * e))).alias("rmse"), rounded(F.avg(F.abs(e))).alias("mae"))


@query(f"""WITH {_MEANS}, q AS (SELECT avg(alpha) AS prior FROM a WHERE src_id % 3 <> 0)
 SELECT row_id, round(m + coalesce(CASE WHEN src_id % 3 <> 0 THEN alpha END, prior) + beta, 6) + 0.0 AS score FROM obs JOIN a USING (src_id) JOIN b USING (dst_id), g, q""")
def cold_start_score(spark: Spark, d: str) -> DataFrame:
    rows, m, v, alpha, beta = _effects(spark, d)
    known = alpha.where("src_id % 3 <> 0")
    prior = known.agg(F.avg("mean")).first()[0]
    model = X.Model(X.Setting(n_factors=0), X.Params(b=m, var_y=v), {"alpha": known, "beta": beta})
    out = X.predict(rows.drop("src_context", "dst_context"), model, prior={"alpha": F.lit(prior)})
    return out.select("row_id", rounded("score").alias("score"))


@query(f"WITH {OBS} SELECT src_id, round(sum((y - 25) / 4.0) / (count(*) / 4.0 + 1.0), 6) + 0.0 AS mean, round(1 / (count(*) / 4.0 + 1.0), 6) + 0.0 AS var FROM obs GROUP BY 1")
def main_effect_posterior(spark: Spark, d: str) -> DataFrame:
    return round_all(S.main_effect(obs(spark, d).withColumn("o", F.col("y") - 25), "src_id", "o", 4.0, 0.0, 1.0))


@query(f"WITH {OBS} SELECT src_id, round(sum((y - 25) * (1 + dst_id % 3) / 4.0) / (sum((1 + dst_id % 3) ** 2 / 4.0) + 0.5), 6) + 0.0 AS mean, round(1 / (sum((1 + dst_id % 3) ** 2 / 4.0) + 0.5), 6) + 0.0 AS var FROM obs GROUP BY 1")
def interaction_k1(spark: Spark, d: str) -> DataFrame:
    rows = obs(spark, d).select("src_id", (F.col("y") - 25).alias("r"), F.lit(4.0).alias("s2"), F.array((1 + F.col("dst_id") % 3).cast("double")).alias("x"))
    solved = X.solve_batches(X.gram_sums(rows, ["src_id"], "x", 1), ["src_id"], 1, 2.0, None)
    return solved.select("src_id", rounded(F.col("mean")[0]).alias("mean"), rounded(F.col("var")[0]).alias("var"))


@query(f"""WITH {OBS} SELECT row_id, round(s2, 6) + 0.0 AS s2, round(CASE WHEN y > 25 THEN 1 ELSE -1 END * s2 / 2, 6) + 0.0 AS z FROM
 (SELECT row_id, y, 1 / (2 * tanh(x / 2) / (4 * x)) AS s2 FROM (SELECT row_id, y, (1 + dst_id % 7) / 2.0 AS x FROM obs))""")
def logistic_bound(spark: Spark, d: str) -> DataFrame:
    from ..functions.columns import bound_weight

    s2 = 1 / (2 * bound_weight((1 + F.col("dst_id") % 7) / 2))
    return obs(spark, d).select("row_id", rounded(s2).alias("s2"), rounded(F.when(F.col("y") > 25, 1).otherwise(-1) * s2 / 2).alias("z"))


@query(f"""WITH {OBS}, k AS (SELECT src_context, 0.5 + 0.25 * (row_number() OVER (ORDER BY src_context) - 1) AS q, 0.4 + 0.1 * (row_number() OVER (ORDER BY src_context) - 1) AS v FROM (SELECT DISTINCT src_context FROM obs)),
 s AS (SELECT src_id, src_context, count(*) / 4.0 AS f, sum(y - 25) / 4.0 AS c FROM obs GROUP BY 1, 2),
 g AS (SELECT src_id, sum(c * q / (1 + f * v)) / (1 + sum(q * q / v * (1 - 1 / (1 + f * v)))) AS g FROM s JOIN k USING (src_context) GROUP BY 1)
 SELECT src_id, src_context, round((coalesce(c, 0) + q * g / v) / (1 / v + coalesce(f, 0)), 6) + 0.0 AS mean, round(g, 6) + 0.0 AS global_mean FROM g CROSS JOIN k LEFT JOIN s USING (src_id, src_context)""")
def two_level_effects(spark: Spark, d: str) -> DataFrame:
    effects, whole = M.effects_given(obs(spark, d), 25.0, 4.0, lambda k: 0.5 + 0.25 * k, lambda k: 0.4 + 0.1 * k)
    return round_all(effects.join(whole.withColumnRenamed("mean", "global_mean"), "src_id"))


def _history(spark: Spark, model: X.Model) -> DataFrame:
    return spark.createDataFrame([(r["iteration"], float(r["train_loss"]), float(r["test_loss"]) if "test_loss" in r else None) for r in model.history], "iteration int, train_loss double, test_loss double")


@query()
def bst_fit(spark: Spark, d: str) -> DataFrame:
    return _history(spark, M.fit(obs(spark, d), X.Setting(n_factors=2, samples=1), iterations=10))


def _held_out(spark: Spark, d: str, factors: int) -> DataFrame:
    rows = obs(spark, d)
    test = F.pmod(F.xxhash64("row_id"), F.lit(4)) == 0
    return _history(spark, M.fit(rows.where(~test), X.Setting(n_factors=factors, samples=2, burn_in=1), rows.where(test), iterations=2))


@query()
def bst_chain(spark: Spark, d: str) -> DataFrame:
    return _held_out(spark, d, 1)


@query()
def bst_chain_2(spark: Spark, d: str) -> DataFrame:
    return _held_out(spark, d, 2)


@query()
def bst_sampled(spark: Spark, d: str) -> DataFrame:
    setting = X.Setting(n_factors=0, samples=2, burn_in=1)
    rows = X.placed(obs(spark, d), setting)
    return X.predict(rows, X.fit(rows, setting, iterations=1)).select("row_id", "score")


# --- graph and cube ------------------------------------------------------------------------------


@query(f"""WITH {EDGES}, e AS (SELECT voter, author, greatest(0.5 + 1.0 * n_pos - 2.0 * n_neg, 0) AS v FROM votes WHERE greatest(0.5 + 1.0 * n_pos - 2.0 * n_neg, 0) <> 0)
 SELECT voter AS "from", author AS "to", round(v / sum(v) OVER (PARTITION BY voter), 6) + 0.0 AS value FROM e""")
def edge_weights(spark: Spark, d: str) -> DataFrame:
    return round_all(G.edge_weights(edges(spark, d), [0.5, 1.0, 2.0]))


def _walk(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    e = edges(spark, d).select(F.col("voter").alias("from"), F.col("author").alias("to"), F.col("value").cast("double").alias("value"))
    total = e.groupBy("from").agg(F.sum("value").alias("t"))
    e = e.join(total, "from").select("from", "to", (F.col("value") / F.col("t")).alias("value"))
    nodes = read(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.lit(0.04).alias("init"), F.lit(0.04).alias("prior"), F.lit(0.85).alias("w"))
    return e, nodes


_EDGE = f"""{EDGES}, e AS (SELECT voter AS f, author AS t, value / sum(value) OVER (PARTITION BY voter) AS v FROM votes),
 n AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey IN (SELECT f FROM e) THEN 0.85 ELSE 0.0 END AS w FROM nation), r0 AS (SELECT node, 0.04::DOUBLE AS ev FROM n)"""


def _sql_step(k: int) -> str:
    return f"""r{k} AS (SELECT n.node, coalesce((SELECT sum(e.v * m.w * r.ev) FROM e JOIN n m ON m.node = e.f JOIN r{k - 1} r ON r.node = e.f WHERE e.t = n.node), 0)
 + 0.04 * (SELECT sum((1 - m.w) * r.ev) FROM n m JOIN r{k - 1} r ON r.node = m.node) AS ev FROM n)"""


@query(f"WITH {_EDGE}, {_sql_step(1)} SELECT node, round(ev, 8) + 0.0 AS ev FROM r1")
def pagerank_step(spark: Spark, d: str) -> DataFrame:
    e, nodes = _walk(spark, d)
    return G.transition(e, nodes.withColumnRenamed("init", "ev")).select("node", rounded("ev", 8).alias("ev"))


@query(f"WITH {_EDGE}, " + ", ".join(f"s{k} AS MATERIALIZED (SELECT * FROM r{k - 1}), {_sql_step(k)}" for k in range(1, 7)) + " SELECT node, round(ev, 6) + 0.0 AS ev FROM r6")
def pagerank_6(spark: Spark, d: str) -> DataFrame:
    e, nodes = _walk(spark, d)
    ranks, _ = G.power_iteration(e, nodes, max_iter=6, eps=0.0)
    return ranks.select("node", rounded("ev").alias("ev"))


@query(f"WITH {POP}, {_UP} SELECT * FROM up")
def dag_closure(spark: Spark, d: str) -> DataFrame:
    return G.closure(pop_dag(spark, d))


@query(f"WITH {POP} SELECT node_id FROM pop WHERE node_id NOT IN (SELECT parent_id FROM pop)")
def dag_leaves(spark: Spark, d: str) -> DataFrame:
    return G.leaves(pop_dag(spark, d))


@query(f"WITH {POP} SELECT node_id AS node, CASE WHEN parent_id = 'root' THEN 1 ELSE 2 END AS level FROM pop UNION ALL SELECT 'root', 0")
def dag_levels(spark: Spark, d: str) -> DataFrame:
    return G.levels(pop_dag(spark, d))


@query(f"WITH {BINOM}, {POP}, {_UP} SELECT ancestor AS p_node, t_node, CAST(sum(n_pos) AS BIGINT) AS n_pos, CAST(sum(n_trials) AS BIGINT) AS n_trials FROM binom JOIN up ON node = p_node GROUP BY 1, 2")
def dag_rollup(spark: Spark, d: str) -> DataFrame:
    return G.rollup(binom(spark, d), G.closure(pop_dag(spark, d)))


@query(f"""WITH {BINOM}, {POP}, {_UP}, {TRE}, {_TUP} SELECT u.ancestor AS p_node, v.ancestor AS t_node, CAST(sum(n_pos) AS BIGINT) AS n_pos, CAST(sum(n_trials) AS BIGINT) AS n_trials
 FROM binom JOIN up u ON u.node = p_node JOIN tup v ON v.node = t_node GROUP BY 1, 2""")
def hier_cube(spark: Spark, d: str) -> DataFrame:
    dims = {"p_node": U.dimension(pop_dag(spark, d)), "t_node": U.dimension(tre_tree(spark, d))}
    return U.hierarchical_cube(binom(spark, d), dims, {"n_pos": ("sum", "n_pos"), "n_trials": ("sum", "n_trials")})


@query(f"""WITH {POP}, {TRE}, p AS (SELECT node_id AS n FROM pop UNION SELECT 'root'), t AS (SELECT node_id AS n FROM tre UNION SELECT 'all')
 SELECT node_id AS p_node, t.n AS t_node, parent_id AS p_up, t.n AS t_up FROM pop, t UNION ALL SELECT p.n, node_id, p.n, parent_id FROM p, tre""")
def cube_dag(spark: Spark, d: str) -> DataFrame:
    edges = U.cube_dag([pop_dag(spark, d), tre_tree(spark, d)])
    return edges.select(*(F.col(c)[k].alias(n) for c, names in (("cell", ("p_node", "t_node")), ("parent_cell", ("p_up", "t_up"))) for k, n in enumerate(names)))


@query(f"""WITH {BINOM}, {POP}, {_UP}, {TRE}, {_TUP}, c AS (SELECT u.ancestor AS p_node, v.ancestor AS t_node FROM binom JOIN up u ON u.node = p_node JOIN tup v ON v.node = t_node GROUP BY 1, 2 HAVING sum(n_trials) >= 200),
 k AS (SELECT c.p_node, c.t_node, pop.node_id AS cp, c.t_node AS ct FROM c JOIN pop ON pop.parent_id = c.p_node UNION ALL SELECT c.p_node, c.t_node, c.p_node, tre.node_id FROM c JOIN tre ON tre.parent_id = c.t_node),
 o AS (SELECT k.p_node, k.t_node, max(CASE WHEN c.p_node IS NULL THEN 1 ELSE 0 END) AS open FROM k LEFT JOIN c ON c.p_node = cp AND c.t_node = ct GROUP BY 1, 2)
 SELECT c.p_node, c.t_node FROM c LEFT JOIN o USING (p_node, t_node) WHERE open IS NULL OR open = 1""")
def frontier(spark: Spark, d: str) -> DataFrame:
    dims = {"p_node": G.closure(pop_dag(spark, d)), "t_node": G.closure(tre_tree(spark, d))}
    cells = U.hierarchical_cube(binom(spark, d), dims, {"n": ("sum", "n_trials")})
    return U.frontier(cells.withColumn("status", F.when(F.col("n") >= 200, 1).otherwise(0)), pop_dag(spark, d), tre_tree(spark, d))


# --- smoothing -----------------------------------------------------------------------------------

_TWO = """data AS (SELECT l_suppkey AS item, l_returnflag AS category, l_quantity AS obs, 1.0 + l_linenumber AS var FROM lineitem),
 cats AS (SELECT * FROM (VALUES ('A', 1.0, 2.0), ('N', 0.5, 1.0), ('R', 1.5, 3.0)) v(category, q, vb)),
 s AS (SELECT item, category, sum(obs / var) AS c, sum(1 / var) AS f FROM data GROUP BY 1, 2),
 t AS (SELECT item, 1 / (1 / 4.0 + sum(q * q / vb * (1 - 1 / ((1 / vb + f) * vb)))) AS va, sum(c * q / ((1 / vb + f) * vb)) AS sm FROM s JOIN cats USING (category) GROUP BY 1)"""


@query(f"""WITH {_TWO} SELECT item, category, round(va * sm, 6) + 0.0 AS mean_a, round(va, 6) + 0.0 AS var_a, round(i * q / vb * va * sm + i * c, 6) + 0.0 AS mean_b,
 round(i + (i * q / vb) ** 2 * va, 6) + 0.0 AS var_b, round(i * q / vb * va, 6) + 0.0 AS cov FROM
 (SELECT t.item, cats.category, va, sm, q, vb, coalesce(c, 0) AS c, 1 / (1 / vb + coalesce(f, 0)) AS i FROM t CROSS JOIN cats LEFT JOIN s ON s.item = t.item AND s.category = cats.category)""")
def smoother_estep(spark: Spark, d: str) -> DataFrame:
    data = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_returnflag").alias("category"), F.col("l_quantity").alias("obs"), (1.0 + F.col("l_linenumber")).alias("var"))
    model = S.TwoLevel(4.0, {"A": 2.0, "N": 1.0, "R": 3.0}, {"A": 1.0, "N": 0.5, "R": 1.5})
    return round_all(S.two_level_posterior(data, model))


@query()
def smoother_fit(spark: Spark, d: str) -> DataFrame:
    data = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_returnflag").alias("category"), (F.col("l_quantity") - 25.5).alias("obs"), F.lit(200.0).alias("var"))
    fit = S.fit_two_level(data, 3)
    return spark.createDataFrame([(k, float(fit.model.q[k]), float(fit.model.var_b[k])) for k in fit.model.q], "category string, q double, var_b double")


@query("""WITH tr AS (SELECT * FROM lineitem WHERE l_linenumber > 1), i AS (SELECT l_suppkey, avg(l_quantity) AS m FROM tr GROUP BY 1), c AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS m FROM tr GROUP BY 1, 2)
 SELECT l_orderkey, round(coalesce(i.m, (SELECT avg(l_quantity) FROM tr)), 6) + 0.0 AS item_mean, round(coalesce(c.m, i.m, (SELECT avg(l_quantity) FROM tr)), 6) + 0.0 AS cell_mean
 FROM lineitem l LEFT JOIN i ON i.l_suppkey = l.l_suppkey LEFT JOIN c ON c.l_suppkey = l.l_suppkey AND c.l_returnflag = l.l_returnflag WHERE l_linenumber = 1""")
def baselines(spark: Spark, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    out = S.baselines(li.where("l_linenumber > 1"), li.where("l_linenumber = 1"), "l_suppkey", "l_returnflag", "l_quantity")
    return out.select("l_orderkey", rounded("item_mean").alias("item_mean"), rounded("cell_mean").alias("cell_mean"))


@query("SELECT l_suppkey, l_returnflag, round(sum(l_quantity / (1.0 + l_linenumber)) / sum(1 / (1.0 + l_linenumber)), 6) + 0.0 AS obs, round(1 / sum(1 / (1.0 + l_linenumber)), 6) + 0.0 AS var FROM lineitem GROUP BY 1, 2")
def pre_aggregation(spark: Spark, d: str) -> DataFrame:
    data = read(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_quantity").alias("obs"), (1.0 + F.col("l_linenumber")).alias("var"))
    return round_all(S.pre_aggregated(data, ["l_suppkey", "l_returnflag"]))


# Root, regions, nations: one level after the other, up and down again.
@query(f"""WITH {POP}, own AS (SELECT 'n' || c_nationkey AS node, count(*) / 9.0 AS p, sum(c_acctbal / 1000) / 9.0 AS s FROM customer GROUP BY 1),
 n AS (SELECT node_id AS node, parent_id AS up, coalesce(p, 0) AS p, coalesce(s, 0) AS s FROM pop LEFT JOIN own ON node = node_id WHERE parent_id <> 'root'),
 r AS (SELECT node_id AS node, coalesce(sum(p / (1 + 0.5 * p)), 0) AS p, coalesce(sum(s / (1 + 0.5 * p)), 0) AS s FROM pop LEFT JOIN n ON up = node_id WHERE parent_id = 'root' GROUP BY 1),
 t AS (SELECT 1 / (1 / 10.0 + sum(p / (1 + 2.0 * p))) AS v, sum(s / (1 + 2.0 * p)) AS s FROM r),
 t1 AS (SELECT 'root' AS node, v * s AS mean, v AS var FROM t),
 r1 AS (SELECT r.node, (r.s + t1.mean / 2.0) / (0.5 + r.p) AS mean, 1 / (0.5 + r.p) + (0.5 / (0.5 + r.p)) ** 2 * t1.var AS var, 0.5 / (0.5 + r.p) * t1.var AS cov FROM r, t1),
 n1 AS (SELECT n.node, (n.s + r1.mean / 0.5) / (2 + n.p) AS mean, 1 / (2 + n.p) + (2 / (2 + n.p)) ** 2 * r1.var AS var, 2 / (2 + n.p) * r1.var AS cov FROM n JOIN r1 ON r1.node = up)
 SELECT node, round(mean, 6) + 0.0 AS mean, round(var, 6) + 0.0 AS var, round(cov, 6) + 0.0 AS cov FROM (SELECT node, mean, var, NULL AS cov FROM t1 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM n1)""")
def tree_smoother(spark: Spark, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    data = c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("node"), (F.col("c_acctbal") / 1000).alias("obs"), F.lit(9.0).alias("var"))
    return round_all(S.tree_posterior(pop_dag(spark, d), data, [2.0, 0.5], 0.0, 10.0))


_ME = """CAST(count(*) AS DOUBLE) AS n, sum(w) AS w, sum(w * w) AS ww, sum(w * p) AS wp, sum(w * p * p) AS wpp, sum(w / t) AS wn, sum(w * w / t) AS wwn"""
_ME_OUT = """wp / w AS mean, greatest(least((((wpp - w * (wp / w) ** 2) * (n - 1) / n) - (wp / w) * (1 - wp / w) * (wn - wwn / w)) / ((wp / w) * (1 - wp / w) * (w - ww / w - wn + wwn / w)), 1 - 1e-20), 1e-20) AS rho"""


@query(f"""WITH {BINOM}, s AS (SELECT p_node, {_ME} FROM (SELECT p_node, n_trials::DOUBLE AS w, n_trials::DOUBLE AS t, n_pos / n_trials AS p FROM binom) GROUP BY 1)
 SELECT p_node, CAST(n AS BIGINT) AS N, round(mean, 6) + 0.0 AS mean, round(rho, 6) + 0.0 AS rho FROM (SELECT p_node, n, {_ME_OUT} FROM s)""")
def moment_est(spark: Spark, d: str) -> DataFrame:
    e = B.estimate(binom(spark, d), ["p_node"])
    return e.select("p_node", "N", rounded("mean").alias("mean"), rounded(1 / (F.col("size") + 1)).alias("rho"))


@query(f"""WITH {BINOM}, s AS (SELECT p_node, {_ME} FROM (SELECT p_node, n_trials::DOUBLE AS w, n_trials::DOUBLE AS t, n_pos / n_trials AS p FROM binom) GROUP BY 1),
 f AS (SELECT p_node, rho FROM (SELECT p_node, {_ME_OUT} FROM s)),
 s2 AS (SELECT p_node, {_ME} FROM (SELECT p_node, n_trials / (1 + (n_trials - 1) * rho) AS w, n_trials::DOUBLE AS t, n_pos / n_trials AS p FROM binom JOIN f USING (p_node)) GROUP BY 1)
 SELECT p_node, CAST(n AS BIGINT) AS N, round(mean, 6) + 0.0 AS mean, round(rho, 6) + 0.0 AS rho FROM (SELECT p_node, n, {_ME_OUT} FROM s2)""")
def moment_est_refined(spark: Spark, d: str) -> DataFrame:
    e = B.estimate(binom(spark, d), ["p_node"], refine=True)
    return e.select("p_node", "N", rounded("mean").alias("mean"), rounded(1 / (F.col("size") + 1)).alias("rho"))


@query(f"WITH {BINOM} SELECT p_node, round(m, 6) + 0.0 AS mean, round(CASE WHEN v >= m * (1 - m) THEN 1e-20 WHEN v = 0 THEN 1e20 ELSE m * (1 - m) / v - 1 END, 4) + 0.0 AS size FROM (SELECT p_node, avg(n_pos / n_trials) AS m, var_samp(n_pos / n_trials) AS v FROM binom GROUP BY 1)")
def naive_est(spark: Spark, d: str) -> DataFrame:
    return B.naive_estimate(binom(spark, d), ["p_node"]).select("p_node", rounded("mean").alias("mean"), rounded("size", 4).alias("size"))


@query(f"""WITH {BINOM}, {POP}, {_UP}, {TRE}, {_TUP}, s AS (SELECT p_node, t_node, sum(x) AS sx, sum(t) AS st, {_ME} FROM (SELECT u.ancestor AS p_node, v.ancestor AS t_node, n_trials::DOUBLE AS w, n_trials::DOUBLE AS t, n_pos AS x, n_pos / n_trials AS p
 FROM binom JOIN up u ON u.node = p_node JOIN tup v ON v.node = t_node) GROUP BY 1, 2)
 SELECT p_node, t_node, CAST(n AS BIGINT) AS N, round(wp / w, 6) + 0.0 AS mean, CASE WHEN n < 5 OR sx < 1 THEN 0 ELSE 1 END AS enough FROM s""")
def dag_moments(spark: Spark, d: str) -> DataFrame:
    cells = B.dag_moments(binom(spark, d), G.closure(pop_dag(spark, d)), G.closure(tre_tree(spark, d)), min_obs=5, min_pos=1)
    return cells.select("p_node", "t_node", "N", rounded("mean").alias("mean"), F.when(F.col("status") == 0, 0).otherwise(1).alias("enough"))


@query(f"""WITH {BINOM}, {POP}, {_UP}, {TRE}, {_TUP}, s AS (SELECT p_node, t_node, {_ME} FROM (SELECT u.ancestor AS p_node, v.ancestor AS t_node, n_trials::DOUBLE AS w, n_trials::DOUBLE AS t, n_pos / n_trials AS p
 FROM binom JOIN up u ON u.node = p_node JOIN tup v ON v.node = t_node) GROUP BY 1, 2)
 SELECT p_node, t_node, CAST(n AS BIGINT) AS N, round(wp / w, 6) + 0.0 AS mean FROM s""")
def cube_moments(spark: Spark, d: str) -> DataFrame:
    dims = {"p_node": G.closure(pop_dag(spark, d)), "t_node": G.closure(tre_tree(spark, d))}
    return B.cube_moments(binom(spark, d), dims).select("p_node", "t_node", "N", rounded("mean").alias("mean"))


def _document_ratings(spark: Spark, d: str) -> DataFrame:
    """Ratings of all documents: parts stand for documents in turn."""
    n = read(spark, d, "documents").agg(F.count("*").alias("docs"))
    return obs(spark, d).crossJoin(F.broadcast(n)).select(F.col("src_id").alias("user"), (F.col("dst_id") % F.col("docs")).alias("item"), (F.col("y") / 10).alias("y"))


@query()
def topic_factors(spark: Spark, d: str) -> DataFrame:
    """Ratings of documents by customers, explained by topics of their texts, which the ratings shape."""
    rows = place(_document_ratings(spark, d).withColumn("y", F.col("y").cast("double")), "user")
    fitted = P.fit_topic_factors(rows, corpus(spark, d), 2)
    return P.predict(rows.distinct("user", "item"), fitted)


@query(f"""WITH {OBS}, {CORPUS}, r AS (SELECT src_id AS u, dst_id % (SELECT count(*) FROM documents) AS item, y / 10 - 2.5 AS o, (src_id % 5) / 4.0 AS s1, (src_id % 3) / 2.0 AS s2 FROM obs),
 g AS (SELECT item, sum(s1 * s1) / 2 AS c11, sum(s1 * s2) / 2 AS c12, sum(s2 * s2) / 2 AS c22, sum(o * s1) / 2 AS o1, sum(o * s2) / 2 AS o2 FROM r GROUP BY 1),
 z AS (SELECT item, term, weight, CASE WHEN length(term) % 2 = 0 THEN weight ELSE 0 END AS w1, CASE WHEN length(term) % 2 = 1 THEN weight ELSE 0 END AS w2 FROM corpus),
 kt AS (SELECT term, sum(w1) AS t1, sum(w2) AS t2 FROM z GROUP BY 1), k AS (SELECT sum(w1) AS k1, sum(w2) AS k2, count(DISTINCT term) AS v FROM z), j AS (SELECT item, sum(w1) AS j1, sum(w2) AS j2, sum(weight) AS n FROM z GROUP BY 1),
 a AS (SELECT z.item, z.term, weight / n AS h, t1 - w1 AS t1, t2 - w2 AS t2, k1 - w1 AS k1, k2 - w2 AS k2, j1 - w1 AS j1, j2 - w2 AS j2, n, v, coalesce(c11, 0) AS c11, coalesce(c12, 0) AS c12, coalesce(c22, 0) AS c22, coalesce(o1, 0) AS o1, coalesce(o2, 0) AS o2
  FROM z JOIN kt USING (term) JOIN j ON j.item = z.item LEFT JOIN g ON g.item = z.item, k)
 SELECT item, term, 1 AS topic, round(ln(t1 + 0.1) - ln(k1 + v * 0.1) + ln(j1 + 0.2) + h * o1 - h * (c11 * j1 + c12 * j2) / n - h * h * c11 / 2, 6) + 0.0 AS logit FROM a
 UNION ALL SELECT item, term, 2, round(ln(t2 + 0.1) - ln(k2 + v * 0.1) + ln(j2 + 0.2) + h * o2 - h * (c12 * j1 + c22 * j2) / n - h * h * c22 / 2, 6) + 0.0 FROM a""")
def topic_conditional(spark: Spark, d: str) -> DataFrame:
    """Log weights of both topics of every term of every document, given ratings: what a sampler draws from."""
    state = place(corpus(spark, d).withColumn("topic", (F.length("term") % 2 + 1).cast("int")), "item")
    rows = _document_ratings(spark, d).withColumn("o", F.col("y") - 2.5)
    tastes = read(spark, d, "orders").select(F.col("o_custkey").alias("user")).distinct().select("user", F.array((F.col("user") % 5) / 4.0, (F.col("user") % 3) / 2.0).alias("s"))
    out = P.conditional(state, state.rows.select("term").distinct().count(), 2, 0.1, 0.2, P.rating_terms(rows, tastes, 2, 2.0))
    return round_all(out)


# One half-step of rank 1 from a given start.
@query(f"""WITH {OBS}, r AS (SELECT src_id, y, 1 + row_id % 3 AS w, 1 + (dst_id % 7) / 10.0 AS v FROM obs)
 SELECT src_id, round(sum(w * v * y) / (sum(w * v * v) + 0.1 * count(*)), 6) + 0.0 AS u FROM r GROUP BY 1""")
def matrix_factorisation(spark: Spark, d: str) -> DataFrame:
    rows = obs(spark, d).withColumn("weight", 1.0 + F.col("row_id") % 3)
    start = rows.select("dst_id").distinct().withColumn("mean", F.array(1 + (F.col("dst_id") % 7) / 10.0))
    return X.half_step(rows, "src_id", "dst_id", start, 1, 0.1).select("src_id", rounded(F.col("mean")[0]).alias("u"))


@query()
def matrix_factors(spark: Spark, d: str) -> DataFrame:
    return X.least_squares_factors(obs(spark, d).withColumn("weight", 1.0 + F.col("row_id") % 3), 2, iterations=2, weight="weight")[0]


@query()
def logistic_sampled(spark: Spark, d: str) -> DataFrame:
    """A logistic factor model by sampling: weights, effects and factors in turn."""
    rows = obs(spark, d).select("src_id", "dst_id", "row_id", (F.col("y") > 25).cast("double").alias("y"))
    setting = X.Setting(n_factors=1, is_logistic=True, samples=1, burn_in=1)
    rows = X.placed(rows, setting)
    return X.predict(rows, X.fit(rows, setting, iterations=1)).select("row_id", "pred")


@query()
def betabinom_mode(spark: Spark, d: str) -> DataFrame:
    return B.fit_cells(binom(spark, d), ["p_node"])


@query(f"""WITH {BINOM}, a AS (SELECT p_node, sum(ln(5.0 + j)) AS v, sum(1 / (5.0 + j)) AS g FROM binom, unnest(range(0, n_pos)) t(j) GROUP BY 1),
 b AS (SELECT p_node, sum(ln(15.0 + j)) AS v, sum(1 / (15.0 + j)) AS g FROM binom, unnest(range(0, n_trials - n_pos)) t(j) GROUP BY 1),
 c AS (SELECT p_node, sum(ln(20.0 + j)) AS v, sum(1 / (20.0 + j)) AS g FROM binom, unnest(range(0, n_trials)) t(j) GROUP BY 1)
 SELECT p_node, round(coalesce(a.v, 0) + coalesce(b.v, 0) - c.v, 4) + 0.0 AS loglik, round(20.0 * (coalesce(a.g, 0) - coalesce(b.g, 0)) * 0.1875, 4) + 0.0 AS d_mean,
  round((0.25 * coalesce(a.g, 0) + 0.75 * coalesce(b.g, 0) - c.g) * 20.0, 4) + 0.0 AS d_size FROM c LEFT JOIN a USING (p_node) LEFT JOIN b USING (p_node)""")
def betabinom_terms(spark: Spark, d: str) -> DataFrame:
    """Log-likelihood and gradient of each cell at mean 0.25 and size 20."""
    return round_all(B.likelihood_terms(binom(spark, d), ["p_node"], 0.25, 20.0), 4)


@query()
def betabinom_dag_mode(spark: Spark, d: str) -> DataFrame:
    return B.dag_posterior_modes(binom(spark, d).select("p_node", "n_pos", "n_trials"), pop_dag(spark, d), G.closure(pop_dag(spark, d)), 0.25, 20.0, 1.0, 1.0)


_PAIRS = f"""{BINOM}, {POP}, {TRE}, {_UP}, {_TUP}, w AS (SELECT up.ancestor AS p_node, tup.ancestor AS t_node, n_pos, n_trials FROM binom JOIN up ON up.node = binom.p_node JOIN tup ON tup.node = binom.t_node)"""


@query(f"""WITH RECURSIVE {_PAIRS} SELECT p_node, t_node, count(*) AS n_obs, CASE WHEN count(*) < 3 OR sum(n_trials) < 10 THEN 0 ELSE 2 END AS status, true AS stationary FROM w GROUP BY 1, 2""")
def betabinom_pair_modes(spark: Spark, d: str) -> DataFrame:
    """Modes over pairs of nodes of both DAGs under one prior; stationary: the gradient of the posterior, taken anew from the histograms, is zero there."""
    rows, pop, tre = binom(spark, d), pop_dag(spark, d), tre_tree(spark, d)
    modes = B.pair_modes(rows, pop, tre, 0.25, 20.0, 1.0, 1.0, fixed_prior=True)
    slope = B.mode_gradients(B.pair_histograms(rows, G.closure(pop), G.closure(tre)), modes.where(f"status = {B.MODE}"), 0.25, 20.0, 1.0, 1.0)
    return modes.join(slope, ["p_node", "t_node"], "left").select("p_node", "t_node", "n_obs", "status", F.coalesce(F.col("slope") < 1e-4, F.lit(True)).alias("stationary"))


@query()
def betabinom_pair_waves(spark: Spark, d: str) -> DataFrame:
    """The same with priors from the likeliest immediate parents, wave after wave."""
    return B.pair_modes(binom(spark, d), pop_dag(spark, d), tre_tree(spark, d), 0.25, 20.0, 1.0, 1.0)


@query()
def betabinom_coverage(spark: Spark, d: str) -> DataFrame:
    rows = binom(spark, d)
    return round_all(B.coverage(rows, B.estimate(rows, ["p_node"]), ["p_node"], 0.05, 0.95))


@query(f"""WITH {BINOM} SELECT p_node, count(*) AS n, round(avg(lgamma(n_trials + 1) - lgamma(n_pos + 1) - lgamma(n_trials - n_pos + 1) + lgamma(n_pos + 5.0) - lgamma(5.0) + lgamma(n_trials - n_pos + 15.0) - lgamma(15.0) - lgamma(n_trials + 20.0) + lgamma(20.0)), 5) + 0.0 AS loglik FROM binom GROUP BY 1""")
def heldout_loglik(spark: Spark, d: str) -> DataFrame:
    rows = binom(spark, d)
    params = rows.select("p_node").distinct().withColumn("mean", F.lit(0.25)).withColumn("size", F.lit(20.0))
    return round_all(B.heldout_loglik(rows, params, ["p_node"]), 5)


# --- topics --------------------------------------------------------------------------------------

_TOPIC = f"{CORPUS}, z AS (SELECT item, term, weight, CAST(length(term) % 4 + 1 AS INTEGER) AS topic FROM corpus), kt AS (SELECT topic, term, sum(weight) AS n FROM z GROUP BY 1, 2)"


def _assigned(spark: Spark, d: str) -> DataFrame:
    return corpus(spark, d).withColumn("topic", (F.length("term") % 4 + 1).cast("int"))


@query(f"WITH {_TOPIC} SELECT item, topic, sum(weight) AS n FROM z GROUP BY 1, 2")
def topic_counts(spark: Spark, d: str) -> DataFrame:
    return P.counters(_assigned(spark, d))["item_topic"]


@query(f"WITH {_TOPIC}, k AS (SELECT topic, sum(n) AS t FROM kt GROUP BY 1), v AS (SELECT count(DISTINCT term) AS w FROM corpus) SELECT topic, term, round((n + 0.1) / (t + w * 0.1), 9) + 0.0 AS phi FROM kt JOIN k USING (topic), v")
def topic_phi(spark: Spark, d: str) -> DataFrame:
    z = _assigned(spark, d)
    return round_all(P.phi(P.counters(z)["topic_term"], z.select("term").distinct().count(), 0.1), 9)


@query(f"WITH {_TOPIC}, j AS (SELECT item, topic, sum(weight) AS n FROM z GROUP BY 1, 2) SELECT item, topic, round(n / sum(n) OVER (PARTITION BY item), 6) + 0.0 AS share FROM j")
def topic_shares(spark: Spark, d: str) -> DataFrame:
    return round_all(P.topic_shares(P.counters(_assigned(spark, d))["item_topic"]))


@query(f"""WITH {_TOPIC}, v AS (SELECT CAST(count(DISTINCT term) AS DOUBLE) AS w FROM corpus), g AS (SELECT unnest([0.05, 0.1, 0.5]::DOUBLE[]) AS eta),
 s AS (SELECT eta, topic, sum(n) AS z, sum(lgamma(n + eta) - lgamma(eta)) AS s FROM kt, g GROUP BY 1, 2) SELECT eta, round(sum(lgamma(z + w * eta) - lgamma(w * eta) - s), 2) + 0.0 AS objective FROM s, v GROUP BY 1""")
def dirichlet_objective(spark: Spark, d: str) -> DataFrame:
    z = _assigned(spark, d)
    return round_all(P.dirichlet_objective(P.counters(z)["topic_term"], z.select("term").distinct().count(), [0.05, 0.1, 0.5]), 2)


@query()
def lda_fit(spark: Spark, d: str) -> DataFrame:
    state = P.gibbs_lda(corpus(spark, d), topics=3, sweeps=1)
    return P.counters(state)["topic"]


# --- multi-application and online models ---------------------------------------------------------


def _app_rows(spark: Spark, d: str) -> DataFrame:
    return obs(spark, d).select(F.col("src_id").alias("user"), F.col("ctx_id").alias("app"), F.col("src_context").alias("item"), "y").groupBy("user", "app", "item").agg(F.avg("y").alias("y"))


@query()
def multiapp_em(spark: Spark, d: str) -> DataFrame:
    model = A.fit(_app_rows(spark, d), 1, 1, iterations=2)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(model.history)], "iteration int, loglik double")


# The same with weights, and with items of flag R logistic (y above its mean) at xi = 1.
@query(f"""WITH {OBS}, r0 AS (SELECT src_id AS u, ctx_id AS app, src_context AS item, avg(y) AS y, 1.0 + src_id % 3 AS w FROM obs GROUP BY 1, 2, 3),
 rows AS (SELECT u, app, item, item = 'R' AS lg, CASE WHEN item = 'R' THEN CASE WHEN y > 25 THEN 1.0 ELSE 0.0 END ELSE y END AS y, w FROM r0),
 loads AS (SELECT app, item, CASE WHEN item = 'R' THEN 0.25 ELSE avg(y) END AS b, 0.5 + 0.25 * (ascii(item) % 3) AS c, CASE WHEN item = 'R' THEN 1.0 ELSE var_pop(y) END AS s2 FROM rows GROUP BY 1, 2),
 t AS (SELECT u, app, item, b, c, CASE WHEN lg THEN (y - 0.5) / (2 * tanh(0.5) / 4) ELSE y END AS o, CASE WHEN lg THEN 2 * w * tanh(0.5) / 4 ELSE w / s2 END AS p, CASE WHEN lg THEN 2 * w * tanh(0.5) / 4 ELSE w END AS q FROM rows JOIN loads USING (app, item)),
 e AS (SELECT u, app, 1 / (1 / 0.8 + sum(c * c * p)) AS w, sum(c * (o - b) * p) AS h FROM t GROUP BY 1, 2),
 g AS (SELECT u, 1 / (1 / 1.5 + sum(1 / 0.8 - w / 0.64)) AS var, sum(w * h / 0.8) AS t FROM e GROUP BY 1),
 z AS (SELECT u, app, w * (t * var / 0.8 + h) AS z, w + w * w / 0.64 * var AS v FROM e JOIN g USING (u))
 SELECT app, item, count(*) AS n, round(sum(q * o * o), 3) + 0.0 AS yy, round(sum(q * z), 4) + 0.0 AS z, round(sum(q * (z * z + v)), 4) + 0.0 AS zz, round(sum(q * o), 4) + 0.0 AS y, round(sum(q * o * z), 4) + 0.0 AS yz
 FROM t JOIN z USING (u, app) GROUP BY 1, 2""")
def multiapp_weighted(spark: Spark, d: str) -> DataFrame:
    """One step's statistics with row weights and logistic items."""
    flag = F.col("item") == "R"
    rows = _app_rows(spark, d).withColumn("w", 1.0 + F.col("user") % 3).withColumn("lg", flag).withColumn("y", F.when(flag, F.when(F.col("y") > 25, 1.0).otherwise(0.0)).otherwise(F.col("y")))
    loads = rows.groupBy("app", "item").agg(F.array(F.when(flag, 0.25).otherwise(F.avg("y")), F.lit(0.5) + 0.25 * (F.ascii("item") % 3)).alias("load"), F.when(flag, 1.0).otherwise(F.var_pop("y")).alias("noise"))
    model = A.MultiApp({n: A.App(np.eye(1), 0.8) for n in ("F", "O")}, loads, 1, 1.5)
    rows = A.prepared(rows, "w", "lg")
    out = A.item_statistics(rows, A.moments(rows, model), 1)
    named = {"yy": "yy", "zz[0]": "one", "zz[1]": "z", "zz[2]": "zz", "yz[0]": "y", "yz[1]": "yz"}
    return out.select("app", "item", "n", *(rounded(F.expr(c), 3 if n == "yy" else 4).alias(n) for c, n in named.items() if n != "one"))


@query()
def multiapp_logistic(spark: Spark, d: str) -> DataFrame:
    """EM with weights and logistic items on whole data: the bound after each step."""
    rows = _app_rows(spark, d).withColumn("w", 1.0 + F.col("user") % 3).withColumn("lg", F.col("item") == "R")
    rows = rows.withColumn("y", F.when(F.col("lg"), (F.col("y") > 25).cast("double")).otherwise(F.col("y")))
    model = A.fit(rows, 1, 1, iterations=2, weight="w", logistic="lg")
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(model.history)], "iteration int, bound double")


# With one global and one local factor, all matrices are numbers.
@query(f"""WITH {OBS}, rows AS (SELECT src_id AS u, ctx_id AS app, src_context AS item, avg(y) AS y FROM obs GROUP BY 1, 2, 3),
 loads AS (SELECT app, item, avg(y) AS b, 0.5 + 0.25 * (ascii(item) % 3) AS c, var_pop(y) AS s2 FROM rows GROUP BY 1, 2),
 e AS (SELECT u, app, 1 / (1 / 0.8 + sum(c * c / s2)) AS w, sum(c * (y - b) / s2) AS h FROM rows JOIN loads USING (app, item) GROUP BY 1, 2),
 g AS (SELECT u, 1 / (1 / 1.5 + sum(1 / 0.8 - w / 0.64)) AS var, sum(w * h / 0.8) AS t FROM e GROUP BY 1),
 z AS (SELECT u, app, w * (t * var / 0.8 + h) AS z, w + w * w / 0.64 * var AS v FROM e JOIN g USING (u))
 SELECT app, item, count(*) AS n, round(sum(y * y), 3) + 0.0 AS yy, round(sum(z), 4) + 0.0 AS z, round(sum(z * z + v), 4) + 0.0 AS zz, round(sum(y), 4) + 0.0 AS y, round(sum(y * z), 4) + 0.0 AS yz
 FROM rows JOIN z USING (u, app) GROUP BY 1, 2""")
def multiapp_statistics(spark: Spark, d: str) -> DataFrame:
    """The E-step of a given model: what each application's item needs for its regression."""
    rows = _app_rows(spark, d)
    loads = rows.groupBy("app", "item").agg(F.array(F.avg("y"), F.lit(0.5) + 0.25 * (F.ascii("item") % 3)).alias("load"), F.var_pop("y").alias("noise"))
    model = A.MultiApp({n: A.App(np.eye(1), 0.8) for n in ("F", "O")}, loads, 1, 1.5)
    out = A.item_statistics(rows, A.moments(rows, model), 1)
    named = {"yy": "yy", "zz[1]": "z", "zz[2]": "zz", "yz[0]": "y", "yz[1]": "yz"}
    return out.select("app", "item", "n", *(rounded(F.expr(c), 3 if n == "yy" else 4).alias(n) for c, n in named.items()))


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, CAST(length(event_type) AS DOUBLE) AS x, coalesce(value, 0) AS y, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5 + 1 AS INTEGER) AS batch FROM events),
 s AS (SELECT user_id, batch, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM e GROUP BY 1, 2),
 st AS (SELECT user_id, batch, 1 + n AS a, sx AS b, 1 + sxx AS c, sy AS g, sxy AS h, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 FROM s WHERE batch = 1
  UNION ALL SELECT s.user_id, s.batch, a * k + n, b * k + sx, c * k + sxx, g * k + sy, h * k + sxy, (c * g - b * h) / (a * c - b * b), (a * h - b * g) / (a * c - b * b)
   FROM (SELECT *, CASE WHEN a * 0.9 >= 1 AND c * 0.9 >= 1 THEN 0.9 ELSE 1.0 END AS k FROM st) t JOIN s ON s.user_id = t.user_id AND s.batch = t.batch + 1)
 SELECT e.user_id, ts, event_id, batch, y + 0.0 AS y, round(b0 + b1 * x, 5) + 0.0 AS pred FROM e JOIN st USING (user_id, batch)""")
def online_regression(spark: Spark, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "ts", "event_id", F.array(F.lit(1.0), F.length("event_type").cast("double")).alias("x"), F.coalesce("value", F.lit(0.0)).alias("value"))
    out = online.predict_batches(e, "user_id", ["ts", "event_id"], "x", "value", 5, None, [0.0, 0.0], 1.0, discount=0.9)
    return out.withColumn("pred", rounded("pred", 5)).withColumn("y", F.col("y") + 0.0)


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark: Spark, d: str) -> DataFrame:
    out = online.windowed_counts(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value")
    return out.withColumn("total", rounded("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def ars_logistic(spark: Spark, d: str) -> DataFrame:
    rows = obs(spark, d).select("src_id", F.array(F.lit(1.0), (F.col("dst_context").substr(1, 1) == "1").cast("double")).alias("x"), (F.col("y") > 25).cast("int").alias("y"))
    # One regression for each context of the destination.
    return L.regression_by_group(rows.withColumn("g", F.col("src_id") % 5), ["g"], "x", "y", samples=20, burn_in=5)
