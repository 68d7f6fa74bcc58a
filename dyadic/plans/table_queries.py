"""Queries of the table layer: encoding, reshaping, filters, joins, aggregates, windows, sets and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import encode as E
from ..operators import metrics as M
from ..operators import table as T
from ..operators.graph import cut
from .registry import query, round_all, rounded
from .views import CORPUS, OBS, corpus, obs, read

Spark = SparkSession


# --- encoding and reshaping ----------------------------------------------------------------------


@query(f"WITH {OBS} SELECT src_id AS id, CAST(row_number() OVER (ORDER BY src_id) AS BIGINT) AS idx FROM (SELECT DISTINCT src_id FROM obs)")
def encode_ids(spark: Spark, d: str) -> DataFrame:
    return E.dictionary((obs(spark, d), "src_id"))


@query(f"WITH {OBS} SELECT id, CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS idx FROM (SELECT src_id AS id FROM obs UNION SELECT dst_id FROM obs)")
def encode_shared_ids(spark: Spark, d: str) -> DataFrame:
    rows = obs(spark, d)
    return E.dictionary((rows, "src_id"), (rows, "dst_id"))


@query(f"""WITH {OBS}, tr AS (SELECT * FROM obs WHERE dst_context < '3'), te AS (SELECT * FROM obs WHERE dst_context >= '3'),
 k AS (SELECT src_id AS id, row_number() OVER (ORDER BY src_id) AS idx FROM (SELECT DISTINCT src_id FROM tr)),
 n AS (SELECT src_id AS id, min(row_id) AS f FROM te WHERE src_id NOT IN (SELECT id FROM k) GROUP BY 1)
 SELECT id, CAST(idx AS BIGINT) AS idx FROM k UNION ALL SELECT id, CAST((SELECT coalesce(max(idx), 0) FROM k) + row_number() OVER (ORDER BY f, id) AS BIGINT) FROM n""")
def extend_ids_test(spark: Spark, d: str) -> DataFrame:
    rows = obs(spark, d)
    return E.extended(E.dictionary((rows.where("dst_context < '3'"), "src_id")), rows.where("dst_context >= '3'"), "src_id", "row_id")


@query(f"""WITH {OBS}, s AS (SELECT src_id, row_number() OVER (ORDER BY src_id) AS i FROM (SELECT DISTINCT src_id FROM obs)),
 t AS (SELECT ctx_id, row_number() OVER (ORDER BY ctx_id) AS i FROM (SELECT DISTINCT ctx_id FROM obs))
 SELECT row_id, CAST(s.i AS BIGINT) AS src_idx, CAST(t.i AS BIGINT) AS ctx_idx FROM obs JOIN s USING (src_id) JOIN t USING (ctx_id)""")
def index_observations(spark: Spark, d: str) -> DataFrame:
    return E.index_observations(obs(spark, d))[0].select("row_id", "src_idx", "ctx_idx")


@query(f"WITH {OBS} SELECT count(*) AS kept, CAST(sum(CASE WHEN src_id = dst_id THEN 1 ELSE 0 END) AS BIGINT) AS left_over FROM obs WHERE src_id <> dst_id")
def self_link_removal(spark: Spark, d: str) -> DataFrame:
    rows, _ = E.index_observations(obs(spark, d).select("src_id", "dst_id", "y"), same_ids=True, drop_self_links=True)
    return rows.agg(F.count("*").alias("kept"), F.sum(F.when(F.col("src_id") == F.col("dst_id"), 1).otherwise(0)).alias("left_over"))


@query("SELECT s_suppkey AS row, CAST(i AS INTEGER) AS index, round(v, 6) + 0.0 AS value FROM (SELECT s_suppkey, 1 AS i, CAST(s_nationkey AS DOUBLE) AS v FROM supplier UNION ALL SELECT s_suppkey, 2, s_acctbal FROM supplier) WHERE v <> 0")
def dense_to_sparse(spark: Spark, d: str) -> DataFrame:
    return round_all(E.dense_to_triples(read(spark, d, "supplier"), "s_suppkey", ["s_nationkey", "s_acctbal"]))


@query("SELECT l_orderkey AS row, coalesce(max(CASE WHEN l_linenumber = 1 THEN l_quantity END), 0.0) AS c1, coalesce(max(CASE WHEN l_linenumber = 2 THEN l_quantity END), 0.0) AS c2, coalesce(max(CASE WHEN l_linenumber = 3 THEN l_quantity END), 0.0) AS c3 FROM lineitem GROUP BY 1")
def sparse_to_dense(spark: Spark, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("index"), F.col("l_quantity").alias("value"))
    return E.triples_to_dense(rows, 3)


@query("SELECT s.s_suppkey AS id, row_number() OVER (ORDER BY s.s_suppkey) AS idx, CAST(s.s_nationkey AS DOUBLE) AS x1, round(s.s_acctbal, 4) + 0.0 AS x2, 1.0::DOUBLE AS x3 FROM supplier s")
def gather_dense_features(spark: Spark, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    got = E.gather_dense(E.dictionary((s, "s_suppkey")), s, "s_suppkey", ["s_nationkey", "s_acctbal"], intercept=True, intercept_first=False)
    return got.select("id", "idx", *(rounded(F.col("x")[k], 4).alias(f"x{k + 1}") for k in range(3)))


@query("""WITH t AS (SELECT o_custkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS i, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)
 SELECT c_custkey AS id, coalesce(max(CASE WHEN i = 1 THEN v END), 0.0) AS x1, coalesce(max(CASE WHEN i = 5 THEN v END), 0.0) AS x5, 1.0::DOUBLE AS x6 FROM customer LEFT JOIN t ON id = c_custkey GROUP BY 1""")
def gather_sparse_features(spark: Spark, d: str) -> DataFrame:
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("index")).agg(F.count("*").cast("double").alias("value"))
    got = E.gather_sparse(E.dictionary((read(spark, d, "customer"), "c_custkey")), o, "id", 5, intercept=True)
    return got.select("id", F.col("x")[0].alias("x1"), F.col("x")[4].alias("x5"), F.col("x")[5].alias("x6"))


@query("SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderstatus = '{v}' THEN 1.0::DOUBLE ELSE 0.0 END AS o_orderstatus{v}" for v in "OP") + " FROM orders")
def one_hot_status(spark: Spark, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return o.select("o_orderkey", *E.one_hot(o, "o_orderstatus", ["F", "O", "P"]))


@query("SELECT p_partkey, p_type AS kind, p_brand AS brand FROM part")
def join_split_columns(spark: Spark, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", E.join_columns(["p_type", "p_brand"], "|").alias("both"))
    return E.split_column(p, "both", ["kind", "brand"], "|").select("p_partkey", "kind", "brand")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25")
def true_index(spark: Spark, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("q"))
    flags = F.transform("q", lambda x: x["l_quantity"] > 25)
    return rows.select("l_orderkey", "q", F.explode(E.true_places(flags)).alias("i")).select("l_orderkey", F.get("q", F.col("i") - 1)["l_linenumber"].alias("l_linenumber"))


@query("SELECT n_nationkey AS idx, count(*) AS times FROM nation, range(0, n_regionkey) t GROUP BY 1")
def repeat_index(spark: Spark, d: str) -> DataFrame:
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_regionkey").alias("k"))
    return E.repeat_index(n, "idx", "k").groupBy("idx").agg(F.count("*").alias("times"))


@query("SELECT c_custkey, c_mktsegment, round(CASE WHEN s_suppkey IS NOT NULL THEN s_acctbal ELSE c_acctbal END, 4) + 0.0 AS c_acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def keyed_overwrite(spark: Spark, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return E.overwrite(c, s, ["c_custkey"]).withColumn("c_acctbal", rounded("c_acctbal", 4))


@query(f"WITH {OBS} SELECT src_context AS context, count(DISTINCT src_id) AS n FROM obs GROUP BY 1 UNION ALL SELECT NULL, count(DISTINCT src_id) FROM obs")
def subset_info(spark: Spark, d: str) -> DataFrame:
    return E.subset_info(obs(spark, d), "src_id", "src_context").groupBy("context").agg(F.count("*").alias("n"))


@query("SELECT l_linenumber AS k, o_custkey AS \"group\", round(sum(l_quantity * o_totalprice / 997.0), 2) + 0.0 AS sum FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def select_group_sum(spark: Spark, d: str) -> DataFrame:
    cells = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("k"), F.col("l_orderkey").alias("j"), F.col("l_quantity").alias("value"))
    picks = read(spark, d, "orders").select(F.col("o_orderkey").alias("j"), F.col("o_custkey").alias("group"), (F.col("o_totalprice") / 997.0).alias("weight"))
    return round_all(E.select_group_sum(cells, picks), 2)


@query("SELECT vec_id, round(sum(v * v), 4) + 0.0 AS norm2, CAST(count(*) AS INTEGER) AS width FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1")
def array_algebra(spark: Spark, d: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return read(spark, d, "embeddings").select("vec_id", rounded(C.dot(e, e), 4).alias("norm2"), F.size(e).alias("width"))


# --- filters -------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT o_custkey AS voter, l_suppkey AS author FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 u AS (SELECT DISTINCT voter AS u FROM r GROUP BY voter HAVING count(*) >= 40), b AS (SELECT * FROM r WHERE voter IN (SELECT u FROM u) AND author IN (SELECT u FROM u))
 SELECT voter, author, count(*) AS n FROM b WHERE voter IN (SELECT author FROM b) AND author IN (SELECT voter FROM b) GROUP BY 1, 2""")
def semi_filter_mutual(spark: Spark, d: str) -> DataFrame:
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    r = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("voter"), F.col("l_suppkey").alias("author"))
    users = r.groupBy("voter").count().where("count >= 40").select(F.col("voter").alias("user"))
    return T.mutual(r, users).groupBy("voter", "author").agg(F.count("*").alias("n"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 35")
def support_filter(spark: Spark, d: str) -> DataFrame:
    return T.supported(read(spark, d, "lineitem"), ["l_partkey"], 35).groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, greatest(least(l_quantity, 40.0), 10.0) AS clamped, l_quantity > 10 AND l_quantity < 40 AS inside FROM lineitem")
def range_clamp(spark: Spark, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.clamp(q, 10.0, 40.0).alias("clamped"), C.strictly_within(q, 10.0, 40.0).alias("inside"))


@query(f"WITH {OBS} SELECT count(*) AS n, count(DISTINCT dst_id) AS ids FROM obs WHERE dst_id IN (SELECT dst_id FROM obs WHERE ctx_id = 'F')")
def mismatch_removal(spark: Spark, d: str) -> DataFrame:
    rows = obs(spark, d)
    ids = E.dictionary((rows.where("ctx_id = 'F'"), "dst_id"))
    return E.matched(rows, ids, "dst_id").agg(F.count("*").alias("n"), F.count_distinct("dst_id").alias("ids"))


# --- joins ---------------------------------------------------------------------------------------


@query("SELECT n_regionkey AS k, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def natural_join(spark: Spark, d: str) -> DataFrame:
    n = read(spark, d, "nation").select(F.col("n_regionkey").alias("k"), "n_name")
    return T.natural_join(n, read(spark, d, "region").select(F.col("r_regionkey").alias("k"))).groupBy("k").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS orders FROM (SELECT c_custkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) a
 FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) b ON a.k = b.k""")
def my_merge_default(spark: Spark, d: str) -> DataFrame:
    a = read(spark, d, "customer").where("c_acctbal > 0").groupBy(F.col("c_custkey").alias("k")).agg(F.count("*").alias("customers"))
    b = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    return T.defaulting_join(a, b, ["k"])


@query(f"""WITH {OBS}, a AS (SELECT src_id, src_context, avg(y) AS m FROM obs GROUP BY 1, 2) SELECT row_id, round(m, 6) + 0.0 AS alpha FROM obs JOIN a USING (src_id, src_context)""")
def composite_lookup(spark: Spark, d: str) -> DataFrame:
    rows = obs(spark, d)
    table = rows.groupBy("src_id", "src_context").agg(F.avg("y").alias("m"))
    return T.fold_lookup(rows, table, {"src_id": "src_id", "src_context": "src_context"}, "m", "alpha").select("row_id", rounded("alpha").alias("alpha"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark: Spark, d: str) -> DataFrame:
    return T.ordered_except(read(spark, d, "customer").withColumn("pos", F.col("c_custkey")), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "pos").select("c_custkey")


# --- aggregates ----------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) + 0.0 AS l_quantity, round(max(l_extendedprice), 2) + 0.0 AS l_extendedprice FROM lineitem GROUP BY 1, 2")
def table_aggregate(spark: Spark, d: str) -> DataFrame:
    return round_all(T.aggregate(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"], [F.avg, F.max]))


@query("SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total FROM lineitem")
def aggregate_broadcast_back(spark: Spark, d: str) -> DataFrame:
    return T.aggregate_onto_rows(read(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", F.sum, "total").select("l_orderkey", "l_linenumber", "total")


@query("SELECT l_suppkey, " + ", ".join(f"CAST(sum(CASE WHEN l_returnflag = '{v}' THEN 1 ELSE 0 END) AS BIGINT) AS {v}" for v in "ANR") + " FROM lineitem GROUP BY 1")
def hist_group_by(spark: Spark, d: str) -> DataFrame:
    return T.count_pivot(read(spark, d, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"])


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cross_table_margins(spark: Spark, d: str) -> DataFrame:
    return T.cross_table(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("""WITH c AS (SELECT l_returnflag, l_linestatus, CAST(count(*) AS DOUBLE) AS n, grouping(l_returnflag) AS gx, grouping(l_linestatus) AS gy FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus))
 SELECT l_returnflag, l_linestatus, round(CASE WHEN gy = 1 THEN n ELSE n / max(CASE WHEN gy = 1 THEN n END) OVER (PARTITION BY l_returnflag, gx) END, 6) + 0.0 AS value FROM c""")
def cross_table_fraction(spark: Spark, d: str) -> DataFrame:
    return round_all(T.cross_table(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "row"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark: Spark, d: str) -> DataFrame:
    return T.rollup_counts(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]).withColumn("level", F.col("level").cast("long"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def distinct_count(spark: Spark, d: str) -> DataFrame:
    return T.distinct_count(read(spark, d, "lineitem"), ["l_suppkey"], "l_partkey")


@query("SELECT l_linenumber AS col, sum(l_quantity) AS sum FROM lineitem GROUP BY 1")
def margin_sums(spark: Spark, d: str) -> DataFrame:
    return T.margin_sums(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_quantity").alias("value")), "col")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) + 0.0 AS share FROM lineitem")
def normalize_group(spark: Spark, d: str) -> DataFrame:
    return T.normalize_by(read(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "share").select("l_orderkey", "l_linenumber", rounded("share").alias("share"))


@query("""WITH g AS (SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS x, count(*) AS y FROM lineitem GROUP BY 1)
 SELECT l_suppkey, round((x + (SELECT sum(x) / sum(y) FROM g) * 10) / (y + 10), 6) + 0.0 AS ratio FROM g""")
def smooth_ratio(spark: Spark, d: str) -> DataFrame:
    g = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("x"), F.count("*").alias("y"))
    return T.smooth_ratio(g, "x", "y", 10.0).select("l_suppkey", rounded("ratio").alias("ratio"))


@query("""SELECT l_suppkey, round(avg(s), 6) + 0.0 AS mean, round(var_samp(s), 6) + 0.0 AS var, count(*) AS n FROM
 (SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 2.0 WHEN 'R' THEN -10.0 END AS s FROM lineitem WHERE l_returnflag <> 'N') GROUP BY 1""")
def label_score(spark: Spark, d: str) -> DataFrame:
    return round_all(T.label_score(read(spark, d, "lineitem"), "l_suppkey", "l_returnflag", {"A": 2.0, "R": -10.0}, ["N"]))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) + 0.0 AS q50, round(quantile_cont(l_extendedprice, 0.9), 4) + 0.0 AS q90 FROM lineitem GROUP BY 1")
def quantiles(spark: Spark, d: str) -> DataFrame:
    q = T.label_keyed_quantiles(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.5, 0.9])
    return q.select("l_returnflag", rounded(F.col("quantiles")[0], 4).alias("q50"), rounded(F.col("quantiles")[1], 4).alias("q90"))


@query("""SELECT CAST(floor((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 10 / (SELECT count(*) FROM orders)) AS INTEGER) AS bin, o_orderkey FROM orders""")
def decile_bins(spark: Spark, d: str) -> DataFrame:
    return T.decile_bins(read(spark, d, "orders"), "o_totalprice", "o_orderkey").select("bin", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey), 10) + 0.0 AS l_quantity FROM lineitem")
def centred(spark: Spark, d: str) -> DataFrame:
    return round_all(T.centred(read(spark, d, "lineitem"), "l_quantity", ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_quantity"), 10)


@query("SELECT l_suppkey, round(avg(l_quantity), 6) + 0.0 AS mean, round(var_samp(l_quantity), 4) + 0.0 AS var, round(covar_pop(l_quantity, l_discount), 6) + 0.0 AS cov FROM lineitem GROUP BY 1")
def moments_from_sums(spark: Spark, d: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_discount")
    g = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.sum(y).alias("t"), F.sum(x * y).alias("p"))
    mean, var = T.moments_from_sums(F.col("n"), F.col("s"), F.col("q"))
    cov = T.covariance_from_sums(F.col("n"), F.col("s"), F.col("t"), F.col("p"))
    return g.select("l_suppkey", rounded(mean).alias("mean"), rounded(var, 4).alias("var"), rounded(cov).alias("cov"))


@query("""WITH f AS (SELECT l_returnflag AS g, 1.0 AS x1, l_quantity AS x2, l_discount AS x3, l_extendedprice / 1000 AS y FROM lineitem)
 SELECT g, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(v, 2) + 0.0 AS value FROM (
 SELECT g, 1 AS i, 1 AS j, sum(x1 * x1) AS v FROM f GROUP BY g UNION ALL SELECT g, 1, 2, sum(x1 * x2) FROM f GROUP BY g UNION ALL SELECT g, 1, 3, sum(x1 * x3) FROM f GROUP BY g
 UNION ALL SELECT g, 2, 2, sum(x2 * x2) FROM f GROUP BY g UNION ALL SELECT g, 2, 3, sum(x2 * x3) FROM f GROUP BY g UNION ALL SELECT g, 3, 3, sum(x3 * x3) FROM f GROUP BY g
 UNION ALL SELECT g, 1, 0, sum(x1 * y) FROM f GROUP BY g UNION ALL SELECT g, 2, 0, sum(x2 * y) FROM f GROUP BY g UNION ALL SELECT g, 3, 0, sum(x3 * y) FROM f GROUP BY g)""")
def gram(spark: Spark, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.array(F.lit(1.0), F.col("l_quantity"), F.col("l_discount")).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return round_all(T.gram(rows, "x", "y", by=["g"]), 2)


@query("""WITH g AS (SELECT l_linenumber AS trials, l_orderkey % 1000 AS n FROM lineitem), m AS (SELECT trials, min(n) AS least FROM g GROUP BY 1)
 SELECT trials, max(least) OVER (ORDER BY trials ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS need FROM m""")
def min_support(spark: Spark, d: str) -> DataFrame:
    return T.least_support(read(spark, d, "lineitem").select(F.col("l_linenumber").alias("trials"), (F.col("l_orderkey") % 1000).alias("n")), "trials", "n")


@query("SELECT l_orderkey, CAST(min(l_linenumber) AS INTEGER) AS place FROM lineitem l WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey) GROUP BY 1")
def argmax(spark: Spark, d: str) -> DataFrame:
    return T.argmax(read(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_linenumber")


# --- metrics -------------------------------------------------------------------------------------

_PRED = "(SELECT l_suppkey AS g, (l_orderkey * 8 + l_linenumber) * 100000007 + CAST(round(l_extendedprice * 100) AS BIGINT) AS id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_discount * 10 AS p FROM lineitem)"


def _predictions(spark: Spark, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000007 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("id"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), (F.col("l_discount") * 10).alias("p"))


@query(f"SELECT g, count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 6) + 0.0 AS p FROM {_PRED} GROUP BY g HAVING count(*) >= 5")
def rmse_per_group(spark: Spark, d: str) -> DataFrame:
    return round_all(M.rmse_by_group(_predictions(spark, d), "g", "y", ["p"], 5))


@query(f"""SELECT g, n, round(CASE WHEN n >= 10 THEN pr END, 6) + 0.0 AS precision FROM (SELECT g, count(*) AS n, avg(CASE WHEN r <= 10 THEN y END) AS pr FROM
 (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p DESC, id) AS r FROM {_PRED}) GROUP BY g)""")
def precision_at_k(spark: Spark, d: str) -> DataFrame:
    return round_all(M.precision_at_k(_predictions(spark, d), "g", "y", "p", "id", 10))


@query(f"""WITH r AS (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2.0 AS m FROM {_PRED}),
 s AS (SELECT g, count(*) AS n, sum(y) AS pos, sum(CASE WHEN y = 1 THEN m ELSE 0 END) AS rk FROM r GROUP BY g)
 SELECT g, n, round((rk - pos * (pos + 1) / 2.0) / (pos * (n - pos)), 6) + 0.0 AS auc FROM s WHERE pos > 0 AND pos < n""")
def auc_per_group(spark: Spark, d: str) -> DataFrame:
    return round_all(M.auc_by_group(_predictions(spark, d), "g", "y", "p"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS pearson FROM lineitem GROUP BY 1")
def pearson(spark: Spark, d: str) -> DataFrame:
    return round_all(M.correlation(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]))


@query("""WITH e AS (SELECT o_custkey AS g, o_orderkey AS id, o_totalprice AS x, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS y FROM orders)
 SELECT a.g, (SELECT count(*) FROM e c WHERE c.g = a.g) AS n, round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / 2 / ((SELECT count(*) FROM e c WHERE c.g = a.g) * ((SELECT count(*) FROM e c WHERE c.g = a.g) - 1) / 2.0), 6) + 0.0 AS tau
 FROM e a JOIN e b ON a.g = b.g AND a.id <> b.id GROUP BY a.g""")
def kendall(spark: Spark, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_totalprice").alias("x"), F.substring("o_orderpriority", 1, 1).cast("int").alias("y"))
    return round_all(M.kendall(o, "x", "y", "g"))


@query(f"SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) + 0.0 AS r2, round(avg(abs(y - p)), 6) + 0.0 AS mae, round(sqrt(sum((y - p) * (y - p) / (1 + p)) / sum(1 / (1 + p))), 6) + 0.0 AS weighted FROM {_PRED}")
def regression_metrics(spark: Spark, d: str) -> DataFrame:
    y, p = F.col("y"), F.col("p")
    return _predictions(spark, d).agg(rounded(M.r_square(y, p)).alias("r2"), rounded(M.mae(y, p)).alias("mae"), rounded(M.weighted_rmse(y, p, 1 + p)).alias("weighted"))


# --- windows -------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank FROM orders")
def score_rank(spark: Spark, d: str) -> DataFrame:
    return T.ranked(read(spark, d, "orders"), "o_totalprice", "o_orderkey").select("o_orderkey", "rank")


@query("SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def topk(spark: Spark, d: str) -> DataFrame:
    return T.top_k(read(spark, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey", 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT event_id, CAST(b AS INTEGER) AS batch FROM (SELECT event_id, floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 5) + 1 AS b FROM events) WHERE b <= 3")
def batch_number(spark: Spark, d: str) -> DataFrame:
    return T.batched(read(spark, d, "events"), "user_id", ["ts", "event_id"], 5, 3).select("event_id", "batch")


@query("SELECT l_returnflag, CAST(j AS INTEGER) AS j, count(*) AS n FROM lineitem, range(0, 7) t(j) WHERE l_linenumber > j GROUP BY 1, 2")
def suffix_counts(spark: Spark, d: str) -> DataFrame:
    return T.suffix_counts(read(spark, d, "lineitem"), ["l_returnflag"], "l_linenumber")


@query("SELECT o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place, count(*) OVER () AS n FROM orders) WHERE (place - 1) % greatest(n // 100, 1) = 0 OR place = n")
def subsample_curve(spark: Spark, d: str) -> DataFrame:
    return T.every_nth(read(spark, d, "orders"), ["o_totalprice", "o_orderkey"], 100).select("o_orderkey", "place")


# --- sets and splits -----------------------------------------------------------------------------


@query("SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def union_all(spark: Spark, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS k, p_size AS a, p_size + 1 AS b FROM (SELECT p_partkey, p_size FROM part WHERE p_size % 7 = 0)")
def differences(spark: Spark, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    changed = p.withColumn("v", F.when(F.col("v") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return T.differences(p, changed, ["k"], 1e-9).select("k", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))


@query("""SELECT o_orderkey, r <= ceil(0.7 * n) AS train FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey * 7919) % 1009, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)""")
def strat_split(spark: Spark, d: str) -> DataFrame:
    from pyspark.sql import Window

    # The split by a rule of the key that SQL shares; split_within_items orders by a hash of its own.
    w = Window.partitionBy("o_custkey")
    r = F.row_number().over(w.orderBy((F.col("o_orderkey") * 7919) % 1009, "o_orderkey"))
    o = read(spark, d, "orders").withColumn("r", r).withColumn("n", F.max("r").over(w))
    return o.select("o_orderkey", (F.col("r") <= F.ceil(F.lit(0.7) * F.col("n"))).alias("train"))


def _md5(column: str, seed: int = 0) -> str:
    """SQL of table.portable_hash."""
    return f"CAST('0x' || substr(md5('{seed}|' || {column}), 1, 8) AS BIGINT)"


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_md5('o_orderkey')}, o_orderkey) <= ceil(0.7 * count(*) OVER (PARTITION BY o_custkey)) AS train FROM orders")
def item_split(spark: Spark, d: str) -> DataFrame:
    return T.split_within_items(read(spark, d, "orders"), "o_custkey", "o_orderkey", 0.7).select("o_orderkey", "train")


@query(f"""WITH c AS (SELECT o_custkey, row_number() OVER (ORDER BY {_md5('o_custkey')}, o_custkey) <= ceil(0.8 * count(*) OVER ()) AS train FROM (SELECT DISTINCT o_custkey FROM orders))
 SELECT o_orderkey, train FROM orders JOIN c USING (o_custkey)""")
def group_split(spark: Spark, d: str) -> DataFrame:
    return T.split_items(read(spark, d, "orders"), "o_custkey", 0.8).select("o_orderkey", "train")


@query(f"""WITH {OBS}, u AS (SELECT DISTINCT src_id FROM obs ORDER BY {_md5('src_id')}, src_id LIMIT 20), i AS (SELECT DISTINCT dst_id FROM obs ORDER BY {_md5('dst_id')}, dst_id LIMIT 20),
 c AS (SELECT row_id, src_id IN (SELECT src_id FROM u) OR dst_id IN (SELECT dst_id FROM i) AS cold FROM obs),
 k AS (SELECT greatest((SELECT count(*) FROM obs) // 4 - count(*), 0) AS need FROM c WHERE cold),
 m AS (SELECT row_id, row_number() OVER (ORDER BY {_md5('row_id', 1)}, row_id) <= need AS more FROM c, k WHERE NOT cold)
 SELECT row_id, cold OR row_id IN (SELECT row_id FROM m WHERE more) AS test FROM c""")
def cold_start_split(spark: Spark, d: str) -> DataFrame:
    rows = cut(obs(spark, d).select("row_id", "src_id", "dst_id"))
    return T.cold_start_split(rows, "src_id", "dst_id", "row_id", 20, 20, rows.count() // 4).select("row_id", "test")


@query(f"SELECT o_orderkey, {_md5('o_orderkey')} / 4294967296.0 < 0.75 AS train FROM orders")
def bernoulli_split(spark: Spark, d: str) -> DataFrame:
    return T.bernoulli_split(read(spark, d, "orders"), "o_orderkey", 0.75).select("o_orderkey", "train")


# --- scalar functions ----------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, round(ln(p / (1 - p)), 6) + 0.0 AS logit, round(1 / (1 + exp(-x)), 6) + 0.0 AS inv, round(ln(1 + exp(x / 10)), 6) + 0.0 AS softplus,
 round(tanh(x / 20) / (4 * x / 10), 6) + 0.0 AS lambda, round(CASE WHEN x < 0 THEN 0.6 / (1 + exp(-1.4 * x)) ELSE -0.4 + 1.4 / (1 + exp(-0.6 * x)) END, 6) + 0.0 AS spline
 FROM (SELECT l_orderkey, l_linenumber, (l_quantity + 1) / 60 AS p, l_quantity - 25.5 AS x FROM lineitem)""")
def link_functions(spark: Spark, d: str) -> DataFrame:
    p, x = (F.col("l_quantity") + 1) / 60, F.col("l_quantity") - 25.5
    return round_all(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.logit(p).alias("logit"), C.inv_logit(x).alias("inv"), C.log1p_exp(x / 10).alias("softplus"), C.bound_weight(x / 10).alias("lambda"), C.spline_link(0.3, x).alias("spline")))


@query("""SELECT l_orderkey, l_linenumber, round(m * (1 - m) / (s + 1), 8) + 0.0 AS var, round(1 / (s + 1), 8) + 0.0 AS rho, round(sqrt(m * (1 - m) / (s + 1)) / m, 6) + 0.0 AS cv, round(s, 4) + 0.0 AS size
 FROM (SELECT l_orderkey, l_linenumber, l_quantity / 60 AS m, 5 + l_linenumber * 2.5::DOUBLE AS s FROM lineitem)""")
def beta_converters(spark: Spark, d: str) -> DataFrame:
    m, s = F.col("l_quantity") / 60, 5 + F.col("l_linenumber") * 2.5
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", rounded(C.beta_var(m, s), 8).alias("var"), rounded(C.beta_rho(s), 8).alias("rho"), rounded(C.beta_cv(m, s)).alias("cv"), rounded(C.beta_size_from_var(m, C.beta_var(m, s)), 4).alias("size")
    )


_BB = "(SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS x, l_quantity + 7 AS n, 0.2::DOUBLE AS m, 12.0::DOUBLE AS s FROM lineitem)"


@query(f"""SELECT l_orderkey, l_linenumber, round(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + lgamma(x + m * s) - lgamma(m * s) + lgamma(n - x + s - m * s) - lgamma(s - m * s) - lgamma(n + s) + lgamma(s), 6) + 0.0 AS loglik FROM {_BB}""")
def betabinom_loglik(spark: Spark, d: str) -> DataFrame:
    x, n = F.col("l_linenumber").cast("double"), F.col("l_quantity") + 7
    return round_all(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.betabinom_loglik(x, n, F.lit(0.2), F.lit(12.0)).alias("loglik")))


@query(f"""SELECT l_orderkey, l_linenumber, round(list_sum(list_transform(range(0, CAST(x AS BIGINT) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + lgamma(j + m * s) - lgamma(m * s)
 + lgamma(n - j + s - m * s) - lgamma(s - m * s) - lgamma(n + s) + lgamma(s)))), 6) + 0.0 AS cdf FROM {_BB}""")
def betabinom_cdf(spark: Spark, d: str) -> DataFrame:
    x, n = F.col("l_linenumber").cast("double"), F.col("l_quantity") + 7
    return round_all(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.betabinom_cdf(x, n, F.lit(0.2), F.lit(12.0)).alias("cdf")))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], list_transform(embedding::DOUBLE[], lambda x: 0.5 * x)), 4) + 0.0 AS score FROM embeddings")
def tensor_score(spark: Spark, d: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return read(spark, d, "embeddings").select("vec_id", rounded(C.dot(e, e, F.array_repeat(F.lit(0.5), F.size(e))), 4).alias("score"))


@query("SELECT p_partkey, CAST(x AS BIGINT) AS linear, CAST(x % 60 AS BIGINT) AS a, CAST(x // 60 AS BIGINT) AS b FROM (SELECT p_partkey, p_size + 60 * (p_partkey % 9) AS x FROM part)")
def linear_index(spark: Spark, d: str) -> DataFrame:
    at = C.linear_index([F.col("p_size"), F.col("p_partkey") % 9], [60, 9])
    back = C.index_places(F.col("linear"), [60, 9])
    return read(spark, d, "part").withColumn("linear", at).select("p_partkey", "linear", back[0].alias("a"), back[1].alias("b"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds FROM events")
def timestamp_round_trip(spark: Spark, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    text = C.format_timestamp(F.col("s"), zone="UTC")
    return e.select("event_id", text.alias("text"), C.parse_timestamp(text, zone="UTC").alias("seconds"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ .,\\n]'), lambda x: x <> '')) AS INTEGER) AS n FROM documents")
def string_tokens(spark: Spark, d: str) -> DataFrame:
    from ..sources.tables import tokens

    return read(spark, d, "documents").select("doc_id", F.size(tokens(F.col("text"), " .,\n")).alias("n"))


@query(f"WITH {CORPUS} SELECT item, count(*) AS terms, sum(weight) AS weight FROM corpus GROUP BY 1")
def corpus_terms(spark: Spark, d: str) -> DataFrame:
    return corpus(spark, d).groupBy("item").agg(F.count("*").alias("terms"), F.sum("weight").alias("weight"))
