"""Views over the driver's tables that the registered queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of parts by customers, in contexts."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("src_id"), F.col("l_partkey").alias("dst_id"), F.col("l_returnflag").alias("src_context"), F.col("o_orderpriority").alias("dst_context"),
        F.col("l_linestatus").alias("ctx_id"), F.col("l_quantity").alias("y"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
    )


OBS = """obs AS (SELECT o_custkey AS src_id, l_partkey AS dst_id, l_returnflag AS src_context, o_orderpriority AS dst_context,
 l_linestatus AS ctx_id, l_quantity AS y, l_orderkey * 8 + l_linenumber AS row_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def binom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines of all, by the customer's nation and the part's type and brand."""
    li, o, c, p = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(p, li.l_partkey == p.p_partkey)
    return rows.groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("p_node"), F.concat_ws("/", "p_type", "p_brand").alias("t_node")).agg(
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_pos"), F.count("*").alias("n_trials")
    )


BINOM = """binom AS (SELECT 'n' || c_nationkey AS p_node, p_type || '/' || p_brand AS t_node,
 CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_pos, count(*) AS n_trials
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def pop_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, regions, nations."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit("root").alias("parent_id")).unionByName(
        n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"))
    )


POP = """pop AS (SELECT 'r' || r_regionkey AS node_id, 'root' AS parent_id FROM region
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def tre_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, part types, pairs of type and brand."""
    p = read(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    return p.select(F.col("p_type").alias("node_id"), F.lit("all").alias("parent_id")).distinct().unionByName(p.select(F.concat_ws("/", "p_type", "p_brand").alias("node_id"), F.col("p_type").alias("parent_id")))


TRE = """tre AS (SELECT DISTINCT p_type AS node_id, 'all' AS parent_id FROM part
 UNION ALL SELECT DISTINCT p_type || '/' || p_brand, p_type FROM part)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade from suppliers' nations to customers' nations, with votes for and against."""
    li, o, c, s = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return rows.groupBy(F.col("s_nationkey").alias("voter"), F.col("c_nationkey").alias("author")).agg(
        F.sum(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).alias("n_pos"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_neg"), F.count("*").alias("value")
    )


EDGES = """votes AS (SELECT s_nationkey AS voter, c_nationkey AS author, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
 CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_neg, count(*) AS value
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.topics import corpus_of

    return corpus_of(read(spark, sf_dir, "documents"))


CORPUS = """corpus AS (SELECT item, term, CAST(count(*) AS DOUBLE) AS weight FROM (
 SELECT doc_id AS item, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents) WHERE term <> '' GROUP BY 1, 2)"""
