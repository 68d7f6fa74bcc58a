"""Walks over weighted graphs, and closures and roll-ups over trees and DAGs, all as joins and grouped sums."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; where that is unset, in one of this machine, if the master is local."""
    import tempfile

    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="dyadic-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/dyadic/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: a written table in the shared folder."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote and that nothing reads any more; others stay."""
    for t in tables:
        if path := getattr(t, "_written", None):
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


# --- walks ---------------------------------------------------------------------------------------


def edge_weights(votes: DataFrame, b: list[float], fn: str = "raw", normalize: bool = True) -> DataFrame:
    """(from, to, value) of votes (voter, author, n_pos, n_neg, n_pos_rev, n_neg_rev).

    Three parameters: b0 + b1 pos - b2 neg. Seven: gains and losses are scaled by the reverse positive rate
    r = (b5 + pos_rev) / (b6 + pos_rev + neg_rev), as b1 pos r^b3 and b2 neg (1 - r)^b4.
    fn raw and log (of 1 + x) cut at 0 first; sigmoid doesn't. Edges of value 0 go.
    """
    pos, neg = F.col("n_pos"), F.col("n_neg")
    if len(b) == 3:
        value = b[0] + b[1] * pos - b[2] * neg
    elif len(b) == 7:
        rate = (b[5] + F.col("n_pos_rev")) / (b[6] + F.col("n_pos_rev") + F.col("n_neg_rev"))
        value = b[0] + b[1] * pos * F.pow(rate, F.lit(b[3])) - b[2] * neg * F.pow(1 - rate, F.lit(b[4]))
    else:
        raise ValueError("three or seven parameters")
    value = {"raw": lambda v: F.greatest(v, F.lit(0.0)), "log": lambda v: F.log1p(F.greatest(v, F.lit(0.0))), "sigmoid": lambda v: 1 / (1 + F.exp(-v))}[fn](value)
    edges = votes.select(F.col("voter").alias("from"), F.col("author").alias("to"), value.alias("value")).where("value <> 0")
    if not normalize:
        return edges
    total = edges.groupBy("from").agg(F.sum("value").alias("__t"))
    return edges.join(total, "from").select("from", "to", (F.col("value") / F.col("__t")).alias("value"))


def transition(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """One step of (node, ev): for each node, the sum over its in-edges of w ev value, plus its prior's share of what is left over.

    ranks has node, ev, prior and w; w counts as 0 for nodes without out-edges, whose mass teleports.
    """
    sources = edges.select(F.col("from").alias("node")).distinct().withColumn("__out", F.lit(1.0))
    now = ranks.join(sources, "node", "left").withColumn("w_used", F.when(F.col("__out").isNotNull(), F.col("w")).otherwise(0.0)).drop("__out")
    spread = now.agg(F.sum((1 - F.col("w_used")) * F.col("ev")).alias("__teleport"))
    gained = (
        edges.join(now.select(F.col("node").alias("from"), (F.col("w_used") * F.col("ev")).alias("__m")), "from")
        .groupBy(F.col("to").alias("node"))
        .agg(F.sum(F.col("value") * F.col("__m")).alias("__in"))
    )
    return (
        now.join(gained, "node", "left")
        .crossJoin(F.broadcast(spread))
        .select("node", (F.coalesce("__in", F.lit(0.0)) + F.col("prior") * F.col("__teleport")).alias("ev"), "prior", "w")
    )


def power_iteration(edges: DataFrame, nodes: DataFrame, max_iter: int = 500, eps: float = 1e-4, renormalize: bool = True, every: int = 5) -> tuple[DataFrame, dict]:
    """Ranks (node, ev, prior, w) after iterating to nodes x greatest change / total < eps, with eigenvalue and number of steps.

    The lineage is cut every few steps; a step costs a join of edges with ranks and a grouped sum.
    """
    edges = edges.select("from", "to", F.col("value").cast("double").alias("value")).repartition("from").cache()
    ranks = cut(nodes.select("node", F.col("init").cast("double").alias("ev"), F.col("prior").cast("double").alias("prior"), F.col("w").cast("double").alias("w")))
    size, start = ranks.agg(F.count("*"), F.sum("ev")).first()
    kept = ranks
    info = {"steps": 0, "eigenvalue": 1.0}
    for step in range(1, max_iter + 1):
        new = transition(edges, ranks)
        factor = 1.0
        new = cut(new) if step % every == 0 or renormalize else new
        written = new if hasattr(new, "_written") else None
        if renormalize:
            total = new.agg(F.sum("ev")).first()[0]
            factor = start / total if total else 1.0
            if abs(factor - 1) >= 1e-8:
                new = new.withColumn("ev", F.col("ev") * factor)
        old = ranks.select("node", F.col("ev").alias("__old"))
        change = new.join(old, "node").agg(F.max(F.abs(F.col("ev") - F.col("__old")))).first()[0] or 0.0
        ranks = new
        if written is not None:
            # Only the newest written table is read from here on.
            forget(kept)
            kept = written
        info = {"steps": step, "eigenvalue": 1 / factor if abs(factor - 1) >= 1e-8 else 1.0}
        if start and size * change / start < eps:
            break
    edges.unpersist()
    return ranks, info


def eigenvector(edges: DataFrame, nodes: DataFrame, eps: float = 1e-10) -> tuple[DataFrame, dict]:
    """The dominant eigenvector of the same operator: power iteration to a tight tolerance."""
    return power_iteration(edges, nodes, max_iter=2000, eps=eps)


def colours(edges: DataFrame, a: str = "from", b: str = "to", seed: int = 0) -> DataFrame:
    """(node, colour): neighbours have different colours, from 0 on. In each round the uncoloured nodes of the greatest priority among their uncoloured neighbours take the least colour
    that none of their neighbours has; priorities are hashes, so rounds grow slowly with the graph. A hub's neighbours meet as grouped sets of colours, not as rows.
    """
    links = edges.where(f"{a} <> {b}").select(F.col(a).alias("node"), F.col(b).alias("other"))
    links = cut(links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    everyone = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node"))).where("node is not null").distinct()
    # Many neighbours first: they find the most colours free.
    degree = links.groupBy("node").agg(F.count("*").alias("degree"))
    rank = F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.xxhash64(F.lit(seed), "node").alias("hash"), F.col("node").alias("id"))
    now = cut(everyone.join(degree, "node", "left").select("node", rank.alias("rank"), F.lit(None).cast("int").alias("colour")))
    while not now.where("colour is null").isEmpty():
        around = links.join(now.select(F.col("node").alias("other"), F.col("rank").alias("r"), F.col("colour").alias("c")), "other")
        seen = around.groupBy("node").agg(F.max(F.when(F.col("c").isNull(), F.col("r"))).alias("top"), F.collect_set("c").alias("taken"))
        seen = seen.withColumnRenamed("node", "__n")
        taken = F.coalesce("taken", F.expr("cast(array() as array<int>)"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(taken)), taken))
        wins = F.col("colour").isNull() & (F.col("top").isNull() | (F.col("rank") > F.col("top")))
        last, now = now, cut(now.join(seen, F.col("node") == F.col("__n"), "left").select("node", "rank", F.when(wins, free).otherwise(F.col("colour")).alias("colour")))
        forget(last)
    forget(links)
    return now.select("node", "colour")


# --- trees and DAGs ------------------------------------------------------------------------------


def closure(edges: DataFrame, node: str = "node_id", parent: str = "parent_id", include_self: bool = True) -> DataFrame:
    """(node, ancestor): ancestors of every node, itself included unless told otherwise. Paths double in each round until none is new, so rounds grow with the log of the depth."""
    step = edges.where(f"{parent} is not null").select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).distinct()
    reach = cut(step)
    n = reach.count()
    while True:
        further = reach.alias("a").join(reach.alias("b"), F.col("a.ancestor") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor"))
        last, reach = reach, cut(reach.unionByName(further).distinct())
        forget(last)
        if (m := reach.count()) == n:
            break
        n = m
    if not include_self:
        return reach
    nodes = step.select("node").unionByName(step.select(F.col("ancestor").alias("node"))).distinct()
    return reach.unionByName(nodes.select("node", F.col("node").alias("ancestor")))


def leaves(edges: DataFrame, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    parents = edges.select(F.col(parent).alias(node)).distinct()
    return edges.select(node).distinct().join(parents, node, "left_anti")


def levels(edges: DataFrame, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """(node, level): the length of the longest path from a root; one round for each level, in which nodes move below their parents."""
    step = cut(edges.where(f"{parent} is not null").select(F.col(node).alias("node"), F.col(parent).alias("parent")).distinct())
    now = step.select(F.col("parent").alias("node")).distinct().join(step.select("node").distinct(), "node", "left_anti").withColumn("level", F.lit(0))
    done = now
    for k in range(1, step.count() + 2):
        now = cut(step.join(now.select(F.col("node").alias("parent")), "parent", "left_semi").select("node").distinct().withColumn("level", F.lit(k)))
        if now.isEmpty():
            forget(now)
            return done.groupBy("node").agg(F.max("level").alias("level"))
        done = done.unionByName(now)
    raise ValueError("the graph has a cycle")


def rollup(obs: DataFrame, up: DataFrame, node: str = "p_node", keys: list[str] | None = None, measures: list[str] | None = None, trials: str = "n_trials") -> DataFrame:
    """Sums of leaf observations at every ancestor (and the leaf itself), for each other key; cells without trials go."""
    keys, measures = keys or ["t_node"], measures or ["n_pos", "n_trials"]
    wide = obs.join(up.select(F.col("node").alias(node), "ancestor"), node)
    out = wide.groupBy(F.col("ancestor").alias(node), *keys).agg(*(F.sum(m).alias(m) for m in measures))
    return out.where(F.col(trials) > 0) if trials in measures else out


def validate_tree(edges: DataFrame, node: str = "node_id", parent: str = "parent_id") -> None:
    """One root and one parent for each other node, or an error."""
    many = edges.where(f"{parent} is not null").groupBy(node).agg(F.count_distinct(parent).alias("k")).where("k > 1")
    if not many.isEmpty():
        raise ValueError("a node has several parents")
    children = edges.where(f"{parent} is not null").select(F.col(node).alias("n")).distinct()
    roots = edges.select(F.col(parent).alias("n")).where("n is not null").distinct().join(children, "n", "left_anti")
    if roots.count() != 1:
        raise ValueError("a tree has one root")

