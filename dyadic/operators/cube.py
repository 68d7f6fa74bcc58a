"""Hierarchical cubes: dimensions as trees, cells as sparse rows, measures as algebraic aggregates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import closure, validate_tree

#: Measures that a cube may compute: name -> aggregate over the base rows' columns. Extended by `register`.
MEASURES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg, "var": F.var_samp}


def register(name: str, aggregate: Callable[[Column], Column]) -> None:
    MEASURES[name] = aggregate


def dimension(tree: DataFrame, node: str = "node_id", parent: str = "parent_id", leaves_at_zero: bool = True) -> DataFrame:
    """(node, ancestor, level): ancestors-or-self with the ancestor's level, the leaves at level 0 (or the root)."""
    validate_tree(tree, node, parent)
    up = closure(tree, node, parent)
    # In a tree, a node's level is the number of its ancestors.
    depth = up.groupBy("node").agg((F.count("*") - 1).cast("int").alias("level"))
    inner = tree.select(F.col(parent).alias("node")).where("node is not null").distinct().withColumn("inner", F.lit(True))
    top = depth.agg(F.max("level").alias("top"))
    depth = depth.join(inner, "node", "left").crossJoin(F.broadcast(top))
    level = F.when(F.col("inner").isNull(), 0).otherwise(F.col("top") - F.col("level")) if leaves_at_zero else F.col("level")
    return up.join(depth.select(F.col("node").alias("ancestor"), level.alias("level")), "ancestor").select("node", "ancestor", "level")


def level_lattice(depths: list[int]) -> list[tuple[int, ...]]:
    """Level vectors from the base to the top, by the sum of levels."""
    return sorted(product(*(range(d + 1) for d in depths)), key=lambda v: (sum(v), v))


def hierarchical_cube(base: DataFrame, dims: dict[str, DataFrame], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """Every cell over the product of hierarchies that has data.

    dims: base column -> dimension(node, ancestor, ...); measures: out -> (measure, column). Base
    rows are pre-aggregated where every measure can be merged, then each is sent to its cells.
    """
    keys = list(dims)
    if all(m in ("sum", "count", "min", "max") for m, _ in measures.values()):
        base = base.groupBy(*keys).agg(*(MEASURES[m](F.col(c)).alias(out) for out, (m, c) in measures.items()))
        final = [{"count": F.sum}.get(m, MEASURES[m])(F.col(out)).alias(out) for out, (m, _) in measures.items()]
    else:
        final = [MEASURES[m](F.col(c)).alias(out) for out, (m, c) in measures.items()]
    wide = reduce(lambda df, k: df.join(dims[k].select(F.col("node").alias(k), F.col("ancestor").alias(f"__{k}")), k), keys, base)
    return wide.groupBy(*(F.col(f"__{k}").alias(k) for k in keys)).agg(*final)


def cube_dag(trees: list[DataFrame], node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """Edges (cell, parent_cell) of the product of trees, cells being arrays of nodes: one step up in one dimension.

    The product is the result itself, so it is as large as the cube of the trees' nodes, not of the data.
    """
    nodes = [t.select(F.col(node).alias("n")).unionByName(t.select(F.col(parent).alias("n"))).where("n is not null").distinct() for t in trees]
    cells = reduce(lambda a, b: a.crossJoin(b), [d.withColumnRenamed("n", f"n{k}") for k, d in enumerate(nodes)])
    out = None
    for k, t in enumerate(trees):
        up = t.where(f"{parent} is not null").select(F.col(node).alias(f"n{k}"), F.col(parent).alias("up"))
        own = cells.join(up, f"n{k}").select(
            F.array(*(F.col(f"n{i}") for i in range(len(trees)))).alias("cell"),
            F.array(*(F.col("up") if i == k else F.col(f"n{i}") for i in range(len(trees)))).alias("parent_cell"),
        )
        out = own if out is None else out.unionByName(own)
    return out


def frontier(cells: DataFrame, pop: DataFrame, tre: DataFrame, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """Cells (p_node, t_node, status > 0) that are leaf by leaf, or have a child cell of low support in either DAG. A cell that isn't there has low support."""
    pairs = lambda d, a: d.where(f"{parent} is not null").select(F.col(parent).alias(a), F.col(node).alias("__child")).distinct()
    good = cells.where("status > 0").select("p_node", "t_node")
    down_p = good.join(pairs(pop, "p_node"), "p_node").select("p_node", "t_node", F.col("__child").alias("cp"), F.col("t_node").alias("ct"))
    down_t = good.join(pairs(tre, "t_node"), "t_node").select("p_node", "t_node", F.col("p_node").alias("cp"), F.col("__child").alias("ct"))
    ok = good.select(F.col("p_node").alias("cp"), F.col("t_node").alias("ct"), F.lit(1).alias("ok"))
    below = down_p.unionByName(down_t).join(ok, ["cp", "ct"], "left").groupBy("p_node", "t_node").agg(F.max(F.when(F.col("ok").isNull(), 1).otherwise(0)).alias("open"))
    return good.join(below, ["p_node", "t_node"], "left").where("open is null or open = 1").select("p_node", "t_node")
