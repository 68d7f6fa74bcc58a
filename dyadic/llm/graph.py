"""Connected components by contraction: in each round every vertex joins the least of itself and its neighbours, and edges move to those.

Vertices should be hashes: the least neighbour is then a random one, and rounds grow with the logarithm of the number of
vertices, whatever the shape. A round is a grouped minimum and two joins; the graph shrinks from round to
round. Both sides of a join are written tables, so that the join may split the neighbours of a large hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, list[str]]:
    """(v, root): the least vertex of each component, for every vertex of an edge that isn't this one itself; and the tables that the result reads.

    Null ends and loops are left out. Without edges the result is empty.
    """
    spark = edges.sparkSession
    now, path = written(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges")
    found, paths = now.select("v", F.col("u").alias("root")).limit(0), [path]
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("to")), "least")
        moved = now.join(least.withColumnRenamed("to", "a"), "u").join(least.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        next_edges, next_path = written(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        # Those that stand for others so far are vertices of the round, or in no edge any more.
        stepped = found.join(least.select(F.col("u").alias("root"), "to"), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
        found = stepped.unionByName(least.where("u <> to").select(F.col("u").alias("v"), F.col("to").alias("root")))
        remove(spark, *paths[:1])
        now, paths = next_edges, [next_path, *paths[1:], least_path]
    if len(paths) > 1:
        # A vertex that others had joined may have joined a further one, and did so again in the next round.
        found, path = written(found.distinct(), "roots")
        remove(spark, *paths)
        paths = [path]
    return found, paths
