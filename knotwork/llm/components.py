"""Connected components of a large edge list by alternating large and small stars.

Each round writes its edges to the shared folder, so lineage stays short; only
counts and sums of rounds reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Large star: larger neighbours move to the least of a node's neighbourhood; small star: the others do."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:  # from the larger end to the smaller
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    moved = both.join(least, "a")
    if small:
        out = moved.where(F.col("b") != F.col("m")).select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m"))
    else:
        out = moved.where(F.col("b") > F.col("a")).select("b", "m")
    return out.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge, root being the least node of its component. ``edges``: columns a, b."""
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        after = written(_star(_star(now, small=False), small=True), "edges")
        # settled once every node has one edge and no root has a parent
        roots = after.select(F.col("b").alias("a")).distinct()
        if after.join(roots, "a", "left_semi").isEmpty() and after.groupBy("a").count().where("count > 1").isEmpty():
            now = after
            break
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
