"""Connected components of a graph of links, contracted round by round."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import cut, lookup


def _cut(df: DataFrame) -> DataFrame:
    """``cut`` as a frame that knows nothing of its plan: what a checkpointed frame remembers would grow from round to round."""
    spark, done = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that its links reach.

    Every round gives each node its smallest neighbour, or itself, as parent; follows parents to their roots by
    doubling; puts roots in the place of nodes; and drops edges that have become loops or repeats. In each part of two
    or more nodes at most half are roots, so rounds and doublings are both logarithmic. Each is written to the checkpoint
    folder. Edges and labels stay distributed; hot nodes are looked up skew-safely.
    """
    edges = _cut(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = _rooted(_cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))))
        table = roots.select(F.col("node").alias("a"), F.col("component").alias("root"))
        if labels is None:
            labels = roots
        else:
            step = lookup(labels.withColumnRenamed("component", "a"), table, ["a"], F.col("node"))
            labels = _cut(step.select("node", F.coalesce("root", "a").alias("component")))
        once = _cut(lookup(edges, table, ["a"], F.col("b")).select(F.col("root").alias("x"), F.col("b").alias("a")))
        moved = lookup(once, table, ["a"], F.col("x")).select("x", F.col("root").alias("y")).where(F.col("x") != F.col("y"))
        edges = _cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if edges.isEmpty():
            return labels


def _rooted(parents: DataFrame) -> DataFrame:
    """(node, component) with every parent replaced by its root; a parent is never larger than its node."""
    while True:
        own = parents.select(F.col("node").alias("a"), F.col("component").alias("up"))
        step = lookup(parents.withColumnRenamed("component", "a"), own, ["a"], F.col("node"))
        after = _cut(step.select("node", F.col("a").alias("component"), F.col("up").alias("next")))
        if after.where(F.col("next") != F.col("component")).isEmpty():
            return after.select("node", "component")
        parents = after.select("node", F.col("next").alias("component"))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of 0..n-1, taken in order, join two parts (union by smaller root, paths halved)."""
    root = list(range(n))
    keep = np.zeros(len(a), bool)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep[i] = True
    return keep
