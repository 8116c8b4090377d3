"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import materialize


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to a node's smallest neighbour: those above the node, or those not above it."""
    if large:
        pairs = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = pairs.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    Each step at least halves long chains; the edge table is written after every round, so lineage
    stays short and a lost executor costs one round at most.
    """
    larger, smaller = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    pairs = materialize(edges.filter(F.col(a) != F.col(b)).select(larger, smaller).distinct(), "edges")
    mark = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        pairs = materialize(_star(_star(pairs, True), False), "edges")
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return nodes.union(roots).distinct()


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each item's connected set."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root
