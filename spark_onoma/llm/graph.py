"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_onoma.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node in ``links(a, b)``; the component is its smallest node.

    Minima are taken with map-side aggregation and meet their edges again in a join that the adaptive planner can
    split, so a hub needs no task of its own. Rows with a null end and loops are ignored; no row gives no row.
    """
    edges = scratch.save(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = _digest(edges)
    while was[0]:
        fresh = scratch.save(_small_star(_large_star(edges)))
        scratch.drop(edges)
        edges, now = fresh, _digest(fresh)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def local_roots(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest member of each of n places' component, within one task."""
    root = np.arange(n)
    while True:
        old = root.copy()
        for a, b in links:
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
        root = root[root]
        if (root == old).all():
            return root
