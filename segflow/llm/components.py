"""Connected components of a link table by alternating star contraction in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.staging import discard, stage


def _directed(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v, distinct, no loops."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()


def _hang(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each neighbour v of u hangs on u's least neighbour m: links (v, m). A plain join, so that a hub's rows can be split."""
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node that occurs in ``links``.

    ``links`` has long columns u and v; direction, repeats and loops (nodes linked with
    themselves only are left out) do not matter; rows with a null end are ignored. Large-star
    and small-star steps alternate until the links are stars around component minima, in
    O(log^2) rounds; each round is staged in the shared folder and replaces the one before. Only a count of changes
    reaches the driver.
    """
    spark = links.sparkSession
    edges = stage(_directed(links.filter("u is not null and v is not null")), "links")
    for _ in range(max_rounds):
        # large star: every larger neighbour of u hangs on the least of u and its neighbours
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stage(_hang(both.filter("v > u"), least).distinct().filter("u > v"), "large")
        # small star: u and its smaller neighbours hang on the least of them
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = _hang(large, low).unionByName(low.select("u", F.col("m").alias("v")))
        new = stage(small.filter("u > v").distinct(), "small")
        discard(edges, least, large, low)
        more = new.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
        # stars around minima: no node hangs on two others, and no centre hangs on a third
        if not more and not new.select(F.col("v").alias("c")).distinct().join(new.select("u"), F.col("c") == F.col("u"), "left_semi").limit(1).count():
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        edges = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def block_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index connected to each of n nodes by the links (a[i], b[i])."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == root).all():
            return root
        root = new
