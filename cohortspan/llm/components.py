"""Connected components of a graph that lies spread over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node on an edge.

    ``edges`` has two long columns ``a`` and ``b``. Rounds of the large-star and
    small-star steps turn every component into a star around its smallest node.
    Each round's edges are written to shared storage, which cuts the lineage;
    the driver only sees their number and a checksum. No edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    current = stage(
        edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(a, b))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        current = stage(_small_star(_large_star(current)), "edges")
    roots = current.select(b.alias("node"), b.alias("root")).distinct()
    return current.select(a.alias("node"), b.alias("root")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest node around it."""
    a, b = F.col("a"), F.col("b")
    both = edges.select(a.alias("u"), b.alias("v")).unionByName(edges.select(b.alias("u"), a.alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def star(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among ``n`` items as links to the first item of each component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]
