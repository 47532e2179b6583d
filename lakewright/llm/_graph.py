"""Connected components of an edge table, without collecting nodes or edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import Scratch


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) that join the same nodes as the edges (u, v)."""
    if not len(u):
        return u, v
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        np.minimum.at(label, np.maximum(la, lb)[open_], np.minimum(la, lb)[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _join_min(edges: DataFrame, mins: DataFrame, key: str) -> DataFrame:
    """edges with the minimum of their `key` node, if it has one. The derived second key makes both sides
    shuffle for the join alone, so that adaptive execution may split the rows of a hub over several tasks."""
    left = edges.withColumn("k", F.xxhash64(key))
    right = mins.withColumn("k", F.xxhash64(key))
    return left.join(right, [key, "k"], "left")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select(F.col("u").alias("v"), F.col("v").alias("y")).unionByName(edges.select("v", F.col("u").alias("y")))
    mins = both.groupBy("v").agg(F.min("y").alias("m")).filter("m < v")
    out = _join_min(edges, mins, "v").select("u", F.coalesce("m", "v").alias("v"))
    return out.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the smallest."""
    mins = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _join_min(edges, mins, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(mins.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of the edges (u, v: two longs); component is the smallest node reachable.

    Alternates large-star and small-star rounds until the edge set stays the same;
    the rounds grow with the logarithm of the longest path. Self loops and
    repeated edges are harmless; an edge with a null end links nothing.
    """
    edges = edges.filter("u IS NOT NULL AND v IS NOT NULL")
    nodes = edges.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    edges = scratch.table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
        stars = scratch.table(_small_star(_large_star(edges)))
        scratch.drop(edges)
        edges = stars
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return found.unionByName(roots).unionByName(nodes).groupBy("node").agg(F.min("component").alias("component"))
