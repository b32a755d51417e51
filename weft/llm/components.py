"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.scratch import Scratch


def components(edges: DataFrame, a: str, b: str, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node that it reaches.

    Contraction: each node points at its smallest neighbour, pointers are doubled, and the edges between different
    pointers form the next, smaller graph. The node count at least halves in a round. Tables are written between
    rounds; only their row counts come to the driver. A node with very many edges is pre-aggregated before its
    shuffle, and the joins are plain equi-joins of written tables, which adaptive execution splits.
    Edges with a null end, loops and repeated edges have no effect.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    edges = scratch.keep(edges, f"{name}-e0")
    label = None
    k = 0
    while not edges.isEmpty():
        near = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        near = scratch.keep(near.select("node", F.least("node", "to").alias("to")), f"{name}-n{k}")
        far = near.select(F.col("node").alias("to"), F.col("to").alias("far"))
        point = scratch.keep(near.join(far, "to").select("node", F.col("far").alias("to")), f"{name}-p{k}")
        ends = [point.select(F.col("node").alias(x), F.col("to").alias(f"{x}2")) for x in "ab"]
        left = edges.join(ends[0], "a").join(ends[1], "b").where("a2 <> b2")
        left = left.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        if label is None:
            label = point.select("node", F.col("to").alias("component"))
        else:
            step = point.select(F.col("node").alias("component"), "to")
            label = label.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        label = scratch.keep(label, f"{name}-l{k}")
        edges = scratch.keep(left, f"{name}-e{k + 1}")
        for old in ("e", "n", "p"):  # written again above as labels and edges
            scratch.drop(f"{name}-{old}{k}")
        if k:
            scratch.drop(f"{name}-l{k - 1}")
        k += 1
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
