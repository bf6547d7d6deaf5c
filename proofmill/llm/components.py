"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large-star: a node's larger neighbours go to its smallest neighbour (or itself). Small-star: its smaller neighbours and itself do.

    The least neighbour comes from an aggregate, whose counts are combined before the shuffle, and is a table of its
    own: so the join that brings it back has a plain exchange on either side, and adaptive execution splits the
    neighbours of a node with very many of them over tasks.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        out = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = durable(down.groupBy("u").agg(F.min("v").alias("m")))
        out = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.filter("a <> b").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node is either the centre of its edges or hangs on one centre: then the components are named."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("centre"), F.lit(0).alias("leaf")).unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("centre"), F.lit(1).alias("leaf")))
    return ends.groupBy("u").agg(F.max("centre").alias("centre"), F.sum("leaf").alias("leaf")).filter("leaf > 1 or leaf > 0 and centre > 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) from undirected edges (a, b) of any ordered type; a component is named by its least node.

    Repeated edges, edges in both directions and loops are fine; an edge with a null counts as none.
    """
    edges = durable(edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not _all_stars(edges):
        edges = durable(_stars(_stars(edges, large=True), large=False))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def merge_components(label: DataFrame, edges: DataFrame) -> DataFrame:
    """``label`` (node, component) after more edges (a, b); nodes that it lacks are components of their own.

    The stars run over components alone, which are far fewer than nodes.
    """
    named = lambda df, c: df.join(label.select(F.col("node").alias(c), F.col("component").alias("_c")), c, "left").withColumn(c, F.coalesce("_c", c)).drop("_c")
    merged = connected_components(named(named(edges, "a"), "b"))
    moved = label.join(merged.select(F.col("node").alias("component"), F.col("component").alias("_c")), "component", "left").select("node", F.coalesce("_c", "component").alias("component"))
    return moved.unionByName(merged.join(label, "node", "left_anti"))
