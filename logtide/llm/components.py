"""Connected components by alternating large-star and small-star steps, all as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _minima(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _unsettled(pairs: DataFrame) -> tuple[int, int]:
    """(pairs, nodes that keep them from being stars around least nodes): the two numbers that a round collects."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"))))
    nodes = pairs.select(ends.alias("e")).groupBy("e.x").agg(F.sum("e.up").alias("ups"), F.count("*").alias("k"))
    bad = (F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("ups") < F.col("k")))
    row = nodes.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.count_if(bad)).first()
    return row[0], row[1]


def components(edges: DataFrame, pairs_per_task: int = 100_000) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); the component is the least node that can be reached.

    Both steps reattach nodes to the least neighbour of a neighbour, which keeps the components and halves
    distances, so that rounds grow with the logarithm of the diameter.  Steps are pre-aggregated minima and a join.
    Rounds end when every node hangs on one least node, and small graphs are written by few tasks.
    """
    current = stage(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    pairs, unsettled = _unsettled(current)
    while unsettled:
        tasks = 1 + pairs // pairs_per_task
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minima(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u != v").distinct().coalesce(tasks), "large-star")
        small = large.join(_minima(large), "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        current = stage(small.filter("u != v").distinct().coalesce(tasks), "small-star")
        pairs, unsettled = _unsettled(current)
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def join_components(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found`` (node, component) after the edges ``more`` (a, b) between components are added."""
    comp = lambda who: found.select(F.col("node").alias(who), F.col("component").alias(f"{who}c"))
    between = more.join(comp("a"), "a", "left").join(comp("b"), "b", "left").select("a", "b", F.coalesce("ac", "a").alias("ac"), F.coalesce("bc", "b").alias("bc"))
    between = stage(between, "between")
    if between.isEmpty():
        return found
    roots = components(between.select(F.col("ac").alias("a"), F.col("bc").alias("b")))
    named = found.unionByName(roots.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
    return named.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
