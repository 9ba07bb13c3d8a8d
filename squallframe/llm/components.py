"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squallframe.llm.common import materialize

MAX_ROUNDS = 60


def both_ways(links: DataFrame, a: str, b: str) -> DataFrame:
    """(__x, __y): each link from both its ends, made in one pass over the links."""
    ends = [F.struct(F.col(x).alias("__x"), F.col(y).alias("__y")) for x, y in ((a, b), (b, a))]
    return links.where(F.col(a) != F.col(b)).select(F.inline(F.array(*ends)))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of all nodes that have links; a component is named by its smallest node.

    Each round gives a node the smallest label among its neighbours' and its own, then that label's own label, so
    long chains shrink by jumps. The lineage is cut in every round; it ends when no label changes.
    """
    both = both_ways(links, a, b).distinct()
    both = materialize(both)
    labels = materialize(both.groupBy(F.col("__x").alias("node")).agg(F.least(F.min("__x"), F.min("__y")).alias("component")))
    for _ in range(MAX_ROUNDS):
        near = both.join(labels, F.col("__y") == F.col("node")).groupBy("__x").agg(F.min("component").alias("__near"))
        moved = labels.join(near, F.col("node") == F.col("__x")).select("node", F.col("component").alias("__old"), F.least("component", "__near").alias("component"))
        jump = labels.select(F.col("node").alias("__n"), F.col("component").alias("__jump"))
        moved = moved.join(jump, F.col("component") == F.col("__n"), "left").select("node", "__old", F.least("component", F.coalesce("__jump", "component")).alias("component"))
        moved = materialize(moved)
        changed = not moved.where("__old <> component").isEmpty()
        labels = moved.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {MAX_ROUNDS} rounds")


def near_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) as far as one step shows: a node takes the smallest of its own and its neighbours' names, then
    what that one has taken. Nodes of one name are linked; linked nodes may still have several names.
    """
    both = both_ways(links, a, b)
    labels = both.groupBy(F.col("__x").alias("node")).agg(F.least(F.min("__x"), F.min("__y")).alias("component"))
    jump = labels.select(F.col("node").alias("__n"), F.col("component").alias("__jump"))
    return materialize(labels.join(jump, F.col("component") == F.col("__n")).select("node", F.col("__jump").alias("component")))
