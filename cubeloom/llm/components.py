"""Connected components of an edge table, by repeated hooking to the least neighbour and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); the root is the component's least node.

    Each round joins only by node, aggregates before it shuffles, and writes
    its table to the shared folder, so nothing grows with a component's size.
    Components that are not complete after ``rounds`` rounds are an error.
    """
    both = edges.select("a", "b").where("a <> b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    labels = materialize(least.select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    for _ in range(rounds):
        # every edge tells both ends' roots the lesser root
        at_a = both.join(labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        at_b = at_a.join(labels.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        hooks = materialize(at_b.where("rb < ra").groupBy(F.col("ra").alias("old")).agg(F.min("rb").alias("new")))
        if hooks.isEmpty():
            discard(both, hooks)
            return labels
        # shortcut chains of hooks until they are flat
        while True:
            onward = hooks.select(F.col("old").alias("new"), F.col("new").alias("next"))
            further = materialize(hooks.join(onward, "new", "left").select("old", F.coalesce("next", "new").alias("new"), F.col("next").isNotNull().alias("moved")))
            discard(hooks)
            hooks = further
            if further.where("moved").isEmpty():
                break
        moved = labels.join(hooks.select(F.col("old").alias("root"), "new"), "root", "left")
        new = materialize(moved.select("node", F.coalesce("new", "root").alias("root")))
        discard(labels, hooks)
        labels = new
    raise RuntimeError(f"components are not complete after {rounds} rounds")
