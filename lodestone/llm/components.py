"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of the undirected edges (a, b); a
    component is named by its smallest vertex.

    Each round hooks every vertex to its smallest smaller neighbour, follows the
    hooks to their roots and contracts the graph to these. Edges shrink from
    round to round; no row of any step is more than two ids, and no step gathers
    a vertex's neighbours. Every step is written to the shared folder.
    """
    left = stored(edges.select(*_ordered(F.col("a"), F.col("b"))).filter("a < b").distinct(), "edges")
    labels = stored(left.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")), "labels")
    while not left.isEmpty():
        hooks = stored(left.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("to")), "hooks")
        while True:
            on = hooks.select(F.col("v").alias("x"), F.col("to").alias("further"))
            if hooks.join(on, F.col("to") == F.col("x"), "left_semi").isEmpty():
                break
            for _ in range(2):
                on = hooks.select(F.col("v").alias("x"), F.col("to").alias("further"))
                hooks = hooks.join(on, F.col("to") == F.col("x"), "left").select("v", F.coalesce("further", "to").alias("to"))
            hooks = stored(hooks, "hooks")
        labels = stored(labels.join(hooks, F.col("component") == F.col("v"), "left").select("id", F.coalesce("to", "component").alias("component")), "labels")
        one = hooks.select(F.col("v").alias("va"), F.col("to").alias("ra"))
        two = hooks.select(F.col("v").alias("vb"), F.col("to").alias("rb"))
        moved = left.join(one, F.col("a") == F.col("va"), "left").join(two, F.col("b") == F.col("vb"), "left")
        moved = moved.select(*_ordered(F.coalesce("ra", "a"), F.coalesce("rb", "b")))
        left = stored(moved.filter("a < b").distinct(), "edges")
    return labels
