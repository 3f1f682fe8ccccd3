"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from callharmony.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``node, label``: nodes have one label exactly if edges lead from one to the other.

    Every round points each node at its smallest neighbour, or itself, and contracts the edges; what is left
    shrinks by a constant part where node numbers are unrelated to the edges. A label is a node of its
    component. Nodes without edges have no row.
    """
    edges = written(edges.where("a != b").select("a", "b"), "edges")
    steps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("parent")), "parents")
        steps.append(parents)
        left, right = (parents.select(F.col("a").alias(side), F.col("parent").alias(f"{side}_to")) for side in ("a", "b"))
        moved = edges.join(left, "a").join(right, "b").where("a_to != b_to")
        edges = written(moved.select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = steps[0].select(F.col("a").alias("node"), F.col("parent").alias("label"))
    for parents in steps[1:]:
        labels = labels.join(parents, F.col("label") == parents.a, "left").select("node", F.coalesce("parent", "label").alias("label"))
    return written(labels, "components")
