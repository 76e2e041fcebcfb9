"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesage.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long): the smallest node that links lead to.

    Each round maps every node to its smallest neighbour, if that is smaller, and replaces the ends of the edges by it;
    edges within one node go. Every component with an edge loses nodes in each round and keeps its smallest one, so
    stars and small groups take one or two rounds. A node with very many edges is pre-aggregated where they are, and its
    side of the joins may be split. Null ends and loops are ignored; without edges the result is empty.
    """
    edges = materialize(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "node"), "moved")
        if found is None:
            found = moved.select("node", F.col("to").alias("component"))
        else:
            step = moved.select(F.col("node").alias("component"), "to")
            found = materialize(found.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")
        first, second = moved.select(F.col("node").alias("a"), F.col("to").alias("x")), moved.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = materialize(
            edges.join(first, "a").join(second, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges"
        )
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
