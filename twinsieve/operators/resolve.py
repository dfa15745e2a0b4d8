"""Edges to assignments: one canonical parent for every duplicate child."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.operators.edges import adjacency
from twinsieve.operators.graph import connected_components
from twinsieve.runtime import materialize

ASSIGNMENT = ["child_id", "parent_id", "jaccard_similarity", "size_difference", "size_difference_pct"]


def best_incident_edges(edges: DataFrame) -> DataFrame:
    """``node`` with the measures of its best real edge: highest similarity, then smallest pair."""
    best = F.min(
        F.struct(
            (-F.col("jaccard_similarity")).alias("j"), "child_id", "parent_id", "size_difference", "size_difference_pct"
        )
    )
    return adjacency(edges).groupBy("node").agg(best.alias("b")).select(
        "node",
        F.col("b.child_id").alias("child_id"),
        F.col("b.parent_id").alias("parent_id"),
        (-F.col("b.j")).alias("jaccard_similarity"),
        F.col("b.size_difference").alias("size_difference"),
        F.col("b.size_difference_pct").alias("size_difference_pct"),
    )


def resolve(edges: DataFrame, parents: DataFrame | None = None, new: DataFrame | None = None) -> DataFrame:
    """``child_id, parent_id`` and measures: every node of a component but its root.

    The root is the smallest (priority, id): 0 for nodes that are parents already (ids in ``parents``
    or with a self-edge), 1 for other nodes, 2 for ids in ``new``. Measures are those of the child's best
    edge, which need not touch the root. The direction of the edges plays no part.
    """
    links = edges.select("child_id", "parent_id")
    nodes = materialize(connected_components(links, "child_id", "parent_id"), "nodes")
    first = links.where("child_id = parent_id").select(F.col("child_id").alias("node"))
    if parents is not None:
        first = first.union(parents.select(F.col(parents.columns[0]).alias("node")))
    ranked = nodes.join(first.distinct().withColumn("is_first", F.lit(True)), "node", "left")
    fresh = F.lit(False)
    if new is not None:
        ids = new.select(F.col(new.columns[0]).alias("node")).distinct().withColumn("is_new", F.lit(True))
        ranked = ranked.join(ids, "node", "left")
        fresh = F.col("is_new").isNotNull()
    ranked = ranked.withColumn("priority", F.when(F.col("is_first").isNotNull(), 0).when(fresh, 2).otherwise(1))
    chosen = ranked.groupBy("root").agg(F.min(F.struct("priority", "node")).alias("m")).select(
        "root", F.col("m.node").alias("parent")
    )
    children = ranked.join(chosen, "root").where("node <> parent").select("node", "parent")
    best = best_incident_edges(edges).drop("child_id", "parent_id")
    return children.join(best, "node").select(
        F.col("node").alias("child_id"),
        F.col("parent").alias("parent_id"),
        "jaccard_similarity",
        "size_difference",
        "size_difference_pct",
    )


def parents_of(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    """``id``: nodes that are nobody's child in the assignments, among edges' nodes and self-edges."""
    nodes = edges.select(F.explode(F.array("child_id", "parent_id")).alias("id")).distinct()
    return nodes.join(assignments.select(F.col("child_id").alias("id")), "id", "left_anti")
