"""From candidate pairs to raw edges, and the edge table's upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.config import DedupeConfig
from twinsieve.functions.minhash import signature_jaccard
from twinsieve.functions.text import size_difference_pct
from twinsieve.operators.lsh import candidate_pairs
from twinsieve.runtime import materialize

EDGE = ["child_id", "parent_id", "jaccard_similarity", "size_difference", "size_difference_pct"]


def orient(pairs: DataFrame) -> DataFrame:
    """Edges of ``p, c, len_p, len_c, jaccard_similarity``: the larger is the child, on a tie ``p``."""
    p_child = F.col("len_p") >= F.col("len_c")
    return pairs.select(
        "p",
        F.when(p_child, F.col("p")).otherwise(F.col("c")).alias("child_id"),
        F.when(p_child, F.col("c")).otherwise(F.col("p")).alias("parent_id"),
        "jaccard_similarity",
        F.abs(F.col("len_p") - F.col("len_c")).cast("int").alias("size_difference"),
        size_difference_pct(F.col("len_p"), F.col("len_c")).alias("size_difference_pct"),
    )


def score(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Adds the signature similarity and sizes to ``p, c`` pairs."""
    left = signed.select(F.col("id").alias("p"), F.col("sig").alias("sig_p"), F.col("content_len").alias("len_p"))
    right = signed.select(F.col("id").alias("c"), F.col("sig").alias("sig_c"), F.col("content_len").alias("len_c"))
    joined = pairs.join(left, "p").join(right, "c")
    return joined.select("p", "c", "len_p", "len_c", signature_jaccard(F.col("sig_p"), F.col("sig_c")).alias("jaccard_similarity"))


def top_matches(edges: DataFrame, most: int, owner: str = "p") -> DataFrame:
    """The ``most`` best edges of each owner: similarity, then child, then parent."""
    order = Window.partitionBy(owner).orderBy(F.col("jaccard_similarity").desc(), "child_id", "parent_id")
    return edges.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")


def raw_edges(
    signed: DataFrame, config: DedupeConfig = DedupeConfig(), batch: DataFrame | None = None, linked: DataFrame | None = None,
    known: DataFrame | None = None, pairs: DataFrame | None = None,
) -> DataFrame:
    """Edges above the threshold with sizes close enough, and their owner ``p``; none inside a cluster of ``linked``.
    ``pairs`` are the candidates where they are there already."""
    if pairs is None:
        pairs = candidate_pairs(signed, batch, config.size_diff, linked, known, config)
    edges = orient(score(pairs, signed).where(F.col("jaccard_similarity") >= config.threshold))
    return top_matches(edges, config.max_matches_per_doc) if config.max_matches_per_doc else edges


def resolving_edges(signed: DataFrame, config: DedupeConfig = DedupeConfig()) -> DataFrame:
    """Some of the edges of :func:`raw_edges`, linear in the copies, that resolve to the same assignments.

    Documents of one signature and size are one class, of which the smallest id is matched. An edge within a class
    goes from that id to each other one; one between two classes from the smallest of each to all of the other. All
    edges of the class or pair of classes have the same measures, so each document keeps its first best edge.
    Only the ``max_matches_per_doc`` of a configuration needs all edges, and gets them.
    """
    if config.max_matches_per_doc:
        return raw_edges(signed, config).select(*EDGE)
    shape = [F.col("content_len"), F.xxhash64("sig").alias("h1"), F.hash("sig").alias("h2")]
    classes = signed.groupBy(*shape).agg(F.min_by(F.struct("id", "sig"), "id").alias("first"))
    classes = materialize(classes.select(F.col("first.id").alias("id"), F.col("first.sig").alias("sig"), "content_len", "h1", "h2"), "classes")
    others = signed.select("id", *shape).join(
        classes.select(F.col("id").alias("first"), F.col("sig"), "content_len", "h1", "h2"), ["content_len", "h1", "h2"]
    ).where("id <> first").select("id", "first", "content_len")
    others = materialize(others, "copies")
    edge = lambda p, c: (F.col(p).alias("p"), F.col(c).alias("c"))
    size = lambda a, b: (F.col(a).alias("len_p"), F.col(b).alias("len_c"), "jaccard_similarity")
    within = others.select(*edge("first", "id"), *size("content_len", "content_len")[:2], F.lit(1.0).alias("jaccard_similarity"))
    pairs = candidate_pairs(classes.select("id", "sig", "content_len"), size_diff=config.size_diff, config=config)
    scored = materialize(score(pairs, classes).where(F.col("jaccard_similarity") >= config.threshold), "scored")
    copies = others.select("id", "first")
    left = scored.join(copies, F.col("p") == F.col("first")).select(*edge("id", "c"), *size("len_p", "len_c"))
    right = scored.join(copies, F.col("c") == F.col("first")).select(*edge("p", "id"), *size("len_p", "len_c"))
    # on a tie of sizes the owner is the child, and of two ids the smaller one owns the pair
    rows = scored.unionByName(within).unionByName(left).unionByName(right)
    turned = F.col("p") > F.col("c")
    ordered = rows.select(
        F.least("p", "c").alias("p"), F.greatest("p", "c").alias("c"), F.when(turned, F.col("len_c")).otherwise(F.col("len_p")).alias("len_p"),
        F.when(turned, F.col("len_p")).otherwise(F.col("len_c")).alias("len_c"), "jaccard_similarity",
    )
    return orient(ordered).select(*EDGE)


def upsert_edges(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """One row per (child, parent) with the highest similarity; on a tie the older row stays, and of rows
    of one age that with the smaller size difference."""
    rows = new.select(*EDGE, F.lit(1).alias("_age"))
    if old is not None:
        rows = old.select(*EDGE, F.lit(0).alias("_age")).unionByName(rows)
    best = F.max_by(F.struct(*EDGE[2:]), F.struct("jaccard_similarity", -F.col("_age"), -F.col("size_difference"), -F.col("size_difference_pct")))
    return rows.groupBy("child_id", "parent_id").agg(best.alias("best")).select("child_id", "parent_id", "best.*")


def clean_edges(dupes: DataFrame) -> DataFrame:
    """Edges with both ends, ids in lower case without blanks around, null measures as 0."""
    side = lambda c: F.lower(F.trim(c))
    rows = dupes.select(
        side("child_id").alias("child_id"),
        side("parent_id").alias("parent_id"),
        F.coalesce("jaccard_similarity", F.lit(0.0)).alias("jaccard_similarity"),
        F.coalesce("size_difference", F.lit(0)).alias("size_difference"),
        F.coalesce("size_difference_pct", F.lit(0.0)).alias("size_difference_pct"),
    )
    return rows.where("child_id <> '' and parent_id <> ''")


def edge_of_child(edges: DataFrame) -> DataFrame:
    """The best real edge of each child."""
    real = edges.where("child_id <> parent_id")
    best = F.min(F.struct((-F.col("jaccard_similarity")).alias("j"), "parent_id", "size_difference", "size_difference_pct"))
    return real.groupBy("child_id").agg(best.alias("b")).select(
        "child_id", "b.parent_id", (-F.col("b.j")).alias("jaccard_similarity"), "b.size_difference", "b.size_difference_pct"
    )
