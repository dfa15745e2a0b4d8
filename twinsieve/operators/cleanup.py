"""Pathological clusters: sets of documents that share large buckets in nearly all bands."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.config import DedupeConfig
from twinsieve.operators.lsh import bands, large_buckets
from twinsieve.runtime import materialize

OVERLAP, SIMILAR, SCORE = 0.9, 0.9, 0.99


class CleanupAction(Enum):
    REPORT = "report"
    MARK_PARENT = "mark-parent"
    DELETE = "delete"

    @classmethod
    def parse(cls, text: str) -> "CleanupAction":
        names = {
            "report": cls.REPORT, "dry-run": cls.REPORT, "mark-parent": cls.MARK_PARENT, "mark": cls.MARK_PARENT,
            "delete": cls.DELETE, "remove": cls.DELETE,
        }
        try:
            return names[text.strip().lower().replace("_", "-")]
        except KeyError:
            raise ValueError(f"unknown cleanup action {text!r}") from None


def first_apart(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``start`` of the nodes (``start, n``) that a pass from the largest to the smallest, then by name, keeps
    when it leaves out those linked (``x, nx, y, ny``, both ways) to one kept before.

    In rounds: an open node is kept when no open node before it is linked to it, and those linked to it fall.
    """
    first = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    links = materialize(links.where(first).select("x", "y"), "links")  # x comes before y
    done = nodes.select("start").join(links.select(F.col("y").alias("start")).distinct(), "start", "left_anti")
    done = last = materialize(done, "kept")
    while not links.isEmpty():
        fallen = links.join(last.select(F.col("start").alias("x")), "x", "left_semi").select(F.col("y").alias("start")).distinct()
        fallen = materialize(fallen, "fallen")
        ended = materialize(last.union(fallen), "ended")
        open_ends = links.select(F.col("y").alias("start")).distinct()
        for end in ("x", "y"):
            links = links.join(ended.select(F.col("start").alias(end)), end, "left_anti")
        links = materialize(links.select("x", "y"), "links")
        # open, not fallen, and nothing open before it any more
        last = open_ends.join(fallen, "start", "left_anti").join(done, "start", "left_anti")
        last = materialize(last.join(links.select(F.col("y").alias("start")).distinct(), "start", "left_anti"), "last")
        done = done.union(last)
    return done


def pathological_clusters(
    signed: DataFrame, min_bucket: int = 1000, min_bands: int = 14, batch: DataFrame | None = None, config: DedupeConfig = DedupeConfig()
) -> DataFrame:
    """``cluster, band_count, id``: members of each cluster, one row each.

    Starting from each large bucket, its own band first and then bands in ascending order take part when their largest
    overlap with the start holds at least nine tenths of it; a member must be in all of them, the start included. A cluster
    needs ``min_bands`` bands and still ``min_bucket`` members. Starts are taken from the largest bucket to the smallest, then
    by name; one whose bucket is more than nine tenths similar to a cluster found before is that one.
    With ``batch`` only buckets that hold one of its ids are looked at: a cluster's new member lies in all
    its bands. All large buckets take part, however many, and everything stays in tables.
    """
    big = large_buckets(signed, min_bucket, None, batch, config)
    big = materialize(big.withColumn("bucket", F.concat_ws(":", "band", "key")).select("bucket", "band", "key", "size"), "big")
    members = materialize(bands(signed, config).join(big, ["band", "key"]).select("bucket", "band", "size", "id"), "members")
    a = members.select(F.col("bucket").alias("start"), F.col("band").alias("band_a"), F.col("size").alias("size_a"), "id")
    b = members.select(F.col("bucket").alias("other"), F.col("band").alias("band_b"), "id")
    shared = a.join(b, "id").groupBy("start", "band_a", "size_a", "other", "band_b").agg(F.count("*").alias("n"))
    close = shared.where((F.col("n") >= OVERLAP * F.col("size_a")) | (F.col("start") == F.col("other")))
    # one bucket of each band: the one that holds most of the start
    per_band = close.groupBy("start", "size_a", "band_a", "band_b").agg(F.max_by("other", F.struct("n", "other")).alias("other"))
    own_first = F.struct((F.col("band_b") != F.col("band_a")).alias("later"), "band_b", "other")
    plan = per_band.groupBy("start", "size_a").agg(F.sort_array(F.collect_list(own_first)).alias("bands"))  # one row a band
    plan = plan.where(F.size("bands") >= min_bands)
    chosen = plan.select("start", "size_a", F.slice("bands", 1, min_bands).alias("bands")).select("start", "size_a", F.inline("bands"))
    counted = chosen.join(members.select(F.col("bucket").alias("other"), "id"), "other").groupBy("start", "size_a", "id").agg(
        F.count("*").alias("band_count")
    )
    inside = counted.where(F.col("band_count") >= min_bands)
    sized = inside.groupBy("start").agg(F.count("*").alias("n"), F.min("band_count").alias("band_count")).where(F.col("n") >= min_bucket)
    inside = materialize(inside.join(sized.select("start", "n"), "start"), "inside")
    found = inside.select("start", "n", "size_a").distinct()
    pairs = inside.select(F.col("start").alias("x"), F.col("n").alias("held"), F.col("size_a").alias("nx"), "id").join(
        members.join(found.select(F.col("start").alias("bucket")), "bucket", "left_semi").select(F.col("bucket").alias("y"), F.col("size").alias("ny"), "id"), "id"
    )
    pairs = pairs.where("x <> y").groupBy("x", "held", "nx", "y", "ny").agg(F.count("*").alias("both"))
    similar = pairs.where(F.col("both") / (F.col("held") + F.col("ny") - F.col("both")) > SIMILAR).select("x", "nx", "y", "ny")
    names = first_apart(found.select("start", F.col("size_a").alias("n")), similar)
    return inside.join(names, "start", "left_semi").select(F.col("start").alias("cluster"), "band_count", "id")


def cluster_roots(clusters: DataFrame) -> DataFrame:
    """``id``: the smallest member of each cluster."""
    return clusters.groupBy("cluster").agg(F.min("id").alias("id")).select("id").distinct()


def star_edges(clusters: DataFrame) -> DataFrame:
    """Edges of every member to its cluster's smallest id, with a fixed similarity of 0.99."""
    root = clusters.groupBy("cluster").agg(F.min("id").alias("parent_id"))
    edges = clusters.join(root, "cluster").where("id <> parent_id")
    return edges.select(
        F.col("id").alias("child_id"),
        "parent_id",
        F.lit(SCORE).alias("jaccard_similarity"),
        F.lit(0).alias("size_difference"),
        F.lit(0.0).alias("size_difference_pct"),
    ).distinct()


def cluster_report(clusters: DataFrame) -> DataFrame:
    """``clusters, documents, largest, mean_size, to_delete`` over all clusters."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("clusters"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("documents"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
        F.coalesce(F.expr("sum(n) div count(*)"), F.lit(0)).alias("mean_size"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("to_delete"),
    )


def clean(docs: DataFrame, clusters: DataFrame, action: CleanupAction) -> DataFrame:
    """The documents after the action: unchanged, roots marked as parents, or others deleted."""
    if action is CleanupAction.REPORT:
        return docs
    roots = cluster_roots(clusters)
    if action is CleanupAction.MARK_PARENT:
        mark = roots.withColumn("_root", F.lit(True))
        state = F.when(F.col("_root").isNotNull(), F.lit(True)).otherwise(F.col("is_parent"))
        return docs.join(mark, "id", "left").withColumn("is_parent", state).drop("_root")
    others = clusters.select("id").distinct().join(roots, "id", "left_anti")
    return docs.join(others, "id", "left_anti")
