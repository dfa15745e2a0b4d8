"""Reports over documents, edges and assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.config import NUM_BANDS
from twinsieve.functions.minhash import band_slices, signature_jaccard

#: Lower bounds of the similarity classes, highest first, with their names.
CLASSES = ((0.95, "0.95-1.00"), (0.90, "0.90-0.95"), (0.85, "0.85-0.90"), (0.80, "0.80-0.85"))
REST = "below 0.80"


def jaccard_histogram(edges: DataFrame) -> DataFrame:
    """``bucket, n`` of all similarity classes, those without edges too."""
    j = F.col("jaccard_similarity")
    name = F.lit(REST)
    for low, label in reversed(CLASSES):
        name = F.when(j >= low, F.lit(label)).otherwise(name)
    counts = edges.where(j.isNotNull()).groupBy(name.alias("bucket")).agg(F.count("*").alias("n"))
    labels = edges.sparkSession.createDataFrame([(x,) for x in [c[1] for c in CLASSES] + [REST]], "bucket string")
    return labels.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def samples(edges: DataFrame, low: float, high: float | None = None, limit: int = 10) -> DataFrame:
    """The first edges by (child, parent) with similarity in [low, high)."""
    found = edges.where(F.col("jaccard_similarity") >= low)
    if high is not None:
        found = found.where(F.col("jaccard_similarity") < high)
    return found.orderBy("child_id", "parent_id").limit(limit)


def compare_documents(signed: DataFrame, pairs: DataFrame, threshold: float = 0.8, size_diff: float = 0.3) -> DataFrame:
    """``id_a, id_b, jaccard, shared_bands, size_ratio, verdict`` of given pairs."""
    side = lambda s: signed.select(
        F.col("id").alias(f"id_{s}"), F.col("sig").alias(f"sig_{s}"), F.col("content_len").alias(f"len_{s}")
    )
    rows = pairs.join(side("a"), "id_a").join(side("b"), "id_b")
    equal = F.zip_with(
        band_slices(F.col("sig_a")), band_slices(F.col("sig_b")), lambda x, y: (x["key"] == y["key"]).cast("int")
    )
    shared = F.aggregate(equal, F.lit(0), lambda s, v: s + v)
    ratio = F.when(F.greatest("len_a", "len_b") == 0, F.lit(1.0)).otherwise(F.least("len_a", "len_b") / F.greatest("len_a", "len_b"))
    rows = rows.select(
        "id_a", "id_b", signature_jaccard(F.col("sig_a"), F.col("sig_b")).alias("jaccard"), shared.alias("shared_bands"),
        ratio.alias("size_ratio"),
    )
    verdict = (
        F.when(F.col("shared_bands") == 0, "not a candidate")
        .when(1 - F.col("size_ratio") > size_diff, "size differs")
        .when(F.col("jaccard") < threshold, "below threshold")
        .otherwise("duplicate")
    )
    return rows.withColumn("verdict", verdict)


def state_summary(docs: DataFrame) -> DataFrame:
    """``state, n``: unprocessed, parents and children."""
    state = F.when(F.col("is_parent").isNull(), "unprocessed").when(F.col("is_parent"), "parent").otherwise("child")
    return docs.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def dupes_report(dupes: DataFrame, docs: DataFrame, limit: int = 15) -> DataFrame:
    """The most similar matches with the names of both documents."""
    named = lambda s: docs.select(F.col("id").alias(f"{s}_id"), F.col("filename").alias(f"{s}_filename"))
    joined = dupes.join(named("child"), "child_id").join(named("parent"), "parent_id")
    return joined.select(
        "child_id", "parent_id", "child_filename", "parent_filename", "jaccard_similarity", "size_difference_pct"
    ).orderBy(F.col("jaccard_similarity").desc_nulls_last(), "child_id", "parent_id").limit(limit)


def index_summary(signed: DataFrame) -> DataFrame:
    """``documents, buckets, largest`` of an index."""
    from twinsieve.operators.lsh import bands

    sizes = bands(signed).groupBy("band", "key").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.expr(f"sum(n) div {NUM_BANDS}").alias("documents"), F.count("*").alias("buckets"), F.max("n").alias("largest")
    )


def dedupe_rate(docs: DataFrame) -> DataFrame:
    """``total, children, rate_pct`` over processed documents."""
    row = docs.where("is_parent is not null").agg(
        F.count("*").alias("total"), F.coalesce(F.sum((~F.col("is_parent")).cast("long")), F.lit(0)).alias("children")
    )
    return row.withColumn("rate_pct", F.round(F.when(F.col("total") > 0, 100.0 * F.col("children") / F.col("total")).otherwise(0.0), 6))
