"""The best representative of each duplicate group, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.llm.consolidate import match_groups

REAL_NAME = r"\.[A-Za-z0-9]{2,5}$"


def top_per_group(rows: DataFrame, order: list[Column], group: str = "group_id") -> DataFrame:
    """The first row of each group. The rank limit is applied within each partition before the
    shuffle, so a group that holds a third of all rows sends one row per partition."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def survivors(dupes: DataFrame | None, corpus: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``group_id, field_name, from_id``: the id whose value survives, for groups of two or more.

    content: trusted rows (is_parent true) first, then the longest content (code points, null is 0),
    the latest loaded_at (null is earliest), the smallest id. filename: among names that end in a dot
    and 2 to 5 ASCII letters or digits, the latest loaded_at, then the smallest id; none, no row.
    Ids that corpus lacks can't survive; a group without any row in corpus gives no row. ``groups`` (``id,
    group_id``) are taken where they are there already, else those of the matches in ``dupes``.
    """
    groups = match_groups(dupes) if groups is None else groups.select("id", "group_id")
    several = groups.where("id <> group_id").select("group_id").distinct()
    known = corpus.where(F.col("id").isNotNull()).select(
        "id",
        F.coalesce("is_parent", F.lit(False)).alias("trusted"),
        F.coalesce(F.char_length("content"), F.lit(0)).alias("length"),
        F.coalesce(F.col("filename").rlike(REAL_NAME), F.lit(False)).alias("named"),
        "loaded_at",
    )
    rows = groups.join(known, "id")
    latest = [F.col("loaded_at").desc_nulls_last(), F.col("id").asc()]
    content = top_per_group(rows, [F.col("trusted").desc(), F.col("length").desc(), *latest])
    filename = top_per_group(rows.where("named"), latest)
    found = content.select("group_id", F.lit("content").alias("field_name"), F.col("id").alias("from_id")).union(
        filename.select("group_id", F.lit("filename"), "id")
    )
    return found.join(several, "group_id", "left_semi")


def surviving_records(dupes: DataFrame, corpus: DataFrame) -> DataFrame:
    """``group_id, content, filename``: the built record of each group of two or more."""
    chosen = survivors(dupes, corpus)
    fields = [f for f in ("content", "filename")]
    rows = chosen.join(corpus.select(F.col("id").alias("from_id"), *fields), "from_id")
    return rows.groupBy("group_id").agg(
        *(F.max(F.when(F.col("field_name") == f, F.col(f))).alias(f) for f in fields)
    )
