"""Pairwise matches to groups by hash-to-min.

The cluster sets are kept as rows ``(v, u)``, u being in the set of v, so no set is ever held in one
row or task. In a round every vertex sends its set to the set's minimum, and that minimum to all of
the set; the rounds end when the rows stay the same. Then every vertex but the smallest of its group
holds just that smallest one. The set of a hot smallest vertex is only joined to one row of its own,
which adaptive execution splits over tasks where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.runtime import write_out


def clean_id(c: Column) -> Column:
    """Ids in lower case without white space around."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def hash_to_min(pairs: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``id, group_id``: each id of a pair with the smallest id that it is linked to, itself included."""
    ends = pairs.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null")
    sets = ends.union(ends.select(F.col("u").alias("v"), F.col("v").alias("u")))
    sets = sets.union(ends.select("v", F.col("v").alias("u"))).union(ends.select(F.col("u").alias("v"), "u")).distinct()
    now = write_out(sets, "sets", fingerprint=True)
    for _ in range(max_rounds):
        low = now.df.groupBy("v").agg(F.min("u").alias("m"))
        sent = now.df.join(low, "v").select(
            F.explode(
                F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
            ).alias("s")
        )
        now, old = write_out(sent.select("s.v", "s.u").distinct(), "sets", fingerprint=True), now
        old.drop()
        if now.fingerprint == old.fingerprint:
            return now.df.groupBy("v").agg(F.min("u").alias("group_id")).withColumnRenamed("v", "id")
    raise RuntimeError(f"groups were not stable after {max_rounds} rounds")


def match_groups(dupes: DataFrame) -> DataFrame:
    """``id, group_id`` of every id in a row of ``dupes`` with both sides present.

    Ids are compared in lower case without blanks around; an id of blanks only counts as absent.
    Every such row links, whatever its measures. A record paired only with itself is its own group.
    """
    side = lambda c: F.when(clean_id(F.col(c)) != "", clean_id(F.col(c)))
    return hash_to_min(dupes.select(side("child_id").alias("a"), side("parent_id").alias("b")), "a", "b")
