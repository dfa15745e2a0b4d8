"""Applying assignments: which rows must be written, and the written tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.operators.ledger import Ledger
from twinsieve.operators.resolve import ASSIGNMENT


def assignments_requiring_write(assignments: DataFrame, existing: DataFrame, new: DataFrame) -> DataFrame:
    """Assignments whose child is new, or whose stored parent is missing or another one."""
    ids = new.select(F.col(new.columns[0]).alias("child_id")).distinct().withColumn("is_new", F.lit(True))
    old = best_parents(existing).select("child_id", F.col("parent_id").alias("old_parent"))
    joined = assignments.join(ids, "child_id", "left").join(old, "child_id", "left")
    return joined.where(F.col("is_new").isNotNull() | ~F.col("parent_id").eqNullSafe(F.col("old_parent"))).select(*ASSIGNMENT)


def best_parents(dupes: DataFrame) -> DataFrame:
    """``child_id, parent_id``: of several stored rows of a child the most similar, then the smallest parent."""
    best = F.min(F.struct((-F.coalesce("jaccard_similarity", F.lit(0.0))).alias("j"), "parent_id"))
    rows = dupes.where("child_id is not null and parent_id is not null")
    return rows.groupBy("child_id").agg(best.alias("b")).select("child_id", "b.parent_id")


def child_marks(assignments: DataFrame, new: DataFrame, parents: DataFrame) -> DataFrame:
    """``id`` of children to be marked: those that are new or marked as parents now."""
    children = assignments.select(F.col("child_id").alias("id")).distinct()
    due = new.select(F.col(new.columns[0]).alias("id")).union(parents.select(F.col(parents.columns[0]).alias("id")))
    return children.join(due.distinct(), "id", "left_semi")


def parent_marks(assignments: DataFrame, new: DataFrame, existing: DataFrame) -> DataFrame:
    """``id`` of parents to be marked: new ids that are no children, and roots with a stored row of their own."""
    children = assignments.select(F.col("child_id").alias("id"))
    alone = new.select(F.col(new.columns[0]).alias("id")).join(children, "id", "left_anti")
    roots = assignments.select(F.col("parent_id").alias("id")).distinct()
    promoted = roots.join(existing.select(F.col("child_id").alias("id")), "id", "left_semi")
    return alone.union(promoted).distinct()


def upsert_dupes(existing: DataFrame, assignments: DataFrame, promoted: DataFrame | None = None) -> DataFrame:
    """The dupes table after a write: new rows replace all rows of their children; rows of ids that
    became roots go."""
    gone = assignments.select("child_id")
    if promoted is not None:
        gone = gone.union(promoted.select(F.col(promoted.columns[0]).alias("child_id")))
    kept = existing.join(gone.distinct(), "child_id", "left_anti")
    return kept.select(*ASSIGNMENT).unionByName(assignments.select(*ASSIGNMENT))


class AmbiguousAssignment(RuntimeError):
    """A child has more than one parent in one write."""


def check_single_parent(assignments: DataFrame) -> None:
    several = assignments.groupBy("child_id").agg(F.count("*").alias("n")).where("n > 1")
    if not several.isEmpty():
        raise AmbiguousAssignment(f"several parents for {several.first()['child_id']}")


def mark_states(docs: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """``docs`` with ``is_parent`` set, and ``changed`` where it was another; children win over parents."""
    up = parents.select(F.col(parents.columns[0]).alias("id")).distinct().withColumn("_up", F.lit(True))
    down = children.select(F.col(children.columns[0]).alias("id")).distinct().withColumn("_down", F.lit(True))
    state = F.when(F.col("_down").isNotNull(), F.lit(False)).when(F.col("_up").isNotNull(), F.lit(True)).otherwise(F.col("is_parent"))
    joined = docs.join(up, "id", "left").join(down, "id", "left").withColumn("_new", state)
    return joined.withColumn("changed", ~F.col("_new").eqNullSafe(F.col("is_parent"))).withColumn(
        "is_parent", F.col("_new")
    ).drop("_up", "_down", "_new")


def mark_remaining(docs: DataFrame) -> DataFrame:
    """Everything unprocessed becomes a parent."""
    return docs.withColumn("is_parent", F.coalesce("is_parent", F.lit(True)))


def parent_coverage(indexed: DataFrame, assignments: DataFrame, filtered: DataFrame | None = None) -> DataFrame:
    """``id`` of all parents: indexed documents that are no children, and filtered ones."""
    ids = indexed.select("id").join(assignments.select(F.col("child_id").alias("id")), "id", "left_anti")
    if filtered is not None:
        ids = ids.union(filtered.select("id"))
    return ids.distinct()


STEPS = ("none", "writing_dupes", "marking_parents", "marking_children", "completed")


class SyncProgress:
    """Where a write stands: the last record of a ledger, which is there whole or not at all."""

    def __init__(self, spark: SparkSession, folder: str):
        self.ledger = Ledger(spark, f"{folder.rstrip('/')}/progress")

    def get(self) -> dict:
        return self.ledger.last()[1] or {"step": "none"}

    def set(self, step: str, **counts: int) -> None:
        if step not in STEPS:
            raise ValueError(f"unknown step {step}")
        number, _ = self.ledger.last()
        self.ledger.add(number + 1, {"step": step, **counts})
        for old in self.ledger.numbers():
            if old < number:
                self.ledger.forget(old)

    @property
    def in_progress(self) -> bool:
        return self.get()["step"] not in ("none", "completed")

    @property
    def completed(self) -> bool:
        return self.get()["step"] == "completed"

    def reset(self) -> None:
        self.set("none")


def rows_after(assignments: DataFrame, done: int) -> DataFrame:
    """What is left of a write after its first ``done`` rows by (child, parent)."""
    return assignments.orderBy("child_id", "parent_id").offset(done)


def write_slices(assignments: DataFrame, write: Callable[[DataFrame], None], progress: SyncProgress, size: int) -> int:
    """Write in slices of ``size`` rows by (child, parent), noting after each how many are written; a write that
    died goes on where it stood. Gives the number of rows written now."""
    total = assignments.count()
    at = progress.get()
    done = began = at.get("done", 0) if at["step"] == "writing_dupes" else 0
    while done < total:
        progress.set("writing_dupes", done=done)
        write(rows_after(assignments, done).limit(size))
        done = min(total, done + size)
    progress.set("writing_dupes", done=done)
    return total - began
