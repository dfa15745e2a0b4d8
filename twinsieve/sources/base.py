"""What a document source offers. Documents have ``id, content, content_len, filename, is_parent``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCUMENT = ["id", "content", "content_len", "filename"]
_IDENTIFIER = re.compile(r"[_A-Za-z][_A-Za-z0-9]*(\.[_A-Za-z][_A-Za-z0-9]*)*\Z")


def validate_table_name(name: str) -> str:
    """Dotted identifiers of ASCII letters, digits and underscores only."""
    if not _IDENTIFIER.match(name):
        raise ValueError(f"not a table name: {name!r}")
    return name


class NotSupported(RuntimeError):
    """The source can't do this."""


class DocumentSource:
    """Reading must be provided; writing does nothing unless provided.

    A subclass gives ``documents()``, and may give ``dupes()`` and the writing methods with
    ``supports_write`` and ``tracks_state`` set.
    """

    name = "unknown"
    supports_write = False
    tracks_state = False

    def documents(self) -> DataFrame:
        raise NotSupported(f"{self.name} gives no documents")

    def dupes(self) -> DataFrame | None:
        return None

    def count_total(self) -> int:
        return self.documents().count()

    def unprocessed(self) -> DataFrame:
        docs = self.documents()
        return docs.where("is_parent is null") if self.tracks_state and "is_parent" in docs.columns else docs

    def count_unprocessed(self) -> int:
        return self.unprocessed().count()

    def page_after(self, last_id, limit: int) -> DataFrame:
        """The next ``limit`` documents by id."""
        docs = self.documents()
        return (docs.where(F.col("id") > F.lit(last_id)) if last_id is not None else docs).orderBy("id").limit(limit)

    def unprocessed_ids_after(self, last_id, limit: int) -> DataFrame:
        docs = self.unprocessed()
        docs = docs.where(F.col("id") > F.lit(last_id)) if last_id is not None else docs
        return docs.select("id").orderBy("id").limit(limit)

    def by_ids(self, ids: DataFrame) -> DataFrame:
        return self.documents().join(ids.select("id").distinct(), "id", "left_semi")

    def existing_parents(self, ids: DataFrame) -> DataFrame:
        """``id`` of the given ids that are parents."""
        docs = self.documents()
        if "is_parent" not in docs.columns:
            return docs.select("id").limit(0)
        return docs.where("is_parent").select("id").join(ids.select("id").distinct(), "id", "left_semi")

    def existing_dupe_parents(self, ids: DataFrame) -> DataFrame | None:
        """``child_id, parent_id`` of the given ids; of several rows the most similar."""
        from twinsieve.operators.sync import best_parents

        found = self.dupes()
        return None if found is None else best_parents(found).join(
            ids.select(F.col("id").alias("child_id")).distinct(), "child_id", "left_semi"
        )

    def write_dupes(self, assignments: DataFrame, promoted: DataFrame | None = None) -> None:
        return None

    def mark(self, parents: DataFrame, children: DataFrame) -> None:
        return None

    def delete(self, ids: DataFrame) -> None:
        return None


def scoped(docs: DataFrame, where: str | None = None, dataset_id: str | None = None) -> DataFrame:
    """Documents of a scope: a trusted SQL predicate, or membership of a dataset in ``dataset_ids``."""
    if where:
        docs = docs.where(F.expr(where))
    if dataset_id:
        docs = docs.where(F.array_contains(F.from_json("dataset_ids", "array<string>"), dataset_id))
    return docs


def datasets_with_unprocessed(docs: DataFrame, datasets: DataFrame) -> DataFrame:
    """``dataset_id, name, unprocessed`` of datasets with any, the largest first."""
    rows = docs.where("is_parent is null").select(F.explode(F.from_json("dataset_ids", "array<string>")).alias("dataset_id"))
    counts = rows.groupBy("dataset_id").agg(F.count("*").alias("unprocessed"))
    return counts.join(datasets.select(F.col("id").alias("dataset_id"), "name"), "dataset_id").select(
        "dataset_id", "name", "unprocessed"
    ).orderBy(F.col("unprocessed").desc(), "dataset_id")


def dataset_id_of(datasets: DataFrame, name: str) -> str | None:
    row = datasets.where(F.col("name") == name).select("id").first()
    return row["id"] if row else None


def dataset_name_of(datasets: DataFrame, dataset_id: str) -> str | None:
    row = datasets.where(F.col("id") == dataset_id).select("name").first()
    return row["name"] if row else None


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those of their ids and are unprocessed again."""
    fresh = new.dropDuplicates(["id"]).withColumn("is_parent", F.lit(None).cast("boolean"))
    return old.join(fresh.select("id"), "id", "left_anti").unionByName(fresh.select(old.columns))
