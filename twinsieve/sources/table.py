"""Documents and dupes in versioned parquet folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.operators.ledger import Ledger
from twinsieve.operators.resolve import ASSIGNMENT
from twinsieve.operators.sync import check_single_parent, mark_states, upsert_dupes
from twinsieve.runtime import filesystem
from twinsieve.sources.base import DocumentSource, scoped

DUPES = "child_id string, parent_id string, jaccard_similarity double, size_difference int, size_difference_pct double"


class VersionedTable:
    """A table rewritten as a whole: a new version is written beside, then named by one record of a ledger.
    Of two writers that began with one version the second fails, so that no change is lost."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.ledger = Ledger(spark, f"{self.folder}/versions")

    def version(self) -> int:
        return self.ledger.last()[0]

    def read(self) -> DataFrame | None:
        _, last = self.ledger.last()
        return self.spark.read.parquet(f"{self.folder}/data/{last['name']}") if last else None

    def replace(self, df: DataFrame, after: int | None = None) -> None:
        """``after`` is the version that ``df`` was made from, by default the last one."""
        name, number = uuid.uuid4().hex, self.version() if after is None else after
        df.write.parquet(f"{self.folder}/data/{name}")
        self.ledger.add(number + 1, {"name": name})
        for old in self.ledger.numbers():
            if old < number:  # the version before stays for readers that began with it
                fs, at = filesystem(self.spark, f"{self.folder}/data/{self.ledger.read(old)['name']}")
                fs.delete(at, True)
                self.ledger.forget(old)


class TableSource(DocumentSource):
    """A read-write source that keeps contents and states apart.

    Contents are written once, a directory for each part that was added, and never rewritten; the
    states (``id, is_parent, part``) are a narrow table of their own, so marking or deleting documents
    moves no text. A document counts with the part that its state names.
    """

    name = "table"
    supports_write = True
    tracks_state = True

    def __init__(self, spark: SparkSession, folder: str, where: str | None = None, dataset_id: str | None = None):
        self.spark, self.folder, self.where, self.dataset_id = spark, folder.rstrip("/"), where, dataset_id
        self.states = VersionedTable(spark, f"{self.folder}/states")
        self.matches = VersionedTable(spark, f"{self.folder}/dupes")

    @classmethod
    def create(cls, spark: SparkSession, folder: str, docs: DataFrame, dupes: DataFrame | None = None, **scope) -> "TableSource":
        source = cls(spark, folder, **scope)
        source.add(docs, "first", keep_state=True)
        source.matches.replace(dupes.select(*ASSIGNMENT) if dupes is not None else spark.createDataFrame([], DUPES))
        return source

    @staticmethod
    def part_name(part: str) -> str:
        return f"p-{part}"  # never read back as a number

    def add(self, docs: DataFrame, part: str, keep_state: bool = False) -> None:
        """Add documents, or replace those of the same ids; they are unprocessed unless ``keep_state``."""
        part = self.part_name(part)
        path = f"{self.folder}/contents/part={part}"
        docs.drop("is_parent", "part").dropDuplicates(["id"]).write.mode("overwrite").parquet(path)
        ids = self.spark.read.parquet(path).select("id")
        if keep_state:
            ids = ids.join(docs.select("id", "is_parent").dropDuplicates(["id"]), "id")
        else:
            ids = ids.withColumn("is_parent", F.lit(None).cast("boolean"))
        version = self.states.version()
        new, old = ids.withColumn("part", F.lit(part)), self.states.read()
        if old is not None:
            new = old.join(new.select("id"), "id", "left_anti").unionByName(new)
        self.states.replace(new, version)

    def documents(self) -> DataFrame:
        return self._of(self.states.read())

    def unprocessed(self) -> DataFrame:
        """Only the parts that hold unprocessed documents are read."""
        return self._of(self.states.read().where("is_parent is null"))

    def _of(self, states: DataFrame) -> DataFrame:
        parts = [r["part"] for r in states.select("part").distinct().collect()]  # one for each time documents were added
        contents = self.spark.read.parquet(f"{self.folder}/contents").where(F.col("part").isin(parts))
        return scoped(contents.join(states, ["id", "part"]).drop("part"), self.where, self.dataset_id)

    def dupes(self) -> DataFrame:
        found = self.matches.read()
        return found if found is not None else self.spark.createDataFrame([], DUPES)

    def write_dupes(self, assignments: DataFrame, promoted: DataFrame | None = None) -> None:
        check_single_parent(assignments)
        version = self.matches.version()
        self.matches.replace(upsert_dupes(self.dupes(), assignments, promoted), version)

    def mark(self, parents: DataFrame, children: DataFrame) -> None:
        version = self.states.version()
        self.states.replace(mark_states(self.states.read(), parents, children).drop("changed"), version)

    def existing_parents(self, ids: DataFrame) -> DataFrame:
        return self.states.read().where("is_parent").select("id").join(ids.select("id").distinct(), "id", "left_semi")

    def delete(self, ids: DataFrame) -> None:
        version = self.states.version()
        self.states.replace(self.states.read().join(ids.select("id").distinct(), "id", "left_anti"), version)


class FrameSource(DocumentSource):
    """Any DataFrame with the documents' columns, read only."""

    name = "frame"

    def __init__(self, docs: DataFrame, dupes: DataFrame | None = None, where: str | None = None):
        self._docs, self._dupes, self.where = docs, dupes, where
        self.tracks_state = "is_parent" in docs.columns

    def documents(self) -> DataFrame:
        return scoped(self._docs, self.where)

    def dupes(self) -> DataFrame | None:
        return self._dupes
