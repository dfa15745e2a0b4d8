"""Text files as documents."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions.minhash import item_hash
from twinsieve.sources.base import DocumentSource

_LOW_PREFIX = "twinsieve-file:"


@dataclass(frozen=True)
class FileConfig:
    folder: str
    extensions: tuple[str, ...] = ()
    recursive: bool = True
    min_size: int = 0
    max_size: int = 0  # 0 is unlimited


def _path_ids(paths: pd.Series) -> pd.Series:
    def one(path: str) -> str:
        h = f"{item_hash(path.encode()):016x}{item_hash((_LOW_PREFIX + path).encode()):016x}"
        return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"

    return paths.map(one)


def path_id(path: Column) -> Column:
    """A stable id of a path, in the form of a UUID."""
    return F.pandas_udf(_path_ids, "string")(path)


def _lossy(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", "replace"))


def lossy_text(content: Column) -> Column:
    """UTF-8 with each broken sequence replaced by U+FFFD."""
    return F.pandas_udf(_lossy, "string")(content)


class FileSource(DocumentSource):
    name = "filesystem"

    def __init__(self, spark: SparkSession, config: FileConfig):
        self.spark, self.config = spark, config

    def paths(self) -> DataFrame:
        """``id, path, length, content`` of the files that pass the filters."""
        c = self.config
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", str(c.recursive).lower()).load(c.folder)
        if c.extensions:
            wanted = [e.lower().lstrip(".") for e in c.extensions]
            files = files.where(F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1)).isin(wanted))
        if c.min_size:
            files = files.where(F.col("length") >= c.min_size)
        if c.max_size:
            files = files.where(F.col("length") <= c.max_size)
        plain_path = F.regexp_replace("path", r"^file:/+", "/")
        return files.select(path_id(plain_path).alias("id"), plain_path.alias("path"), "length", "content")

    def path_of(self, ids: DataFrame) -> DataFrame:
        """``id, path`` of the given ids."""
        return self.paths().select("id", "path").join(ids.select("id").distinct(), "id", "left_semi")

    def documents(self) -> DataFrame:
        text = lossy_text(F.col("content"))
        return self.paths().select(
            "id", text.alias("content"), F.char_length(text).alias("content_len"), F.regexp_extract("path", r"[^/]+$", 0).alias("filename")
        )

    def dupes_json(self, assignments: DataFrame, target: str) -> None:
        """All assignments with their paths as JSON lines, written once as a whole."""
        paths = self.paths().select("id", "path")
        rows = assignments.join(paths.select(F.col("id").alias("child_id"), F.col("path").alias("child_path")), "child_id", "left")
        rows = rows.join(paths.select(F.col("id").alias("parent_id"), F.col("path").alias("parent_path")), "parent_id", "left")
        rows.write.mode("overwrite").json(target)
