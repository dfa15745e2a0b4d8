"""Documents and dupes in a SQLite file.

A SQLite file lives on one machine and is read and written by its driver in bounded pages; it is the
small deployment of the same pipeline, not a store for a cluster.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession

from twinsieve.operators.sync import check_single_parent
from twinsieve.sources.base import DocumentSource, validate_table_name

_SCHEMA = """
create table if not exists {table} (id text primary key, content text not null, content_len integer not null,
    filename text, is_parent integer);
create table if not exists dupes (child_id text primary key, parent_id text not null, jaccard_similarity real not null,
    size_difference integer not null, size_difference_pct real not null);
"""


class SqliteSource(DocumentSource):
    name = "sqlite"
    supports_write = True
    tracks_state = True
    page = 20_000

    def __init__(self, spark: SparkSession, path: str, table: str = "documents"):
        self.spark, self.path, self.table = spark, path, validate_table_name(table)
        with closing(self._open()) as db, db:
            db.executescript(_SCHEMA.format(table=self.table))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(self.path)

    def _read(self, sql: str, schema: str) -> DataFrame:
        out = None
        with closing(self._open()) as db:
            rows = db.execute(sql)
            while page := rows.fetchmany(self.page):
                part = self.spark.createDataFrame(page, schema)
                out = part if out is None else out.union(part)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        docs = self._read(
            f"select id, coalesce(content, ''), coalesce(content_len, length(content)), filename, is_parent from {self.table} order by id",
            "id string, content string, content_len long, filename string, state long",
        )
        return docs.selectExpr("id", "content", "cast(content_len as int) content_len", "filename", "cast(state as boolean) is_parent")

    def dupes(self) -> DataFrame:
        return self._read(
            "select child_id, parent_id, jaccard_similarity, size_difference, size_difference_pct from dupes order by child_id",
            "child_id string, parent_id string, jaccard_similarity double, size_difference long, size_difference_pct double",
        ).selectExpr("child_id", "parent_id", "jaccard_similarity", "cast(size_difference as int) size_difference", "size_difference_pct")

    def insert(self, rows: Iterable[tuple]) -> None:
        """``(id, content, content_len, filename)``; an id that is there is replaced and unprocessed again."""
        with closing(self._open()) as db, db:
            db.executemany(f"insert or replace into {self.table} values (?, ?, ?, ?, null)", rows)

    def clear(self) -> None:
        with closing(self._open()) as db, db:
            db.execute(f"delete from {self.table}")
            db.execute("delete from dupes")

    def count_by_state(self, state: bool | None) -> int:
        with closing(self._open()) as db:
            return db.execute(f"select count(*) from {self.table} where is_parent is ?", (state if state is None else int(state),)).fetchone()[0]

    def write_dupes(self, assignments: DataFrame, promoted: DataFrame | None = None) -> None:
        check_single_parent(assignments)
        with closing(self._open()) as db, db:
            if promoted is not None:
                db.executemany("delete from dupes where child_id = ?", ((r[0],) for r in promoted.toLocalIterator()))
            db.executemany("insert or replace into dupes values (?, ?, ?, ?, ?)", (tuple(r) for r in assignments.toLocalIterator()))

    def _mark(self, db: sqlite3.Connection, ids: DataFrame, state: int) -> None:
        sql = f"update {self.table} set is_parent = {state} where id = ? and is_parent is not {state}"
        db.executemany(sql, ((r[0],) for r in ids.toLocalIterator()))

    def mark(self, parents: DataFrame, children: DataFrame) -> None:
        with closing(self._open()) as db, db:
            self._mark(db, parents, 1)
            self._mark(db, children, 0)

    def delete(self, ids: DataFrame) -> None:
        with closing(self._open()) as db, db:
            db.executemany(f"delete from {self.table} where id = ?", ((r[0],) for r in ids.toLocalIterator()))
