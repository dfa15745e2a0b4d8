"""Documents in PostgreSQL, over Spark's JDBC reader and writer (the driver jar must be on the class path)."""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.operators.resolve import ASSIGNMENT
from twinsieve.operators.sync import check_single_parent
from twinsieve.sources.base import DocumentSource, validate_table_name

DRIVER = "org.postgresql.Driver"


@dataclass(frozen=True)
class PostgresConfig:
    """``id_type`` is the type of the ids in the database; ``reads`` the connections of a whole scan."""

    host: str
    port: int
    database: str
    user: str
    password: str
    table: str = "documents"
    id_type: str = "uuid"
    reads: int = 64
    batch_size: int = 10_000

    def __post_init__(self):
        if not re.fullmatch(r"[a-z]+", self.id_type) or self.reads < 1 or self.batch_size < 1:
            raise ValueError("id_type is a plain type name, reads and batch_size are positive")

    @classmethod
    def from_url(cls, url: str, table: str = "documents", **more) -> "PostgresConfig":
        """``postgres[ql]://user:password@host[:port]/database``; the port is 5432 by default."""
        parts = urlsplit(url)
        if parts.scheme not in ("postgres", "postgresql") or not parts.hostname or not parts.path.strip("/"):
            raise ValueError("not a PostgreSQL URL")
        return cls(
            parts.hostname, parts.port or 5432, parts.path.strip("/"), parts.username or "", parts.password or "",
            validate_table_name(table), **more,
        )

    @classmethod
    def from_env(cls, table: str = "documents") -> "PostgresConfig":
        """The URL in ``DATABASE_URL``."""
        if "DATABASE_URL" not in os.environ:
            raise ValueError("DATABASE_URL is not set")
        return cls.from_url(os.environ["DATABASE_URL"], table)

    @property
    def jdbc_url(self) -> str:
        host = f"[{self.host}]" if ":" in self.host else self.host
        return f"jdbc:postgresql://{host}:{self.port}/{self.database}"


def id_ranges(column: str, id_type: str, n: int) -> list[str]:
    """``n`` predicates that together hold for every id, each for one: ranges of a uuid's first 32 bits, or
    classes of a hash for other types."""
    if id_type != "uuid":
        return [f"mod(abs(hashtext({column}::text)::bigint), {n}) = {k}" for k in range(n)]
    cuts = [f"'{(k << 32) // n:08x}-0000-0000-0000-000000000000'::uuid" for k in range(n)]
    inner = [f"{column} >= {a} and {column} < {b}" for a, b in zip(cuts[1:], cuts[2:])]
    return ["true"] if n == 1 else [f"{column} < {cuts[1]}", *inner, f"{column} >= {cuts[-1]}"]


class PostgresSource(DocumentSource):
    """Reads by ranges of ids over several connections, the scope and state in the server's query.

    Writes put rows into a table of their own first, in parallel, and then change the real tables by a
    few statements in one transaction, so a write happens whole or not at all; written again it changes nothing.
    """

    name = "postgresql"
    tracks_state = True
    supports_write = True

    def __init__(self, spark: SparkSession, config: PostgresConfig, where: str | None = None, dataset_id: str | None = None):
        if dataset_id is not None:
            uuid.UUID(dataset_id)  # it becomes part of a statement
        self.spark, self.config, self.where, self.dataset_id = spark, config, where, dataset_id

    # --- reading -------------------------------------------------------------------------------------

    def query(self, state: str | None = None) -> str:
        """The documents of the scope as the server selects them."""
        conditions = [f"({c})" for c in (self.where, state) if c]
        if self.dataset_id:
            conditions.append(f"dataset_ids @> '[\"{self.dataset_id}\"]'::jsonb")
        columns = "id::text as id, content, coalesce(content_len, length(content)) as content_len, filename, is_parent"
        return f"select {columns}, id as key_ from {self.config.table}" + (f" where {' and '.join(conditions)}" if conditions else "")

    def _properties(self) -> dict[str, str]:
        c = self.config
        return {"user": c.user, "password": c.password, "driver": DRIVER, "fetchsize": str(c.batch_size), "batchsize": str(c.batch_size)}

    def _read(self, query: str) -> DataFrame:
        c = self.config
        ranges = id_ranges("key_", c.id_type, c.reads)
        rows = self.spark.read.jdbc(c.jdbc_url, f"({query}) d", predicates=ranges, properties=self._properties())
        return rows.drop("key_")

    def documents(self) -> DataFrame:
        return self._read(self.query())

    def unprocessed(self) -> DataFrame:
        return self._read(self.query("is_parent is null"))

    def existing_parents(self, ids: DataFrame) -> DataFrame:
        query = f"select id::text as id, id as key_ from {self.config.table} where is_parent"
        return self._read(query).join(ids.select("id").distinct(), "id", "left_semi")

    def dupes(self) -> DataFrame:
        return self._read(
            "select child_id::text as child_id, parent_id::text as parent_id, jaccard_similarity, size_difference,"
            " size_difference_pct, child_id as key_ from dupes"
        )

    # --- writing -------------------------------------------------------------------------------------

    def _stage(self, df: DataFrame) -> str:
        """Rows in a table of their own; ids are text there."""
        name = f"stage_{uuid.uuid4().hex}"
        df.write.jdbc(self.config.jdbc_url, name, mode="error", properties=self._properties())
        return name

    def _execute(self, statements: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(DRIVER)
        connection = jvm.java.sql.DriverManager.getConnection(self.config.jdbc_url, self.config.user, self.config.password)
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            for sql in statements:
                statement.executeUpdate(sql)
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def _with_stages(self, tables: dict[str, DataFrame], statements: list[str]) -> None:
        names = {}
        try:
            for key, df in tables.items():
                names[key] = self._stage(df)
            self._execute([s.format(**names) for s in statements])
        finally:
            if names:
                self._execute([f"drop table if exists {n}" for n in names.values()])

    def write_dupes(self, assignments: DataFrame, promoted: DataFrame | None = None) -> None:
        check_single_parent(assignments)
        kind, measures = self.config.id_type, ", ".join(ASSIGNMENT[2:])
        tables = {"new": assignments.select(*ASSIGNMENT)}
        statements = []
        if promoted is not None:
            tables["gone"] = promoted.select(F.col(promoted.columns[0]).alias("id")).distinct()
            statements.append(f"delete from dupes using {{gone}} g where dupes.child_id = g.id::{kind}")
        changes = ", ".join(f"{c} = excluded.{c}" for c in ASSIGNMENT[1:])
        statements.append(
            f"insert into dupes (child_id, parent_id, {measures}) select child_id::{kind}, parent_id::{kind}, {measures} from {{new}}"
            f" on conflict (child_id) do update set {changes}"
        )
        self._with_stages(tables, statements)

    def mark(self, parents: DataFrame, children: DataFrame) -> None:
        one = lambda df: df.select(F.col(df.columns[0]).alias("id")).distinct()
        table, kind = self.config.table, self.config.id_type
        change = lambda stage, to: (
            f"update {table} set is_parent = {to} from {stage} s where {table}.id = s.id::{kind} and {table}.is_parent is distinct from {to}"
        )
        self._with_stages({"up": one(parents), "down": one(children)}, [change("{up}", "true"), change("{down}", "false")])

    def delete(self, ids: DataFrame) -> None:
        table = self.config.table
        self._with_stages(
            {"gone": ids.select("id").distinct()}, [f"delete from {table} using {{gone}} g where {table}.id = g.id::{self.config.id_type}"]
        )
