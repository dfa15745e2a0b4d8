"""Processing only new or changed records.

A feed is a table with a monotonic commit sequence. Its folded state and the output of it are kept in
hash classes ("buckets") of the record key, each bucket a folder of its own. Each run

1. reads the high watermark of the last commit (null before the first, so nothing lies below it),
2. fixes its upper bound at its start (the largest sequence number then present),
3. folds the rows in between into the buckets that they touch, and writes state and output of those
   buckets only, under a name of their own,
4. commits by adding one record to a ledger, which names watermark, states and outputs together.
   That is one atomic step, which fails where another run committed the same version.

So a run reads the new rows of the feed and the touched buckets, and no more. One that dies before step 4 leaves only
files that no commit names: the next run starts from the old watermark and skips or repeats nothing, and removes
them. The folders of the commit before the last stay for readers that began with it; older ones are removed.

The output may depend on a side table too (``context``): it is kept with each commit, and buckets whose output
changes by it are emitted again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from twinsieve.operators.ledger import CommitConflict, Ledger
from twinsieve.runtime import names_in, remove

__all__ = ["ChangeProcessor", "Commit", "CommitConflict", "fold_changes", "outcome_changes", "pending", "succeeded_runs"]


class NoSequence(ValueError):
    """Rows without a sequence number; they can't be said to be old or new."""


@dataclass(frozen=True)
class Commit:
    """``states`` and ``outputs`` name the folder of every bucket, by the bucket's number as text."""

    version: int = 0
    watermark: int | None = None
    buckets: int = 0
    states: dict[str, str] = field(default_factory=dict)
    outputs: dict[str, str] = field(default_factory=dict)
    context: str | None = None
    context_mark: list[int] | None = None  # row count and checksum
    schemas: dict[str, str] = field(default_factory=dict)  # of "state", "output" and "context", as JSON

    def folders(self) -> set[str]:
        return {*self.states.values(), *self.outputs.values()} | ({self.context} if self.context else set())


Fold = Callable[[DataFrame, DataFrame | None], DataFrame]


class ChangeProcessor:
    """Runs a fold over the unread part of a feed; see the module's text for the protocol.

    ``fold(batch, state)`` gets the new rows and the committed state of their buckets (None at first) and returns
    the new state, which has the column ``key``; both are of whole buckets, so any fold by key will do.
    ``emit(state, context)`` gives the output of a state, with ``key`` too. ``affected(state, old, new)`` gives
    the keys (column ``key``) whose output changes when the context does.

    The number of buckets is fixed by the first commit: ``buckets``, or as many as the session has shuffle partitions.
    """

    def __init__(self, spark: SparkSession, folder: str, sequence: str, key: str = "id", buckets: int | None = None):
        self.spark, self.folder, self.sequence, self.key = spark, folder.rstrip("/"), sequence, key
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.ledger = Ledger(spark, f"{self.folder}/commits")

    def last(self) -> Commit:
        _, record = self.ledger.last()
        return Commit(**record) if record else Commit()

    def _read(self, table: str, places: dict[str, str], schemas: dict[str, str]) -> DataFrame | None:
        """The table's rows of the buckets in ``places``; a folder is read for those of its buckets that are still named."""
        if table not in schemas:
            return None
        schema = StructType.fromJson(json.loads(schemas[table]))
        by_folder: dict[str, list[int]] = {}
        for bucket, folder in places.items():
            by_folder.setdefault(folder, []).append(int(bucket))
        whole = self.spark.createDataFrame([], schema)
        for folder, buckets in sorted(by_folder.items()):
            part = self.spark.read.schema(StructType([*schema, StructField("_bucket", IntegerType())])).parquet(
                f"{self.folder}/data/{folder}/{table}"
            )
            part = part.where(F.col("_bucket").isin(buckets)).drop("_bucket")
            whole = part if folder == min(by_folder) else whole.unionByName(part)
        return whole

    def _context(self, folder: str, schemas: dict[str, str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(schemas["context"]))
        return self.spark.read.schema(schema).parquet(f"{self.folder}/data/{folder}/context")

    def state(self) -> DataFrame | None:
        last = self.last()
        return self._read("state", last.states, last.schemas)

    def output(self) -> DataFrame | None:
        last = self.last()
        return self._read("output", last.outputs, last.schemas)

    def _write(self, df: DataFrame, path: str, buckets: int) -> None:
        rows = df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int")).repartition("_bucket")
        rows.write.partitionBy("_bucket").parquet(path)

    def prepare(
        self,
        feed: DataFrame,
        fold: Fold,
        emit: Callable[[DataFrame, DataFrame | None], DataFrame],
        context: DataFrame | None = None,
        affected: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None,
    ) -> Commit:
        """All of a run but its commit: nothing of it is seen until :meth:`commit`."""
        last, seq = self.last(), F.col(self.sequence)
        buckets = last.buckets or self.buckets
        unread = feed if last.watermark is None else feed.where((seq > last.watermark) | seq.isNull())
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int")
        # one pass over the unread rows; at most `buckets` numbers come back
        seen = unread.agg(F.max(seq).alias("upper"), F.count_if(seq.isNull()).alias("nulls"), F.collect_set(bucket).alias("touched")).first()
        if seen["nulls"]:
            raise NoSequence(f"{seen['nulls']} rows without {self.sequence}")
        upper, touched = last.watermark if seen["upper"] is None else int(seen["upper"]), seen["touched"]
        folder = f"{last.version + 1:09d}-{uuid.uuid4().hex}"
        base = f"{self.folder}/data/{folder}"
        batch = unread.where(seq <= upper) if upper is not None else unread.limit(0)
        states, outputs, schemas, emitted = dict(last.states), dict(last.outputs), dict(last.schemas), set(touched)
        if touched or not schemas:
            old = self._read("state", {b: f for b, f in last.states.items() if int(b) in emitted}, schemas)
            new = fold(batch, old)
            schemas["state"] = new.schema.json()
            self._write(new, f"{base}/state", buckets)
            states |= {str(b): folder for b in touched}
        place, mark = last.context, last.context_mark
        if context is not None:
            noted, schemas["context"] = Observation(), context.schema.json()
            row = F.xxhash64(*context.columns).cast("decimal(38,0)")
            context.observe(noted, F.count(F.lit(1)).alias("n"), F.sum(row).alias("s")).write.parquet(f"{base}/context")
            context, place, mark = self._context(folder, schemas), folder, [int(noted.get["n"]), int(noted.get["s"] or 0)]
            if last.context and affected is not None and mark != last.context_mark:
                turned = affected(self._read("state", last.states, schemas), self._context(last.context, last.schemas), context)
                emitted |= {r[0] for r in turned.select(bucket.alias("b")).distinct().collect()}
        if emitted or "output" not in schemas:
            found = emit(self._read("state", {b: f for b, f in states.items() if int(b) in emitted}, schemas), context)
            schemas["output"] = found.schema.json()
            self._write(found, f"{base}/output", buckets)
            outputs |= {str(b): folder for b in emitted}
        return Commit(last.version + 1, upper, buckets, states, outputs, place, mark, schemas)

    def commit(self, prepared: Commit) -> Commit:
        self.ledger.add(prepared.version, asdict(prepared))
        self._tidy(prepared)
        return prepared

    def run(self, feed: DataFrame, fold: Fold, emit, context: DataFrame | None = None, affected=None) -> Commit:
        """One run; arguments as in :meth:`prepare`."""
        return self.commit(self.prepare(feed, fold, emit, context, affected))

    def _tidy(self, now: Commit) -> None:
        """Remove what neither of the last two commits names: of older ones, and of runs that died or lost."""
        kept = now.folders()
        for number in self.ledger.numbers():
            if number == now.version - 1:
                kept |= Commit(**self.ledger.read(number)).folders()
            elif number < now.version:
                self.ledger.forget(number)
        for name in names_in(self.spark, f"{self.folder}/data"):
            if name not in kept and int(name.split("-")[0]) <= now.version:
                remove(self.spark, f"{self.folder}/data/{name}")


def fold_changes(batch: DataFrame, state: DataFrame | None) -> DataFrame:
    """State of a document feed: per id its newest change, and the marks that may still judge it.

    Rows are ``(id, row_version, deleted, run_id)``; ``run_id`` null is a change, else a mark. A change
    delivered again is one change; marks without run are left out; marks of versions below the
    newest change can never matter again and are dropped. Null ids and null versions are left out.
    """
    kind = F.lower(F.trim("change_kind"))
    rows = batch.where(
        F.col("id").isNotNull()
        & F.col("row_version").isNotNull()
        & (kind.isin("insert", "update", "delete") | ((kind == "mark") & F.col("run_id").isNotNull()))
    ).select(
        "id",
        "row_version",
        (kind == "delete").alias("deleted"),
        F.when(kind == "mark", F.col("run_id")).alias("run_id"),
    )
    if state is not None:
        rows = rows.unionByName(state.select(rows.columns))
    rows = rows.distinct()
    newest = (
        rows.where(F.col("run_id").isNull())
        .groupBy("id")
        .agg(F.max(F.struct("row_version", "deleted")).alias("new"))
        .select("id", F.col("new.row_version").alias("row_version"), F.col("new.deleted").alias("deleted"))
    )
    marks = rows.where(F.col("run_id").isNotNull()).select("id", "row_version", "run_id")
    live = (
        marks.join(newest.select("id", F.col("row_version").alias("newest")), "id", "left")
        .where(F.col("newest").isNull() | (F.col("row_version") >= F.col("newest")))
        .select("id", "row_version", F.lit(False).alias("deleted"), "run_id")
    )
    return newest.select("id", "row_version", "deleted", F.lit(None).cast("string").alias("run_id")).unionByName(live)


def succeeded_runs(run_log: DataFrame) -> DataFrame:
    """Runs whose attempt with the highest number succeeded; of rows with equal attempt the one that
    finished last counts, then the larger status. Repeated rows change nothing."""
    status = F.lower(F.trim("run_status"))
    return (
        run_log.where(F.col("run_id").isNotNull() & F.col("attempt").isNotNull())
        .groupBy("run_id")
        .agg(F.max(F.struct("attempt", "finished_at", status.alias("status"))).alias("end"))
        .where(F.col("end.status") == "succeeded")
        .select("run_id")
    )


def pending(state: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Ids whose newest change is no delete and is judged by no mark of a run in ``succeeded``."""
    newest = state.where(F.col("run_id").isNull()).select("id", "row_version", "deleted")
    judged = (
        state.where(F.col("run_id").isNotNull())
        .select("id", "row_version", "run_id")
        .join(succeeded, "run_id", "left_semi")
        .select("id", "row_version")
    )
    return newest.where(~F.col("deleted")).join(judged, ["id", "row_version"], "left_anti").select("id")


def outcome_changes(state: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """``id``: those with a mark of a run that is in only one of two tables of succeeded runs."""
    turned = before.withColumn("n", F.lit(1)).union(now.withColumn("n", F.lit(-1)))
    turned = turned.groupBy("run_id").agg(F.sum("n").alias("n")).where("n <> 0")
    return state.where(F.col("run_id").isNotNull()).join(turned, "run_id", "left_semi").select("id")
