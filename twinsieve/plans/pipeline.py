"""The composite pipelines: one-shot dedupe, incremental runs over a source, and replay of an index."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.config import DedupeConfig
from twinsieve.operators.cleanup import pathological_clusters, star_edges
from twinsieve.operators.edges import EdgeStore
from twinsieve.operators.lock import Locked, RunLock
from twinsieve.operators.lsh import LshIndex, band_keys, candidate_pairs, classify, sign
from twinsieve.operators.matching import EDGE, raw_edges, resolving_edges
from twinsieve.operators.resolve import parents_of, resolve
from twinsieve.operators.sync import (
    SyncProgress, assignments_requiring_write, best_parents, child_marks, parent_coverage, parent_marks,
    write_slices,
)
from twinsieve.runtime import filesystem, materialize
from twinsieve.sources.base import DocumentSource, datasets_with_unprocessed


def to_match(ids: DataFrame, clusters: DataFrame, signed: DataFrame) -> DataFrame:
    """``id``: the ids outside clusters, and of those inside one for each signature and size. All with the same
    have the same matches, and the cluster's star edges link them; so what lies outside the cluster is still found."""
    inside = ids.join(clusters.select("id").distinct(), "id", "left_semi")
    one = signed.join(inside, "id", "left_semi").groupBy("sig", "content_len").agg(F.min("id").alias("id"))
    return ids.join(inside, "id", "left_anti").union(one.select("id"))


def dedupe_frame(docs: DataFrame, config: DedupeConfig = DedupeConfig(), patterns: tuple[str, ...] = ()) -> DataFrame:
    """One-shot: assignments of all duplicates in a table of documents; roots are the smallest ids."""
    kept = classify(docs, config, patterns).where("verdict = 'index'")
    signed = materialize(sign(kept, config.seed), "signed")
    return resolve(materialize(resolving_edges(signed, config), "edges"))


@dataclass
class DedupeStats:
    """``skipped``: documents that an earlier batch had signed; ``candidates``: pairs whose signatures were compared."""

    total: int = 0
    boilerplate: int = 0
    short: int = 0
    indexed: int = 0
    skipped: int = 0
    candidates: int = 0
    edges_found: int = 0
    assignments: int = 0
    new_children: int = 0
    unique_parents: int = 0


class DedupePipeline:
    """Incremental runs with an index and an edge table under ``data_dir``.

    A run takes the unprocessed documents, filters them, signs what the index lacks, replaces the pairs
    inside pathological clusters by star edges, matches the rest against everything indexed, resolves only the components
    that the batch touches, and writes what changed. Every table of a run is written under the run's name
    before the next step reads it, and documents are marked last, so a run that died is simply run
    again: its documents are still unprocessed and its tables are replaced. ``guard`` is called before anything is
    written to the source and may raise, as a lock that was lost does. Ids of finished runs are kept in ``processed``,
    so that matching an index without a source can go on where it stood.
    """

    def __init__(
        self, spark: SparkSession, source: DocumentSource, data_dir: str, config: DedupeConfig = DedupeConfig(),
        guard: Callable[[], None] = lambda: None,
    ):
        self.spark, self.source, self.folder, self.config, self.guard = spark, source, data_dir.rstrip("/"), config, guard
        if config.fresh:
            fs, at = filesystem(spark, self.folder)
            fs.delete(at, True)
        self.index = LshIndex(spark, f"{self.folder}/index", config)
        self.store = EdgeStore(spark, f"{self.folder}/matches")
        self.progress = SyncProgress(spark, self.folder)

    def _filtered(self) -> DataFrame | None:
        fs, at = filesystem(self.spark, f"{self.folder}/filtered")
        return self.spark.read.parquet(f"{self.folder}/filtered/*") if fs.exists(at) else None

    def processed(self) -> DataFrame | None:
        """``id`` of everything that a finished run matched."""
        fs, at = filesystem(self.spark, f"{self.folder}/processed")
        return self.spark.read.parquet(f"{self.folder}/processed/*").distinct() if fs.exists(at) else None

    def _done(self, ids: DataFrame, run_id: str) -> None:
        ids.select("id").write.mode("overwrite").parquet(f"{self.folder}/processed/{run_id}")

    def reprocess(self, ids: DataFrame, run_id: str | None = None) -> DedupeStats:
        """Match the given ids again, whatever their state."""
        return self.run(run_id, docs=self.source.by_ids(ids))

    def run(self, run_id: str | None = None, patterns: tuple[str, ...] = (), docs: DataFrame | None = None) -> DedupeStats:
        """One run over ``docs``, by default the source's unprocessed documents."""
        run_id, config = run_id or uuid.uuid4().hex, self.config
        if docs is None:
            docs = self.source.documents() if config.process_all or config.fresh else self.source.unprocessed()
        sorted_docs = materialize(classify(docs.select("id", "content"), config, patterns), "batch")
        counts = {r["verdict"]: r["count"] for r in sorted_docs.groupBy("verdict").count().collect()}
        stats = DedupeStats(sum(counts.values()), counts.get("boilerplate", 0), counts.get("short", 0), counts.get("index", 0))
        if not stats.total:
            return stats
        filtered = sorted_docs.where("verdict <> 'index'").select("id")
        filtered.write.mode("overwrite").parquet(f"{self.folder}/filtered/{run_id}")
        batch = sorted_docs.where("verdict = 'index'").select("id", "content")
        own = self.index.insert(batch, run_id)
        signed = self.index.signatures()
        new = batch.select("id")
        # everything below reads the band keys of the batch's folders, and signatures of documents that share one
        stats.skipped = new.distinct().join(own.select("id"), "id", "left_anti").count()
        fresh = own.join(new.distinct(), "id", "left_semi") if not stats.skipped else signed.join(new.distinct(), "id", "left_semi")
        mine = materialize(band_keys(fresh, config).select("bucket").distinct(), "mine")
        met = self.index.keys(mine).join(mine, "bucket", "left_semi")
        met = materialize(met, "met")
        near = materialize(signed.join(met.select("id").distinct(), "id", "left_semi"), "near")
        clusters = self._clusters(met, near, new)
        stars = star_edges(clusters)
        todo = materialize(to_match(new, clusters, near), "todo")
        pairs = materialize(candidate_pairs(near, todo, config.size_diff, clusters, met, config), "pairs")
        stats.candidates = pairs.count()
        found = raw_edges(near, config, pairs=pairs).select(*EDGE).unionByName(stars)
        self.store.insert(found, run_id)
        self.store.build_adjacency()
        stats.edges_found, assignments = self.sync(new, filtered)
        stats.assignments = assignments.count()
        stats.new_children = assignments.join(new.select(F.col("id").alias("child_id")), "child_id", "left_semi").count()
        stats.unique_parents = max(0, stats.indexed - stats.new_children) + stats.short + stats.boilerplate
        self._done(new, run_id)
        return stats

    def _clusters(self, met: DataFrame, near: DataFrame, new: DataFrame) -> DataFrame:
        """Pathological clusters that the batch is in; only buckets large enough are looked into, mostly none."""
        least = self.config.pathological_min_bucket
        large = materialize(met.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= least), "large")
        if large.isEmpty():
            return self.spark.createDataFrame([], f"cluster string, band_count bigint, id {near.schema['id'].dataType.simpleString()}")
        inside = near.join(met.join(large, "bucket", "left_semi").select("id").distinct(), "id", "left_semi")
        return materialize(pathological_clusters(inside, least, self.config.pathological_min_bands, new, self.config), "clusters")

    def sync(self, new: DataFrame, filtered: DataFrame) -> tuple[int, DataFrame]:
        """Resolve the components that new ids touch and write what changed."""
        edges = self.store.connected(new, self.config.edge_lookup)
        touched = materialize(edges, "touched")
        nodes = touched.select(F.explode(F.array("child_id", "parent_id")).alias("id")).distinct()
        nodes = materialize(nodes.union(new.select("id")).distinct(), "nodes")
        parents = materialize(self.source.existing_parents(nodes), "parents")
        assignments = materialize(resolve(touched, parents, new), "assignments")
        existing = self.source.dupes()
        if existing is None:
            existing = assignments.limit(0)
        due = assignments_requiring_write(assignments, existing, new)
        stored = best_parents(existing)
        ups = materialize(parent_marks(assignments, new, stored).union(filtered.select("id")).distinct(), "ups")
        downs = materialize(child_marks(assignments, new, parents), "downs")
        if self.source.supports_write and not self.config.skip_write:
            promoted = assignments.select(F.col("parent_id").alias("id")).distinct()
            due = materialize(due, "due")
            self.guard()
            self.progress.set("writing_dupes")
            self.source.write_dupes(due, promoted)
            self.guard()
            self.progress.set("marking_parents")
            self.source.mark(ups, downs)
            self.progress.set("completed")
        return touched.count(), assignments

    def replay(self, dry_run: bool = False, slice_rows: int | None = None) -> DataFrame:
        """Resolve all stored edges again and write everything; the assignments come back.

        With ``slice_rows`` they are written in slices of so many rows. A replay that died is taken up where it stood:
        slices that were written whole are not written again.
        """
        edges = self.store.edges()
        if edges is None:
            raise ValueError("there are no edges")
        assignments = materialize(resolve(edges), "assignments")
        if dry_run or not self.source.supports_write:
            return assignments
        covered = parent_coverage(self.index.signatures(), assignments, self._filtered())
        covered = covered.union(parents_of(edges, assignments)).distinct()
        promoted = assignments.select(F.col("parent_id").alias("id")).distinct()
        if self.progress.get()["step"] != "marking_parents":
            self.guard()
            write = lambda rows: self.source.write_dupes(rows, promoted)
            write_slices(assignments, write, self.progress, slice_rows or max(1, assignments.count()))
            self.guard()
            self.progress.set("marking_parents")
        self.source.mark(covered, assignments.select(F.col("child_id").alias("id")))
        self.progress.set("completed")
        return assignments

    def from_index(self, run_id: str = "from-index", resume: bool = False) -> DataFrame:
        """Match everything indexed, without a source; the edges' assignments come back. With ``resume`` only what no
        finished run matched is matched, against everything."""
        signed = self.index.signatures()
        if signed is None:
            raise ValueError("the index is empty")
        ids, before = signed.select("id"), self.processed() if resume else None
        if before is not None:
            ids = materialize(ids.join(before, "id", "left_anti"), "ids")
        clusters = materialize(
            pathological_clusters(
                signed, self.config.pathological_min_bucket, self.config.pathological_min_bands, None if before is None else ids, self.config
            ),
            "clusters",
        )
        todo = materialize(to_match(ids, clusters, signed), "todo")
        found = raw_edges(signed, self.config, todo, clusters, self.index.keys()).select(*EDGE).unionByName(star_edges(clusters))
        self.store.insert(found, run_id)
        self._done(ids, run_id)
        return resolve(self.store.edges())


def run_datasets(
    spark: SparkSession, docs: DataFrame, datasets: DataFrame, open_source: Callable[[str], DocumentSource], data_dir: str, config: DedupeConfig = DedupeConfig()
) -> dict[str, DedupeStats]:
    """One run for each dataset with unprocessed documents, the largest first, each with an index of its own
    and under a lock of its own; a dataset that another run holds is left out. The list of datasets is a
    table of settings."""
    done = {}
    for row in datasets_with_unprocessed(docs, datasets).collect():
        folder = f"{data_dir.rstrip('/')}/{row['dataset_id']}"
        lock = RunLock(spark, folder)
        try:
            with lock:
                done[row["name"]] = DedupePipeline(spark, open_source(row["dataset_id"]), folder, config, lock.check).run()
        except Locked:
            continue
    return done


def stats_frame(spark: SparkSession, stats: DedupeStats) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(stats).values())], ", ".join(f"{k} long" for k in asdict(stats)))
