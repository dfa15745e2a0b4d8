"""Command line: ``python -m twinsieve.cli RUN ...``."""

from __future__ import annotations

import argparse
import json
import logging
import time
import uuid
from dataclasses import asdict

from pyspark.sql import SparkSession

from twinsieve.config import DedupeConfig
from twinsieve.functions.text import parse_junk_patterns
from twinsieve.operators.cleanup import CleanupAction, cluster_report, cluster_roots, pathological_clusters
from twinsieve.operators.lock import RunLock
from twinsieve.operators.resolve import resolve
from twinsieve.plans.inspect import jaccard_histogram, samples
from twinsieve.plans.pipeline import DedupePipeline, run_datasets
from twinsieve.runtime import scratch
from twinsieve.sources.base import validate_table_name
from twinsieve.sources.generate import demo_documents

log = logging.getLogger("twinsieve")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="twinsieve", description=__doc__)
    p.add_argument("mode", choices=("run", "daemon", "sync", "from-index", "inspect", "build-adjacency", "cleanup", "generate"))
    p.add_argument("--sqlite", help="SQLite file with the documents")
    p.add_argument("--postgres", help="URL of a PostgreSQL database")
    p.add_argument("--id-type", default="uuid", help="type of the ids in PostgreSQL")
    p.add_argument("--tables", help="folder of versioned tables")
    p.add_argument("--files", help="folder of text files (read only)")
    p.add_argument("--table", default="documents")
    p.add_argument("--scope-where", help="trusted SQL predicate")
    p.add_argument("--scope-name", help="keeps an index of its own under this name in the data folder")
    p.add_argument("--dataset", help="id of a dataset")
    p.add_argument("--datasets", help="parquet table of datasets (id, name): each is run with an index of its own")
    p.add_argument("--junk-file", help="text file of patterns; contents with one of them are boilerplate")
    p.add_argument("--output", help="folder for the assignments as JSON lines (with --files)")
    p.add_argument("--batch-size", type=int, default=10_000, help="rows a database reads or writes at a time")
    p.add_argument("--workers", type=int, default=64, help="connections of a scan of PostgreSQL")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--log-file")
    p.add_argument("--data-dir", default="./data")
    p.add_argument("--threshold", type=float, default=0.8)
    p.add_argument("--size-diff", type=float, default=0.3)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--num-bands", type=int, default=16)
    p.add_argument("--rows-per-band", type=int, default=8)
    p.add_argument("--min-content-len", type=int, default=500)
    p.add_argument("--max-matches-per-doc", type=int, default=0, help="0 is off")
    p.add_argument("--edge-lookup", choices=("scan", "index", "auto", "shadow"), default="auto")
    p.add_argument("--all", action="store_true", help="process all documents, with a new index")
    p.add_argument("--fresh", action="store_true", help="as --all")
    p.add_argument("--skip-write", action="store_true")
    p.add_argument("--no-sync", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--slice-rows", type=int, help="rows that a sync writes between two notes of where it stands")
    p.add_argument("--resume", action="store_true", help="from-index: match only what no finished run matched")
    p.add_argument("--interval", type=float, default=5.0)
    p.add_argument("--error-backoff", type=float, default=30.0, help="seconds after a failed round, doubled up to an hour")
    p.add_argument("--run-once", action="store_true")
    p.add_argument("--inspect-limit", type=int, default=20)
    p.add_argument("--inspect-sample", type=float, default=0.0, help="inspect edges of at least this similarity")
    p.add_argument("--generate", type=int, nargs=3, default=(50, 3, 50), metavar=("GROUPS", "COPIES", "SINGLES"), help="invented documents for --tables or --sqlite")
    p.add_argument("--cleanup-action", default="report")
    p.add_argument("--cleanup-min-bucket", type=int, default=10_000)
    p.add_argument("--cleanup-min-bands", type=int, default=14)
    return p


def source_of(spark: SparkSession, args: argparse.Namespace):
    if args.sqlite:
        from twinsieve.sources.sqlite import SqliteSource

        return SqliteSource(spark, args.sqlite, args.table)
    if args.postgres:
        from twinsieve.sources.postgres import PostgresConfig, PostgresSource

        config = PostgresConfig.from_url(args.postgres, args.table, id_type=args.id_type, reads=args.workers, batch_size=args.batch_size)
        return PostgresSource(spark, config, args.scope_where, args.dataset)
    if args.tables:
        from twinsieve.sources.table import TableSource

        return TableSource(spark, args.tables, args.scope_where, args.dataset)
    if args.files:
        from twinsieve.sources.files import FileConfig, FileSource

        return FileSource(spark, FileConfig(args.files))
    from twinsieve.sources.base import DocumentSource

    return DocumentSource()


def config_of(args: argparse.Namespace) -> DedupeConfig:
    whole = args.all or args.fresh
    return DedupeConfig(
        threshold=args.threshold,
        size_diff=args.size_diff,
        seed=args.seed,
        num_bands=args.num_bands,
        rows_per_band=args.rows_per_band,
        min_content_length=args.min_content_len,
        process_all=whole,
        fresh=whole,
        skip_write=args.skip_write,
        max_matches_per_doc=args.max_matches_per_doc or None,
        edge_lookup=args.edge_lookup,
        batch_size=args.batch_size,
    )


def patterns_of(args: argparse.Namespace) -> tuple[str, ...]:
    if not args.junk_file:
        return ()
    with open(args.junk_file, encoding="utf-8") as f:
        return tuple(parse_junk_patterns(f.read()))


def round_of(spark: SparkSession, args: argparse.Namespace) -> dict:
    """One round of a run or daemon: every dataset or the one source, under its lock."""
    if args.datasets:
        docs = source_of(spark, args).documents()
        datasets = spark.read.parquet(args.datasets)

        def open_source(dataset: str):
            return source_of(spark, argparse.Namespace(**{**vars(args), "dataset": dataset}))

        return {name: asdict(s) for name, s in run_datasets(spark, docs, datasets, open_source, args.data_dir, config_of(args)).items()}
    with RunLock(spark, args.data_dir) as lock:
        pipeline = DedupePipeline(spark, source_of(spark, args), args.data_dir, config_of(args), lock.check)
        stats = pipeline.run(patterns=patterns_of(args))
        if args.output and (edges := pipeline.store.edges()) is not None:
            pipeline.source.dupes_json(resolve(edges), args.output)
        return asdict(stats)


def daemon(spark: SparkSession, args: argparse.Namespace, wait=time.sleep) -> None:
    """Rounds for ever; one that fails is logged and tried again after a growing pause."""
    pause = args.error_backoff
    while True:
        try:
            began = time.time()
            with scratch():
                done = round_of(spark, args)
            log.info("round took %.1f s", time.time() - began)
            print(json.dumps(done), flush=True)
            pause = args.error_backoff
        except Exception:
            if args.run_once:
                raise
            log.exception("round failed, next one in %.0f s", pause)
            wait(pause)
            pause = min(3600.0, 2 * pause)
            continue
        if args.run_once:
            return
        wait(args.interval)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(filename=args.log_file, level=logging.DEBUG if args.verbose else logging.INFO)
    if args.scope_name:
        args.data_dir = f"{args.data_dir.rstrip('/')}/{validate_table_name(args.scope_name)}"
    spark = spark or SparkSession.builder.appName("twinsieve").getOrCreate()
    if args.mode == "run":
        print(json.dumps(round_of(spark, args)))
        return 0
    if args.mode == "daemon":
        daemon(spark, args)
        return 0
    if args.mode == "generate":
        docs = demo_documents(spark, *args.generate)
        if args.sqlite:
            source_of(spark, args).insert(tuple(r)[:4] for r in docs.toLocalIterator())
        elif args.tables:
            source_of(spark, args).add(docs, uuid.uuid4().hex)
        else:
            raise SystemExit("generate needs --tables or --sqlite")
        return 0
    if args.mode == "inspect":
        return _mode(spark, args, DedupePipeline(spark, source_of(spark, args), args.data_dir, config_of(args)))
    with RunLock(spark, args.data_dir) as lock:
        return _mode(spark, args, DedupePipeline(spark, source_of(spark, args), args.data_dir, config_of(args), lock.check))


def _mode(spark: SparkSession, args: argparse.Namespace, pipeline: DedupePipeline) -> int:
    if args.mode == "sync":
        print(json.dumps({"assignments": pipeline.replay(args.dry_run, args.slice_rows).count()}))
    elif args.mode == "from-index":
        found = pipeline.from_index(uuid.uuid4().hex, args.resume).count()
        if not args.no_sync:
            pipeline.replay(args.dry_run, args.slice_rows)
        print(json.dumps({"assignments": found}))
    elif args.mode == "build-adjacency":
        print(json.dumps({"built": pipeline.store.build_adjacency()}))
    elif args.mode == "inspect":
        edges = pipeline.store.edges()
        if edges is None:
            print(json.dumps({"edges": 0}))
        else:
            jaccard_histogram(edges).show(truncate=False)
            samples(edges, args.inspect_sample, None, args.inspect_limit).show(args.inspect_limit, truncate=False)
    else:
        signed = pipeline.index.signatures()
        if signed is None:
            print(json.dumps({"clusters": 0}))
            return 0
        clusters = pathological_clusters(signed, args.cleanup_min_bucket, args.cleanup_min_bands)
        print(json.dumps(cluster_report(clusters).first().asDict()))
        action = CleanupAction.parse(args.cleanup_action)
        if action is CleanupAction.MARK_PARENT:
            pipeline.source.mark(cluster_roots(clusters), clusters.select("id").limit(0))
        elif action is CleanupAction.DELETE:
            pipeline.source.delete(clusters.select("id").distinct().join(cluster_roots(clusters), "id", "left_anti"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
