"""Queries of the core, for the driver's contract: one for each operator or report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.config import DedupeConfig
from twinsieve.functions import text
from twinsieve.operators import changes, cleanup, edges, graph, lsh, matching, resolve, skew, sync
from twinsieve.plans import inspect, pipeline
from twinsieve.runtime import materialize, new_path, table
from twinsieve.sources import base
from twinsieve.sources.table import FrameSource, TableSource

CONFIG = DedupeConfig()
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "corpus_docs")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.upsert_edges(None, matching.clean_edges(table(spark, sf_dir, "dupes")))


def _indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.classify(_docs(spark, sf_dir), CONFIG).where("verdict = 'index'")


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.sign(_indexable(spark, sf_dir))


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("is_parent is null").select("id")


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("is_parent").select("id")


def _assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(materialize(_edges(spark, sf_dir), "edges"), _parents(spark, sf_dir), _new(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.edge_of_child(_edges(spark, sf_dir))


# --- changes and skew ----------------------------------------------------------------------------


@query
def p1_found(spark, sf_dir):
    """The feed as it arrives: a first part, a run that dies before its commit, and a run over all that came since."""
    feed, known = table(spark, sf_dir, "doc_feed"), table(spark, sf_dir, "corpus_docs").select("id")
    runs = changes.succeeded_runs(table(spark, sf_dir, "run_log"))
    emit = lambda state, succeeded: changes.pending(state, succeeded).join(known, "id", "left_semi")
    runner = changes.ChangeProcessor(spark, new_path(spark, "changes"), "feed_no")
    whole = feed.agg(F.min("feed_no").alias("first"), F.max("feed_no").alias("last")).first()
    if whole["first"] is not None:
        early = whole["first"] + (whole["last"] - whole["first"]) * 9 // 10
        runner.run(feed.where(F.col("feed_no") <= early), changes.fold_changes, emit, runs, changes.outcome_changes)
        runner.prepare(feed, changes.fold_changes, emit, runs, changes.outcome_changes)
    runner.run(feed, changes.fold_changes, emit, runs, changes.outcome_changes)
    return runner.output()


@query
def p5_found(spark, sf_dir):
    return skew.bucket_results(table(spark, sf_dir, "path_clusters"))


@query
def p5_wrong_counts(spark, sf_dir):
    return skew.wrong_counts(table(spark, sf_dir, "path_clusters"))


# --- text and signatures -------------------------------------------------------------------------


@query
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", text.normalize_content(F.col("content")).alias("normalized"))


@query
def char_ngrams(spark, sf_dir):
    grams = text.char_ngrams(text.normalize_content(F.coalesce("content", F.lit(""))))
    rows = _docs(spark, sf_dir).select("id", grams.alias("g"))
    digest = F.md5(F.array_join("g", "\x1f"))  # of the sequences themselves, in order
    return rows.select("id", F.size("g").alias("n_grams"), F.size(F.array_distinct("g")).alias("n_distinct"), digest.alias("digest"))


@query
def ngram_counts(spark, sf_dir):
    grams = text.char_ngrams(text.normalize_content(F.coalesce("content", F.lit(""))))
    rows = _docs(spark, sf_dir).select(F.explode(grams).alias("gram"))
    return rows.groupBy("gram").agg(F.count("*").alias("n"))


@query
def minhash_signature(spark, sf_dir):
    return _signed(spark, sf_dir).select("id", F.array_join(F.col("sig").cast("array<string>"), "-").alias("signature"), "content_len")


@query
def band_keys(spark, sf_dir):
    return lsh.bands(_signed(spark, sf_dir))


@query
def lsh_buckets(spark, sf_dir):
    found = lsh.buckets(_signed(spark, sf_dir))
    return found.select("band", "key", F.array_join("doc_ids", ",").alias("doc_ids"), F.size("doc_ids").alias("n"))


@query
def large_buckets(spark, sf_dir):
    signed = materialize(_signed(spark, sf_dir), "signed")
    return lsh.bucket_samples(signed, lsh.large_buckets(signed, 3, CONFIG.large_bucket_limit))


@query
def lsh_candidates(spark, sf_dir):
    return lsh.candidate_pairs(materialize(_signed(spark, sf_dir), "signed"))


@query
def incremental_candidates(spark, sf_dir):
    return lsh.candidate_pairs(materialize(_signed(spark, sf_dir), "signed"), _new(spark, sf_dir))


@query
def exact_ngram_jaccard(spark, sf_dir):
    """Exact similarity of all stored matches over their distinct 3-grams."""
    grams = F.array_distinct(text.char_ngrams(text.normalize_content(F.coalesce("content", F.lit("")))))
    docs = _docs(spark, sf_dir).select("id", grams.alias("g"))
    rows = _edges(spark, sf_dir).where("child_id <> parent_id").select("child_id", "parent_id")
    rows = rows.join(docs.select(F.col("id").alias("child_id"), F.col("g").alias("a")), "child_id")
    rows = rows.join(docs.select(F.col("id").alias("parent_id"), F.col("g").alias("b")), "parent_id")
    rows = rows.select("child_id", "parent_id", F.size("a").alias("m"), F.size("b").alias("n"), F.size(F.array_intersect("a", "b")).alias("k"))
    union = F.col("m") + F.col("n") - F.col("k")
    return rows.select("child_id", "parent_id", F.when(union > 0, F.col("k") / union).otherwise(F.lit(0.0)).alias("jaccard"))


# --- filters -------------------------------------------------------------------------------------


@query
def boilerplate_filter(spark, sf_dir):
    found = text.is_boilerplate(F.coalesce("content", F.lit("")), ("{{", "${"))
    return _docs(spark, sf_dir).where(found).select("id")


@query
def document_verdicts(spark, sf_dir):
    return lsh.classify(_docs(spark, sf_dir), CONFIG).select("id", "verdict")


@query
def filtered_parents(spark, sf_dir):
    return lsh.classify(_docs(spark, sf_dir), CONFIG).where("verdict <> 'index'").select("id").distinct()


@query
def size_filter_pairs(spark, sf_dir):
    sizes = _docs(spark, sf_dir).select("id", F.octet_length(F.coalesce("content", F.lit(""))).alias("n"))
    rows = _edges(spark, sf_dir).join(sizes.select(F.col("id").alias("child_id"), F.col("n").alias("a")), "child_id")
    rows = rows.join(sizes.select(F.col("id").alias("parent_id"), F.col("n").alias("b")), "parent_id")
    return rows.where(text.size_within(F.col("a"), F.col("b"), CONFIG.size_diff)).select(
        "child_id", "parent_id", F.abs(F.col("a") - F.col("b")).alias("size_difference"),
        text.size_difference_pct(F.col("a"), F.col("b")).alias("size_difference_pct"),
    )


# --- matching ------------------------------------------------------------------------------------


@query
def raw_edges(spark, sf_dir):
    return matching.raw_edges(materialize(_signed(spark, sf_dir), "signed")).select(*matching.EDGE)


@query
def incremental_edges(spark, sf_dir):
    signed = materialize(_signed(spark, sf_dir), "signed")
    return matching.raw_edges(signed, CONFIG, _new(spark, sf_dir)).select(*matching.EDGE)


@query
def top_m_matches(spark, sf_dir):
    signed = materialize(_signed(spark, sf_dir), "signed")
    return matching.raw_edges(signed, DedupeConfig(max_matches_per_doc=1)).select("p", *matching.EDGE)


@query
def edge_orientation(spark, sf_dir):
    sizes = _docs(spark, sf_dir).select("id", F.octet_length(F.coalesce("content", F.lit(""))).alias("n"))
    pairs = _edges(spark, sf_dir).where("child_id <> parent_id").select(
        F.least("child_id", "parent_id").alias("p"), F.greatest("child_id", "parent_id").alias("c"), "jaccard_similarity"
    )
    pairs = pairs.join(sizes.select(F.col("id").alias("p"), F.col("n").alias("len_p")), "p")
    pairs = pairs.join(sizes.select(F.col("id").alias("c"), F.col("n").alias("len_c")), "c")
    return matching.orient(pairs).drop("p")


@query
def edge_upsert(spark, sf_dir):
    return _edges(spark, sf_dir)


@query
def edge_of_child(spark, sf_dir):
    return _stored(spark, sf_dir)


@query
def compare_documents(spark, sf_dir):
    signed = materialize(_signed(spark, sf_dir), "signed")
    pairs = _edges(spark, sf_dir).where("child_id <> parent_id").select(
        F.col("child_id").alias("id_a"), F.col("parent_id").alias("id_b")
    )
    return inspect.compare_documents(signed, pairs)


# --- graph ---------------------------------------------------------------------------------------


@query
def connected_components(spark, sf_dir):
    return graph.connected_components(_edges(spark, sf_dir), "child_id", "parent_id")


@query
def non_root_nodes(spark, sf_dir):
    return graph.connected_components(_edges(spark, sf_dir), "child_id", "parent_id").where("node <> root")


@query
def adjacency_index(spark, sf_dir):
    return edges.adjacency(_edges(spark, sf_dir))


@query
def connected_edges_scan(spark, sf_dir):
    return edges.connected_edges(materialize(_edges(spark, sf_dir), "edges"), _new(spark, sf_dir), "scan")


def _edge_store(spark: SparkSession, sf_dir: str) -> edges.EdgeStore:
    store = edges.EdgeStore(spark, new_path(spark, "matches"))
    store.insert(_edges(spark, sf_dir), "first")
    store.build_adjacency()
    return store


@query
def connected_edges_indexed(spark, sf_dir):
    return _edge_store(spark, sf_dir).connected(_new(spark, sf_dir), "index")


@query
def connected_edges_shadow(spark, sf_dir):
    return _edge_store(spark, sf_dir).connected(_new(spark, sf_dir), "shadow")


@query
def touched_nodes(spark, sf_dir):
    return edges.reachable(_edges(spark, sf_dir), _new(spark, sf_dir))


@query
def best_incident_edges(spark, sf_dir):
    return resolve.best_incident_edges(_edges(spark, sf_dir))


@query
def resolve_transitivity(spark, sf_dir):
    return resolve.resolve(materialize(_edges(spark, sf_dir), "edges"))


@query
def preferred_root_assignments(spark, sf_dir):
    return _assignments(spark, sf_dir)


# --- writing -------------------------------------------------------------------------------------


@query
def assignments_requiring_write(spark, sf_dir):
    return sync.assignments_requiring_write(_assignments(spark, sf_dir), _stored(spark, sf_dir), _new(spark, sf_dir))


@query
def child_marks(spark, sf_dir):
    return sync.child_marks(_assignments(spark, sf_dir), _new(spark, sf_dir), _parents(spark, sf_dir))


@query
def parent_marks(spark, sf_dir):
    return sync.parent_marks(_assignments(spark, sf_dir), _new(spark, sf_dir), _stored(spark, sf_dir))


@query
def upsert_dupes(spark, sf_dir):
    found = materialize(_assignments(spark, sf_dir), "assignments")
    promoted = found.select(F.col("parent_id").alias("id")).distinct()
    return sync.upsert_dupes(_stored(spark, sf_dir), found, promoted)


@query
def mark_states(spark, sf_dir):
    found = materialize(_assignments(spark, sf_dir), "assignments")
    ups = sync.parent_marks(found, _new(spark, sf_dir), _stored(spark, sf_dir))
    downs = sync.child_marks(found, _new(spark, sf_dir), _parents(spark, sf_dir))
    return sync.mark_states(_docs(spark, sf_dir), ups, downs).select("id", "is_parent", "changed")


@query
def mark_remaining(spark, sf_dir):
    return sync.mark_remaining(_docs(spark, sf_dir)).select("id", "is_parent")


@query
def parent_coverage(spark, sf_dir):
    verdicts = lsh.classify(_docs(spark, sf_dir), CONFIG)
    indexed, filtered = verdicts.where("verdict = 'index'"), verdicts.where("verdict <> 'index'")
    return sync.parent_coverage(indexed, _assignments(spark, sf_dir), filtered)


@query
def sync_resume_offset(spark, sf_dir):
    """What a write that had noted 25 rows writes when it goes on, in slices of 1,000."""
    found = materialize(_assignments(spark, sf_dir), "assignments")
    folder = new_path(spark, "sync")
    source, progress = TableSource(spark, f"{folder}/tables"), sync.SyncProgress(spark, folder)
    progress.set("writing_dupes", done=25)
    sync.write_slices(found, source.write_dupes, progress, 1000)
    return source.dupes()


@query
def delete_documents(spark, sf_dir):
    source = TableSource.create(spark, new_path(spark, "deleted"), _docs(spark, sf_dir).select("id", "content", "is_parent"))
    source.delete(_stored(spark, sf_dir).select(F.col("child_id").alias("id")))
    return source.documents().select("id")


# --- sources -------------------------------------------------------------------------------------


@query
def scope_scan(spark, sf_dir):
    return base.scoped(_docs(spark, sf_dir), "corpus like '%filings' and batch_no > 3").select("id", "corpus", "batch_no")


@query
def dataset_scan(spark, sf_dir):
    ids = table(spark, sf_dir, "datasets").where("name = 'appeal_rulings'").first()
    return base.scoped(_docs(spark, sf_dir), dataset_id=ids["id"]).select("id")


@query
def datasets_with_unprocessed(spark, sf_dir):
    return base.datasets_with_unprocessed(_docs(spark, sf_dir), table(spark, sf_dir, "datasets"))


@query
def keyset_page(spark, sf_dir):
    return FrameSource(_docs(spark, sf_dir)).page_after("40000000-0000-0000-0000-000000000000", 100).select("id", "filename")


@query
def unprocessed_page(spark, sf_dir):
    return FrameSource(_docs(spark, sf_dir)).unprocessed_ids_after("40000000-0000-0000-0000-000000000000", 100)


@query
def offset_page(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", "filename").orderBy("id").offset(200).limit(100)


@query
def source_counts(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.agg(F.count("*").alias("total"), F.count_if(F.col("is_parent").isNull()).alias("unprocessed"))


@query
def documents_by_ids(spark, sf_dir):
    ids = _edges(spark, sf_dir).select(F.col("child_id").alias("id"))
    return FrameSource(_docs(spark, sf_dir)).by_ids(ids).select(
        "id", F.coalesce("content_len", F.char_length("content")).alias("content_len"), "filename"
    )


@query
def existing_parents(spark, sf_dir):
    ids = _edges(spark, sf_dir).select(F.col("parent_id").alias("id"))
    return FrameSource(_docs(spark, sf_dir)).existing_parents(ids)


@query
def existing_dupe_parents(spark, sf_dir):
    source = FrameSource(_docs(spark, sf_dir), matching.clean_edges(table(spark, sf_dir, "dupes")))
    return source.existing_dupe_parents(_new(spark, sf_dir))


@query
def dupe_endpoints(spark, sf_dir):
    found = _edges(spark, sf_dir)
    child = found.select(F.lit("child").alias("side"), F.col("child_id").alias("id"))
    return child.union(found.select(F.lit("parent"), "parent_id")).distinct()


# --- clusters and reports ------------------------------------------------------------------------


@query
def pathological_clusters(spark, sf_dir):
    signed = materialize(_signed(spark, sf_dir), "signed")
    return cleanup.pathological_clusters(signed, 3, 14)


@query
def pathological_stars(spark, sf_dir):
    signed = materialize(_signed(spark, sf_dir), "signed")
    return cleanup.star_edges(materialize(cleanup.pathological_clusters(signed, 3, 14), "clusters"))


@query
def cleanup_report(spark, sf_dir):
    signed = materialize(_signed(spark, sf_dir), "signed")
    return cleanup.cluster_report(cleanup.pathological_clusters(signed, 3, 14))


@query
def jaccard_histogram(spark, sf_dir):
    return inspect.jaccard_histogram(_edges(spark, sf_dir))


@query
def inspect_high(spark, sf_dir):
    return inspect.samples(_edges(spark, sf_dir), 0.95)


@query
def inspect_borderline(spark, sf_dir):
    return inspect.samples(_edges(spark, sf_dir), 0.80, 0.85)


@query
def state_summary(spark, sf_dir):
    return inspect.state_summary(_docs(spark, sf_dir))


@query
def dupes_report(spark, sf_dir):
    return inspect.dupes_report(_edges(spark, sf_dir), _docs(spark, sf_dir))


@query
def index_summary(spark, sf_dir):
    return inspect.index_summary(_signed(spark, sf_dir))


@query
def dedupe_rate(spark, sf_dir):
    return inspect.dedupe_rate(_docs(spark, sf_dir))


# --- pipelines -----------------------------------------------------------------------------------


@query
def dedupe_once(spark, sf_dir):
    """The flagship: assignments of all near-duplicates of the corpus."""
    return pipeline.dedupe_frame(_docs(spark, sf_dir))


@query
def pipeline_assignments(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("id", "content", "content_len", "filename", F.lit(None).cast("boolean").alias("is_parent"))
    folder = new_path(spark, "pipeline")
    source = TableSource.create(spark, f"{folder}/tables", docs)
    pipeline.DedupePipeline(spark, source, f"{folder}/state").run("first")
    return source.dupes()


@query
def pipeline_stats(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("id", "content", "content_len", "filename", F.lit(None).cast("boolean").alias("is_parent"))
    folder = new_path(spark, "pipeline")
    source = TableSource.create(spark, f"{folder}/tables", docs)
    return pipeline.stats_frame(spark, pipeline.DedupePipeline(spark, source, f"{folder}/state").run("first"))


@query
def streaming_incremental(spark, sf_dir):
    """Batches 1-4, 5-7 and 8-10 of the corpus arrive one after another through a stream."""
    from twinsieve.streaming.incremental import StreamingDedupe

    folder = new_path(spark, "stream")
    group = F.expr("case when batch_no <= 4 then 1 when batch_no <= 7 then 2 else 3 end")
    docs = _docs(spark, sf_dir).select("id", "content", "content_len", "filename", group.alias("part"))
    job = StreamingDedupe(spark, f"{folder}/job")
    for part in (1, 2, 3):
        docs.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(docs.drop("part").schema).parquet(f"{folder}/in")
        job.start(stream).awaitTermination()
    return job.source.dupes()

