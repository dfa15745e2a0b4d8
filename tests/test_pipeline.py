import os
import random
import time

import duckdb
import pytest

from pyspark.sql import functions as F

from tests.conftest import rows
from twinsieve import cli
from twinsieve.config import DedupeConfig
from twinsieve.operators.edges import EdgeStore
from twinsieve.operators.ledger import CommitConflict
from twinsieve.operators.lock import Locked, LockLost, RunLock
from twinsieve.operators.lsh import LshIndex, MetadataMismatch, band_keys, bands, candidate_pairs, sign
from twinsieve.operators.matching import EDGE, raw_edges, resolving_edges
from twinsieve.operators.resolve import resolve
from twinsieve.operators.sync import AmbiguousAssignment, SyncProgress, write_slices
from twinsieve.plans import inspect
from twinsieve.plans.pipeline import DedupePipeline, dedupe_frame, run_datasets
from twinsieve.runtime import NoSharedFolder, filesystem, materialize, new_path, publish, read_text, scratch, shared_dir
from twinsieve.sources.base import (
    DocumentSource, NotSupported, dataset_id_of, dataset_name_of, datasets_with_unprocessed, scoped, upsert_documents,
    validate_table_name,
)
from twinsieve.sources.generate import demo_documents
from twinsieve.sources.files import FileConfig, FileSource
from twinsieve.sources.postgres import PostgresConfig, PostgresSource, id_ranges
from twinsieve.sources.sqlite import SqliteSource
from twinsieve.sources.table import TableSource, VersionedTable
from twinsieve.streaming.incremental import StreamingDedupe

EDGES = "child_id string, parent_id string, jaccard_similarity double, size_difference int, size_difference_pct double"
DOC = "id string, content string, content_len int, filename string, is_parent boolean"


def prose(seed, n=140):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def docs_frame(spark, data):
    return spark.createDataFrame([(i, c, len(c or ""), None, None) for i, c in data], DOC)


A, B = prose(1), prose(2)
SMALL = DedupeConfig()


def test_once(spark):
    near = A.replace(A.split()[5], "changed", 1)
    data = [("1", A), ("2", A), ("3", near), ("4", B), ("5", prose(3)), ("6", "short"), ("7", None)]
    got = {r[0]: r[1] for r in dedupe_frame(docs_frame(spark, data)).collect()}
    assert got == {"2": "1", "3": "1"}


def test_dense_cluster_and_candidates(spark):
    signed = sign(docs_frame(spark, [(str(i), A) for i in range(4)] + [("9", B)]))
    assert candidate_pairs(signed).count() == 6
    batch = spark.createDataFrame([("3",)], "id string")
    assert rows(candidate_pairs(signed, batch)) == [("3", "0"), ("3", "1"), ("3", "2")]


def test_incremental_bridge(spark):
    """A late document joins two groups; the later group's root becomes a child."""
    words = A.split()
    left, right = " ".join(words[:-20]), " ".join(words[20:])
    folder = new_path(spark, "pipe")
    source = TableSource.create(spark, f"{folder}/t", docs_frame(spark, [("a1", left), ("a2", left), ("b1", right), ("b2", right)]))
    config = DedupeConfig(edge_lookup="shadow")
    first = DedupePipeline(spark, source, f"{folder}/s", config).run("r1")
    assert (first.total, first.assignments, first.unique_parents) == (4, 2, 2)
    assert {r[0]: r[1] for r in source.dupes().collect()} == {"a2": "a1", "b2": "b1"}
    source.add(docs_frame(spark, [("c", A)]), "second")
    second = DedupePipeline(spark, source, f"{folder}/s", config).run("r2")
    assert second.total == 1
    assert {r[0]: r[1] for r in source.dupes().collect()} == {"a2": "a1", "b1": "a1", "b2": "a1", "c": "a1"}
    states = {r["id"]: r["is_parent"] for r in source.states.read().collect()}
    assert states == {"a1": True, "a2": False, "b1": False, "b2": False, "c": False}
    third = DedupePipeline(spark, source, f"{folder}/s", config).run("r3")
    assert third.total == 0  # nothing is left to do
    replayed = DedupePipeline(spark, source, f"{folder}/s", config).replay()
    assert {r[0]: r[1] for r in replayed.collect()} == {"a2": "a1", "b1": "a1", "b2": "a1", "c": "a1"}


@pytest.mark.parametrize("copies", [4, 6])
def test_copies_of_a_later_batch_find_history(spark, copies):
    """A near-duplicate in history is linked whether the copies are few or make a pathological cluster."""
    rng, words = random.Random(4), A.split()
    for k in rng.sample(range(len(words)), 7):
        words[k] = words[k][::-1] + "x"
    near = " ".join(words)
    a, b = (r["sig"] for r in sign(docs_frame(spark, [("a", A), ("b", near)])).orderBy("id").collect())
    assert 0 < sum(a[k : k + 8] == b[k : k + 8] for k in range(0, 128, 8)) < 14
    folder, config = new_path(spark, "pipe"), DedupeConfig(pathological_min_bucket=5)
    source = TableSource.create(spark, f"{folder}/t", docs_frame(spark, [("h", near)]))
    DedupePipeline(spark, source, f"{folder}/s", config).run("r1")
    source.add(docs_frame(spark, [(f"c{i}", A) for i in range(copies)]), "second")
    DedupePipeline(spark, source, f"{folder}/s", config).run("r2")
    assert {r[0]: r[1] for r in source.dupes().collect()} == {f"c{i}": "h" for i in range(copies)}


def test_run_again_after_a_crash(spark, monkeypatch):
    folder = new_path(spark, "pipe")
    source = TableSource.create(spark, f"{folder}/t", docs_frame(spark, [("1", A), ("2", A), ("3", B)]))
    monkeypatch.setattr(source, "mark", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        DedupePipeline(spark, source, f"{folder}/s").run("r")
    monkeypatch.undo()
    stats = DedupePipeline(spark, source, f"{folder}/s").run("r")
    assert stats.total == 3 and rows(source.dupes().select("child_id", "parent_id")) == [("2", "1")]
    assert rows(source.states.read().select("id", "is_parent")) == [("1", True), ("2", False), ("3", True)]


def test_from_index(spark):
    folder = new_path(spark, "pipe")
    pipe = DedupePipeline(spark, DocumentSource(), f"{folder}/s")
    pipe.index.insert(docs_frame(spark, [("1", A), ("2", A), ("3", B)]), "one")
    assert [r[:2] for r in rows(pipe.from_index())] == [("2", "1")]


def test_index(spark):
    folder = new_path(spark, "index")
    index = LshIndex(spark, folder)
    index.insert(docs_frame(spark, [("1", A), ("2", B)]), "one")
    index.insert(docs_frame(spark, [("1", B), ("3", B)]), "two")
    index.insert(docs_frame(spark, [("1", A)]), "two")  # that batch is there already
    assert index.count() == 3
    kept = rows(index.signatures())
    index.compact("all")
    assert index.batches() == ["all"] and rows(index.signatures()) == kept
    with pytest.raises(MetadataMismatch):
        LshIndex(spark, folder, DedupeConfig(seed=7))


def test_scopes_and_datasets(spark):
    data = [("1", '["x","y"]', None), ("2", '["x"]', True), ("3", None, None), ("4", "[]", None), ("5", '["q"]', None)]
    docs = spark.createDataFrame(data, "id string, dataset_ids string, is_parent boolean")
    names = spark.createDataFrame([("x", "X"), ("y", "Y"), ("z", "Z")], "id string, name string")
    assert [tuple(r) for r in datasets_with_unprocessed(docs, names).collect()] == [("x", "X", 1), ("y", "Y", 1)]
    assert rows(scoped(docs, "id > '1'", "x").select("id")) == [("2",)]
    assert validate_table_name("a.b_1") == "a.b_1"
    for bad in ("", "a;b", "1a", "a.", "a b", "a.b\n"):
        with pytest.raises(ValueError):
            validate_table_name(bad)
    with pytest.raises(NotSupported):
        DocumentSource().documents()


def test_table_source(spark):
    old = docs_frame(spark, [("1", A), ("2", B)]).withColumn("is_parent", F.lit(True))
    source = TableSource.create(spark, new_path(spark, "t"), old)
    source.add(docs_frame(spark, [("2", "new text"), ("3", B)]), "more")
    got = {r["id"]: (r["content"], r["is_parent"]) for r in source.documents().collect()}
    assert got == {"1": (A, True), "2": ("new text", None), "3": (B, None)}
    assert source.count_unprocessed() == 2 and rows(source.existing_parents(source.documents())) == [("1",)]
    source.delete(spark.createDataFrame([("2",)], "id string"))
    assert source.count_total() == 2 and [r[0] for r in source.page_after("1", 5).collect()] == ["3"]
    merged = upsert_documents(old, docs_frame(spark, [("2", "x")]))
    assert {(r["id"], r["is_parent"]) for r in merged.collect()} == {("1", True), ("2", None)}


def test_lock(spark):
    folder = new_path(spark, "lock")
    with RunLock(spark, folder) as held:
        assert not RunLock(spark, folder).acquire()
        with pytest.raises(Locked):
            RunLock(spark, folder).__enter__()
        other = RunLock(spark, folder)
        other.release()  # it is not the holder's
        assert not other.acquire() and held.token
        assert RunLock(spark, folder, stale_after=-1).acquire()
    fresh = RunLock(spark, new_path(spark, "lock"))
    assert fresh.acquire()
    fresh.release()
    assert fresh.acquire()


def test_datasets_run_apart(spark):
    folder = new_path(spark, "sets")
    data = [("1", A, '["x"]'), ("2", A, '["x","y"]'), ("3", A, '["y"]'), ("4", B, None)]
    docs = spark.createDataFrame([(i, c, None, None, None, d) for i, c, d in data], DOC + ", dataset_ids string")
    names = spark.createDataFrame([("x", "X"), ("y", "Y")], "id string, name string")
    source = TableSource.create(spark, f"{folder}/t", docs)
    held = RunLock(spark, f"{folder}/s/y")
    assert held.acquire()
    open_source = lambda d: TableSource(spark, f"{folder}/t", dataset_id=d)
    done = run_datasets(spark, source.documents(), names, open_source, f"{folder}/s")
    assert list(done) == ["X"] and done["X"].total == 2
    assert [r[:2] for r in rows(source.dupes())] == [("2", "1")]
    assert (dataset_id_of(names, "X"), dataset_id_of(names, "Z"), dataset_name_of(names, "y")) == ("x", None, "Y")


def test_index_reads(spark):
    index = LshIndex(spark, new_path(spark, "index"))
    asked = docs_frame(spark, [("q", A), ("1", A)])
    assert index.count() == 0 and index.has(asked).where("present").count() == 0
    index.insert(docs_frame(spark, [("1", A), ("2", A), ("3", B)]), "one")
    assert rows(index.query(asked)) == [("1", "2"), ("q", "1"), ("q", "2")]
    assert rows(index.has(asked)) == [("1", True), ("q", False)] and index.ids().count() == 3
    found = bands(index.get(asked)).where("band = 3")
    assert {r["id"] for r in index.bucket_docs(found).collect()} == {"1", "2"}
    store = EdgeStore(spark, new_path(spark, "store"))
    edge = "child_id string, parent_id string, jaccard_similarity double, size_difference int, size_difference_pct double"
    store.insert(spark.createDataFrame([("2", "1", 0.9, 0, 0.0), ("2", "0", 0.95, 0, 0.0), ("2", "2", 1.0, 0, 0.0)], edge), "a")
    assert store.count() == 3 and store.real_edges().count() == 2
    assert [r[:2] for r in rows(store.best_of(spark.createDataFrame([("2",), ("1",)], "id string")))] == [("2", "0")]
    pairs = spark.createDataFrame([("2", "1"), ("1", "2")], "child_id string, parent_id string")
    assert rows(store.contains(pairs)) == [("2", "1")]


def test_postgres_url(monkeypatch):
    monkeypatch.setenv("DATABASE_URL", "postgres://me:x@host:99/base")
    assert PostgresConfig.from_env().jdbc_url == "jdbc:postgresql://host:99/base"
    monkeypatch.delenv("DATABASE_URL")
    with pytest.raises(ValueError):
        PostgresConfig.from_env()
    c = PostgresConfig.from_url("postgresql://u:p@[::1]/db")
    assert (c.port, c.jdbc_url) == (5432, "jdbc:postgresql://[::1]:5432/db")
    with pytest.raises(ValueError):
        PostgresConfig.from_url("mysql://x/y")


def test_sqlite_end_to_end(spark, tmp_path, capsys):
    path = str(tmp_path / "docs.sqlite")
    source = SqliteSource(spark, path)
    source.insert([("1", A, len(A), None), ("2", A, len(A), "f"), ("3", B, len(B), None), ("4", "tiny", 4, None)])
    assert cli.main(["run", "--sqlite", path, "--data-dir", f"file://{tmp_path}/data"], spark) == 0
    assert '"assignments": 1' in capsys.readouterr().out
    assert [r[:2] for r in rows(source.dupes())] == [("2", "1")]
    assert [source.count_by_state(s) for s in (True, False, None)] == [3, 1, 0]
    for mode in ("inspect", "build-adjacency", "sync", "cleanup"):
        assert cli.main([mode, "--sqlite", path, "--data-dir", f"file://{tmp_path}/data"], spark) == 0
    source.insert([("2", B, len(B), None)])
    assert source.count_by_state(None) == 1 and source.unprocessed_ids_after(None, 5).first()[0] == "2"
    source.delete(spark.createDataFrame([("4",)], "id string"))
    assert source.count_total() == 3
    source.clear()
    assert source.count_total() == 0 and source.documents().columns[-1] == "is_parent"


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in {"a.txt": A, "b.TXT": A, "sub/c.txt": B, "d.md": B, "none": B}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.txt").write_bytes(b"ok \xff\xfe broken " + A.encode())
    source = FileSource(spark, FileConfig(f"file://{tmp_path}", (".txt",)))
    assert sorted(r["filename"] for r in source.documents().collect()) == ["a.txt", "b.TXT", "bad.txt", "c.txt"]
    flat = FileSource(spark, FileConfig(f"file://{tmp_path}", recursive=False, max_size=len(A)))
    assert "c.txt" not in {r["filename"] for r in flat.documents().collect()}
    ids = {r["filename"]: r["id"] for r in source.documents().collect()}
    assert len(set(ids.values())) == 4 and all(len(i) == 36 for i in ids.values())
    found = dedupe_frame(source.documents())
    assert found.count() >= 1
    source.dupes_json(found, f"file://{tmp_path}/out")
    assert any(f.endswith(".json") for f in os.listdir(tmp_path / "out"))


def test_stream(spark):
    folder = new_path(spark, "stream")
    job = StreamingDedupe(spark, f"{folder}/job")
    for part in ([("1", A), ("3", B)], [("2", A), ("4", prose(9))], [("5", B), ("2", A)]):
        docs_frame(spark, part).drop("is_parent").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("id string, content string, content_len int, filename string").parquet(f"{folder}/in")
        job.start(stream).awaitTermination()
    assert [r[:2] for r in rows(job.source.dupes())] == [("2", "1"), ("5", "3")]
    states = dict(rows(job.source.states.read().select("id", "is_parent")))
    assert states == {"1": True, "2": False, "3": True, "4": True, "5": False}


def test_reports(spark):
    e = spark.createDataFrame([("b", "a", 0.97, 0, 0.0), ("c", "a", 0.82, 0, 0.0), ("d", "a", None, 0, 0.0)], "child_id string, parent_id string, jaccard_similarity double, size_difference int, size_difference_pct double")
    assert dict(rows(inspect.jaccard_histogram(e))) == {"0.95-1.00": 1, "0.90-0.95": 0, "0.85-0.90": 0, "0.80-0.85": 1, "below 0.80": 0}
    assert inspect.samples(e, 0.8, 0.85).first()[0] == "c"
    docs = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "id string, is_parent boolean")
    assert dict(rows(inspect.state_summary(docs))) == {"parent": 1, "child": 1, "unprocessed": 1}
    assert inspect.dedupe_rate(docs).first()["rate_pct"] == 50.0
    signed = sign(docs_frame(spark, [("1", A), ("2", A), ("3", B)]))
    pairs = spark.createDataFrame([("1", "2"), ("1", "3")], "id_a string, id_b string")
    assert [(r["shared_bands"], r["verdict"]) for r in inspect.compare_documents(signed, pairs).orderBy("id_b").collect()] == [(16, "duplicate"), (0, "not a candidate")]
    assert inspect.index_summary(signed).first()["documents"] == 3


# --- index and edges in proportion to a batch ----------------------------------------------------


def test_a_batch_taken_up_again_signs_new_documents(spark):
    index = LshIndex(spark, new_path(spark, "index"))
    index.insert(docs_frame(spark, [("1", A)]), "one")
    assert index.insert(docs_frame(spark, [("1", A), ("2", B)]), "one").count() == 2
    assert index.count() == 2 and index.keys().count() == 32
    wanted = band_keys(index.signatures().where("id = '2'")).select("bucket").limit(1)
    assert 1 <= index.keys(wanted).count() < 32
    fs, at = filesystem(spark, f"{index.folder}/bands/one")
    fs.delete(at, True)  # the writer died between both tables
    assert index.keys().count() == 32


@pytest.mark.parametrize("seed", range(3))
def test_edges_of_classes_resolve_alike(spark, seed):
    """Copies as one class give the assignments that all edges give."""
    rng = random.Random(seed)
    base = [rng.randrange(1000) for _ in range(128)]
    shapes = []
    for k in range(7):
        sig = list(base)
        for at in rng.sample(range(0, 128), rng.randrange(0, 14)):
            sig[at] = rng.randrange(1000)
        shapes.append((sig, rng.choice([600, 600, 640, 700, 3000])))
    data = [(f"d{i:02}", *rng.choice(shapes)) for i in rng.sample(range(60), 40)]
    signed = spark.createDataFrame(data, "id string, sig array<bigint>, content_len bigint")
    want = rows(resolve(raw_edges(signed).select(*EDGE)))
    got = resolving_edges(signed)
    assert rows(resolve(got)) == want and want
    assert got.count() < raw_edges(signed).count()


def test_many_copies_take_few_edges(spark):
    docs = spark.range(20_000).select(F.format_string("d%05d", "id").alias("id"), F.lit(A).alias("content"))
    found = dedupe_frame(docs).groupBy("parent_id").count()
    assert rows(found) == [("d00000", 19_999)]


# --- writing ---------------------------------------------------------------------------------------


def test_slices_go_on_where_they_stood(spark):
    folder = new_path(spark, "slices")
    frame = spark.createDataFrame([(f"c{i}", "p", 0.9, 0, 0.0) for i in range(7)], EDGES)
    progress, written = SyncProgress(spark, folder), []

    def write(part):
        if len(written) == 2:
            raise RuntimeError("lost")
        written.append([r["child_id"] for r in part.collect()])

    with pytest.raises(RuntimeError):
        write_slices(frame, write, progress, 2)
    assert progress.get() == {"step": "writing_dupes", "done": 4} and progress.in_progress
    written.clear()
    assert write_slices(frame, write, progress, 2) == 3 and written == [["c4", "c5"], ["c6"]]
    progress.set("completed")
    assert progress.completed and len(progress.ledger.numbers()) == 2


def test_two_writers_of_one_table(spark):
    held = VersionedTable(spark, new_path(spark, "v"))
    one = spark.createDataFrame([(1,)], "n int")
    held.replace(one)
    seen = held.version()
    held.replace(one.union(one))
    with pytest.raises(CommitConflict):
        held.replace(one, seen)
    assert held.read().count() == 2


def test_publish_once_and_scratch(spark):
    path = f"{new_path(spark, 'once')}/once.json"
    assert publish(spark, path, "a") and not publish(spark, path, "b") and read_text(spark, path) == "a"
    with scratch():
        kept = materialize(spark.range(3))
        at = kept.inputFiles()[0]
        assert kept.count() == 3
    assert not os.path.exists(at.removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()
        getCheckpointDir = lambda self: None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(NoSharedFolder):
        shared_dir(Session())


class DuckPostgres(PostgresSource):
    """The statements run in DuckDB, whose dialect agrees on them."""

    def __init__(self, spark, db, **kw):
        super().__init__(spark, PostgresConfig.from_url("postgres://u:p@h/b"), **kw)
        self.db, self.fail = db, None

    def _stage(self, df):
        name = f"stage_{len(self.db.execute('show tables').fetchall())}"
        kinds = {"string": "varchar", "int": "integer", "bigint": "bigint", "double": "double"}
        self.db.execute(f"create table {name} ({', '.join(f'{c} {kinds[t]}' for c, t in df.dtypes)})")
        for r in df.collect():
            self.db.execute(f"insert into {name} values ({', '.join('?' * len(r))})", list(r))
        return name

    def _execute(self, statements):
        self.db.execute("begin")
        try:
            for k, sql in enumerate(statements):
                if self.fail == k and not sql.startswith("drop"):
                    raise RuntimeError("lost")
                self.db.execute(sql)
            self.db.execute("commit")
        except BaseException:
            self.db.execute("rollback")
            raise


def test_postgres_writes(spark):
    db = duckdb.connect()
    ids = [f"{k:08x}-0000-0000-0000-000000000000" for k in range(6)]
    db.execute("create table documents (id uuid primary key, is_parent boolean)")
    db.executemany("insert into documents values (?, ?)", [(i, None) for i in ids])
    db.execute("create table dupes (child_id uuid primary key, parent_id uuid, jaccard_similarity double, size_difference integer, size_difference_pct double)")
    source = DuckPostgres(spark, db)
    frame = lambda pairs: spark.createDataFrame([(ids[a], ids[b], 0.9, 1, 0.1) for a, b in pairs], EDGES)
    some = lambda *ks: spark.createDataFrame([(ids[k],) for k in ks], "id string")
    stored = lambda: sorted((ids.index(str(a)), ids.index(str(b))) for a, b in db.execute("select child_id, parent_id from dupes").fetchall())
    source.write_dupes(frame([(1, 0), (3, 2)]))
    source.write_dupes(frame([(1, 2), (4, 3)]), some(3))  # another parent, a new row, a root that was a child
    assert stored() == [(1, 2), (4, 3)]
    source.fail = 1
    with pytest.raises(RuntimeError):
        source.write_dupes(frame([(5, 0)]), some(1))
    source.fail = None
    assert stored() == [(1, 2), (4, 3)]  # whole or not at all
    source.mark(some(0, 1, 2), some(1, 3))
    states = dict(db.execute("select id::varchar, is_parent from documents order by id").fetchall())
    assert [states[i] for i in ids] == [True, False, True, False, None, None]
    source.delete(some(5))
    assert db.execute("select count(*) from documents").fetchone() == (5,)
    assert not [t for (t,) in db.execute("show tables").fetchall() if t.startswith("stage")]
    with pytest.raises(AmbiguousAssignment):
        source.write_dupes(frame([(1, 0), (1, 2)]))


def test_postgres_reads(spark):
    source = DuckPostgres(spark, duckdb.connect(), where="corpus = 'x'", dataset_id="00000000-0000-0000-0000-000000000001")
    sql = source.query("is_parent is null")
    assert "(corpus = 'x') and (is_parent is null) and dataset_ids @>" in sql and "coalesce(content_len, length(content))" in sql
    with pytest.raises(ValueError):
        DuckPostgres(spark, duckdb.connect(), dataset_id="x' or true --")
    db = duckdb.connect()
    db.execute("create table t as select uuid() as id from range(500)")
    for n in (1, 2, 7, 64):
        counts = [db.execute(f"select count(*) from t where {p}").fetchone()[0] for p in id_ranges("id", "uuid", n)]
        assert len(counts) == n and sum(counts) == 500
    assert id_ranges("id", "bigint", 2)[1].endswith("= 1")


# --- locks and the daemon ----------------------------------------------------------------------------


def test_lock_is_renewed_and_can_be_lost(spark):
    folder = new_path(spark, "lock")
    with RunLock(spark, folder, stale_after=0.6) as held:
        time.sleep(1.5)  # renewed meanwhile
        assert not RunLock(spark, folder, stale_after=0.6).acquire()
        held.check()
        held._stop.set()
        held._thread.join()
        time.sleep(0.8)
        other = RunLock(spark, folder, stale_after=0.6)
        assert other.acquire() and not RunLock(spark, folder, stale_after=0.6).acquire()
        with pytest.raises(LockLost):
            held.check()
        with pytest.raises(LockLost):
            held.renew()
    other.check()  # the holder that lost it gave nothing back


def test_daemon_survives_an_error(spark, tmp_path, monkeypatch, capsys):
    path, data = str(tmp_path / "d.sqlite"), f"file://{tmp_path}/data"
    SqliteSource(spark, path).insert([("1", A, len(A), None), ("2", A, len(A), None)])
    args = cli.parser().parse_args(["daemon", "--sqlite", path, "--data-dir", data, "--error-backoff", "3"])
    real, calls, waits = cli.round_of, [], []

    def flaky(*a):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("gone")
        return real(*a)

    def wait(seconds):
        waits.append(seconds)
        if len(waits) == 3:
            raise KeyboardInterrupt

    monkeypatch.setattr(cli, "round_of", flaky)
    with pytest.raises(KeyboardInterrupt):
        cli.daemon(spark, args, wait)
    assert waits == [3.0, 6.0, 5.0] and '"assignments": 1' in capsys.readouterr().out
    with RunLock(spark, data), pytest.raises(Locked):
        cli.main(["run", "--sqlite", path, "--data-dir", data], spark)


def test_resume_and_reprocess(spark):
    folder = new_path(spark, "again")
    source = TableSource.create(spark, f"{folder}/t", docs_frame(spark, [("1", A), ("2", A), ("3", B)]))
    pipe = DedupePipeline(spark, source, f"{folder}/s")
    pipe.run("r1")
    assert rows(pipe.processed()) == [("1",), ("2",), ("3",)]
    pipe.index.insert(docs_frame(spark, [("4", B)]), "late")
    assert [r[:2] for r in rows(pipe.from_index("r2", resume=True))] == [("2", "1"), ("4", "3")]
    assert pipe.processed().count() == 4
    assert pipe.reprocess(spark.createDataFrame([("2",)], "id string"), "r3").total == 1
    assert [r[:2] for r in rows(source.dupes())] == [("2", "1")]


def test_entry_survives_a_missing_package(monkeypatch):
    import __spark_entry__ as entry

    real = entry.importlib.import_module

    def gone(name, *a):
        if name.startswith("twinsieve.llm"):
            raise ModuleNotFoundError("No module named 'ahocorasick'", name="ahocorasick")
        return real(name, *a)

    monkeypatch.setattr(entry.importlib, "import_module", gone)
    with pytest.warns(UserWarning):
        assert "dedupe_once" in entry.queries() and "p2_found" not in entry.queries()


def test_generated_documents(spark, tmp_path):
    docs = demo_documents(spark, groups=4, copies=3, singles=5)
    assert rows(docs) == rows(demo_documents(spark, groups=4, copies=3, singles=5)) and docs.count() == 17
    found = {r["child_id"]: r["parent_id"] for r in dedupe_frame(docs).collect()}
    number = lambda i: int(i.split("-")[1])
    assert found and all(number(c) // 3 == number(p) // 3 and number(c) < 12 for c, p in found.items())
    assert cli.main(["generate", "--tables", f"file://{tmp_path}/t", "--generate", "2", "2", "1"], spark) == 0
    assert TableSource(spark, f"file://{tmp_path}/t").count_unprocessed() == 5


def test_other_bands_and_rows(spark):
    """Short bands make candidates of texts that share few slots; an index keeps its own shape."""
    config = DedupeConfig(num_bands=32, rows_per_band=4)
    sig = list(range(128))
    half = [x if k % 8 < 4 else -x - 1 for k, x in enumerate(sig)]
    signed = spark.createDataFrame([("a", sig, 600), ("b", half, 600)], "id string, sig array<bigint>, content_len bigint")
    assert candidate_pairs(signed).count() == 0 and candidate_pairs(signed, config=config).count() == 1
    folder = new_path(spark, "shape")
    index = LshIndex(spark, folder, config)
    index.insert(docs_frame(spark, [("1", A)]), "one")
    assert index.keys().count() == 32
    with pytest.raises(MetadataMismatch):
        LshIndex(spark, folder)
    with pytest.raises(ValueError):
        DedupeConfig(num_bands=40, rows_per_band=4)
