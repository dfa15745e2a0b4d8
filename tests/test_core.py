import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows, union_find
from twinsieve.operators import changes, edges, graph, matching, resolve, skew, sync
from twinsieve.operators.cleanup import CleanupAction, clean, cluster_report, first_apart, pathological_clusters, star_edges
from twinsieve.runtime import names_in, new_path

EDGE = "child_id string, parent_id string, jaccard_similarity double, size_difference int, size_difference_pct double"


def edge_frame(spark, pairs):
    return spark.createDataFrame([(a, b, float(j), 0, 0.0) for a, b, j in pairs], EDGE)


# --- components ----------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["chain", "star", "random", "self", "empty"])
def test_components(spark, shape):
    rng = random.Random(5)
    pairs = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(i, 0) for i in range(1, 80)],
        "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(90)],
        "self": [(1, 1), (2, 3), (None, 4), (5, None)],
        "empty": [],
    }[shape]
    got = dict(rows(graph.connected_components(spark.createDataFrame(pairs, "u bigint, v bigint"))))
    assert got == union_find([p for p in pairs if None not in p])


# --- edges ---------------------------------------------------------------------------------------


def bfs(pairs, seeds):
    seen, grown = set(seeds), True
    while grown:
        new = {y for a, b in pairs for x, y in ((a, b), (b, a)) if x in seen} - seen
        seen |= new
        grown = bool(new)
    return {(a, b) for a, b in pairs if a != b and a in seen}


@pytest.mark.parametrize("seed", range(3))
def test_connected_edges_all_ways(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(30)})
    frame = edge_frame(spark, [(a, b, 0.9) for a, b in pairs])
    seeds = spark.createDataFrame([("n01",), ("n07",), ("zz",)], "id string")
    index = edges.adjacency(frame)
    want = bfs(pairs, {"n01", "n07"})
    for lookup in ("scan", "index", "auto", "shadow"):
        got = {(r[0], r[1]) for r in edges.connected_edges(frame, seeds, lookup, index).collect()}
        assert got == want, lookup
    with pytest.raises(ValueError):
        edges.connected_edges(frame, seeds, "index")


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n = 5000
    chain = [(f"n{k:05d}", f"n{k + 1:05d}", 0.9, 0, 0.0) for k in range(n)] + [("x1", "x2", 0.9, 0, 0.0)]
    random.Random(1).shuffle(chain)
    found = spark.createDataFrame(chain, EDGE).repartition(7)
    seeds = spark.createDataFrame([("n04000",)], "id string")
    monkeypatch.setattr(graph, "CONTRACTED", 50)  # tasks contract little, so rounds are needed
    assert edges.connected_edges(found, seeds).count() == n
    store = edges.EdgeStore(spark, new_path(spark, "chain"), buckets=8)
    store.insert(found, "b1")
    store.build_adjacency()
    assert store.connected(seeds, "shadow").count() == n


def test_few_seeds_read_few_folders(spark):
    pairs = [(f"a{k:04d}", f"b{k:04d}", 0.9, 0, 0.0) for k in range(400)]
    store = edges.EdgeStore(spark, new_path(spark, "folders"), buckets=32)
    store.insert(spark.createDataFrame(pairs, EDGE), "b1")
    store.build_adjacency()
    seeds = spark.createDataFrame([("b0007",)], "id string")
    found = store.connected(seeds, "index")
    assert [(r["child_id"], r["parent_id"]) for r in found.collect()] == [("a0007", "b0007")]
    _, folders = edges.reachable_in_index(store.index(), seeds, 32)
    assert len(folders) <= 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_stores_compact(spark):
    store = edges.EdgeStore(spark, new_path(spark, "compact"), buckets=4)
    for k, rows_ in enumerate(([("a", "b", 0.8, 1, 0.1)], [("a", "b", 0.9, 2, 0.2), ("c", "d", 0.8, 0, 0.0)])):
        store.insert(spark.createDataFrame(rows_, EDGE), f"b{k}")
    store.build_adjacency()
    before = rows(store.edges())
    store.compact("all")
    assert store.batches() == ["all"] and rows(store.edges()) == before and store.index() is not None
    store.compact("all")
    assert rows(store.edges()) == before


def test_edge_store(spark):
    store = edges.EdgeStore(spark, new_path(spark, "store"))
    assert store.edges() is None and not store.build_adjacency()
    store.insert(edge_frame(spark, [("a", "b", 0.7), ("c", "c", 1.0)]), "one")
    store.insert(edge_frame(spark, [("a", "b", 0.95)]), "two")
    store.insert(edge_frame(spark, [("a", "b", 0.95)]), "two")  # again
    assert [r[:3] for r in rows(store.edges())] == [("a", "b", 0.95), ("c", "c", 1.0)]
    assert store.build_adjacency() and not store.build_adjacency()
    assert store.index().count() == 4  # the edge of both batches from both ends; none of the self-edge
    assert [r[:3] for r in rows(store.connected(spark.createDataFrame([("b",)], "id string"), "index"))] == [("a", "b", 0.95)]
    store.insert(edge_frame(spark, [("b", "d", 0.9)]), "three")
    assert store.index() is None  # it no longer covers everything
    assert {r[0] for r in rows(store.connected(spark.createDataFrame([("d",)], "id string")))} == {"a", "b"}
    store.clear()
    assert store.edges() is None


def test_upsert_keeps_most_similar(spark):
    old, new = edge_frame(spark, [("a", "b", 0.9)]), edge_frame(spark, [("a", "b", 0.8), ("b", "a", 0.7)])
    assert [r[:3] for r in rows(matching.upsert_edges(old, new))] == [("a", "b", 0.9), ("b", "a", 0.7)]


def test_top_matches_and_orientation(spark):
    df = spark.createDataFrame([("a", "b", 10, 20, 0.9), ("a", "c", 30, 20, 0.8), ("b", "c", 5, 5, 1.0)], "p string, c string, len_p int, len_c int, jaccard_similarity double")
    found = matching.orient(df)
    assert {(r["child_id"], r["parent_id"]) for r in found.collect()} == {("b", "a"), ("a", "c"), ("b", "c")}
    assert {r["child_id"] + r["parent_id"] for r in matching.top_matches(found, 1).collect()} == {"ba", "bc"}


# --- resolving and writing -----------------------------------------------------------------------


def test_roots_and_measures(spark):
    frame = edge_frame(spark, [("3", "2", 0.95), ("2", "1", 0.95), ("9", "8", 0.8)])
    got = {r[0]: r[1:3] for r in resolve.resolve(frame).collect()}
    assert got == {"2": ("1", 0.95), "3": ("1", 0.95), "9": ("8", 0.8)}
    parents = spark.createDataFrame([("2",)], "id string")
    new = spark.createDataFrame([("8",)], "id string")
    got = {r[0]: r[1] for r in resolve.resolve(frame, parents, new).collect()}
    assert got == {"1": "2", "3": "2", "8": "9"}
    own = edge_frame(spark, [("3", "2", 0.9), ("3", "3", 1.0)])
    assert {r[0]: r[1] for r in resolve.resolve(own).collect()} == {"2": "3"}


def test_writes(spark):
    done = edge_frame(spark, [("b", "a", 0.9), ("c", "a", 0.9), ("d", "a", 0.9)])
    stored = edge_frame(spark, [("c", "a", 0.9), ("d", "x", 0.9), ("a", "q", 0.8)])
    new = spark.createDataFrame([("b",), ("z",)], "id string")
    due = sync.assignments_requiring_write(done, stored, new)
    assert {r[0] for r in due.collect()} == {"b", "d"}
    parents = spark.createDataFrame([("c",)], "id string")
    assert rows(sync.child_marks(done, new, parents)) == [("b",), ("c",)]
    assert rows(sync.parent_marks(done, new, stored)) == [("a",), ("z",)]
    after = sync.upsert_dupes(stored, due, spark.createDataFrame([("a",)], "id string"))
    assert [r[:2] for r in rows(after)] == [("b", "a"), ("c", "a"), ("d", "a")]
    with pytest.raises(sync.AmbiguousAssignment):
        sync.check_single_parent(edge_frame(spark, [("a", "b", 1), ("a", "c", 1)]))
    docs = spark.createDataFrame([("a", None), ("b", True), ("c", False), ("e", None)], "id string, is_parent boolean")
    marked = sync.mark_states(docs, spark.createDataFrame([("a",), ("c",)], "id string"), spark.createDataFrame([("b",), ("c",)], "id string"))
    assert rows(marked.select("id", "is_parent", "changed")) == [("a", True, True), ("b", False, True), ("c", False, False), ("e", None, False)]
    assert [r[0] for r in sync.rows_after(done, 2).collect()] == ["d"]
    progress = sync.SyncProgress(spark, new_path(spark, "progress"))
    assert not progress.in_progress
    progress.set("marking_parents", done=3)
    assert progress.in_progress and progress.get()["done"] == 3
    progress.set("completed")
    assert progress.completed


# --- clusters ------------------------------------------------------------------------------------


def test_pathological_clusters(spark):
    same = [(f"a{i}", list(range(128)), 600) for i in range(6)]
    # twelve of sixteen bands in common with the others only
    odd = [("b0", list(range(96)) + [1000 + i for i in range(32)], 600)]
    alone = [(f"c{i}", [10_000 * (i + 1) + k for k in range(128)], 600) for i in range(5)]
    signed = spark.createDataFrame(same + odd + alone, "id string, sig array<bigint>, content_len bigint")
    found = pathological_clusters(signed, 5, 14)
    assert {r["id"] for r in found.collect()} == {f"a{i}" for i in range(6)} | set()
    assert {(r[0], r[1], r[2]) for r in star_edges(found).collect()} == {(f"a{i}", "a0", 0.99) for i in range(1, 6)}
    assert cluster_report(found).first()["to_delete"] == 5
    docs = spark.createDataFrame([(r[0], None) for r in same + odd], "id string, is_parent boolean")
    assert clean(docs, found, CleanupAction.parse("Delete")).count() == 2
    marked = clean(docs, found, CleanupAction.parse("mark_parent")).where("is_parent").collect()
    assert [r["id"] for r in marked] == ["a0"]
    assert clean(docs, found, CleanupAction.REPORT).count() == 7
    with pytest.raises(ValueError):
        CleanupAction.parse("no")


def test_clusters_of_more_buckets_than_the_report_lists(spark):
    """800 pairs of copies make 12,800 buckets."""
    data = [(f"d{i:03}{side}", [1000 * i + k for k in range(128)], 600) for i in range(800) for side in "ab"]
    signed = spark.createDataFrame(data, "id string, sig array<bigint>, content_len bigint")
    found = pathological_clusters(signed, 2, 14)
    assert rows(found.select("id").distinct()) == [(r[0],) for r in data]
    assert cluster_report(found).first()["clusters"] == 800


def test_first_apart(spark):
    rng = random.Random(3)
    size = {f"s{i:02}": rng.randrange(3) for i in range(40)}
    near = {tuple(rng.sample(sorted(size), 2)) for _ in range(45)}
    near |= {(b, a) for a, b in near}
    kept = []
    for name in sorted(size, key=lambda s: (-size[s], s)):
        if not any((name, k) in near for k in kept):
            kept.append(name)
    links = spark.createDataFrame([(a, size[a], b, size[b]) for a, b in near], "x string, nx long, y string, ny long")
    got = rows(first_apart(spark.createDataFrame(list(size.items()), "start string, n long"), links))
    assert got == [(k,) for k in sorted(kept)]


def test_members_must_be_in_all_bands(spark):
    """Every band leaves out other members: no set of 18 remains in all 16 bands."""
    data = []
    for i in range(20):
        sig = [-1 - i * 1000 - k if k // 8 == i % 16 and k // 8 > 0 else k for k in range(128)]
        data.append((f"d{i:02}", sig, 600))
    signed = spark.createDataFrame(data, "id string, sig array<bigint>, content_len bigint")
    assert pathological_clusters(signed, 18, 16).count() == 0


# --- changes -------------------------------------------------------------------------------------

FEED = "feed_no long, id string, change_kind string, row_version int, run_id string, extra string"
LOG = "run_id string, attempt int, run_status string, finished_at timestamp"


def brute_pending(feed, log):
    last = {}
    for run, attempt, status, _ in log:
        if run not in last or attempt >= last[run][0]:
            last[run] = (attempt, status.lower())
    good = {r for r, (_, s) in last.items() if s == "succeeded"}
    new, judged = {}, set()
    for _, i, kind, version, run, _ in feed:
        if i is None or kind is None or version is None:
            continue
        if kind.lower() == "mark":
            judged |= {(i, version)} if run in good else set()
        elif kind.lower() in ("insert", "update", "delete") and (i not in new or version >= new[i][0]):
            new[i] = (version, kind.lower())
    return sorted((i,) for i, (v, k) in new.items() if k != "delete" and (i, v) not in judged)


def random_feed(rng, n):
    feed, versions = [], {}
    for k in range(1, n + 1):
        i = f"d{rng.randrange(12)}"
        kind = rng.choice(["insert", "UPDATE", "delete", "mark", "Mark", "update"])
        if kind.lower() == "mark":
            feed.append((k, i, kind, rng.randrange(1, 5), rng.choice([None, "r1", "r2", "r3"]), "x"))
        else:
            v = versions[i] = versions.get(i, 0) + 1
            feed.append((k, i, kind, v, None, "x"))
    again = [(n + 1 + j, *rng.choice(feed)[1:]) for j in range(10)]  # delivered again, late
    return feed + again


@pytest.mark.parametrize("seed", range(3))
def test_changes_in_runs_with_crashes(spark, seed):
    rng = random.Random(seed)
    feed = random_feed(rng, 60) + [(200, None, "insert", 1, None, None), (201, "e", None, 1, None, None), (202, "f", "insert", None, None, None)]
    log = [("r1", 1, "failed", None), ("r1", 2, "Succeeded", None), ("r2", 1, "succeeded", None), ("r2", 2, "crashed", None), ("r2", 2, "crashed", None)]
    run_log = spark.createDataFrame(log, LOG)
    folder = new_path(spark, "changes")
    runner = changes.ChangeProcessor(spark, folder, "feed_no")
    seen = []

    def fold(batch, state):
        seen.append({r["feed_no"] for r in batch.select("feed_no").collect()})
        return changes.fold_changes(batch, state)

    emit = lambda s, _: changes.pending(s, changes.succeeded_runs(run_log))

    def crash(state, _):
        raise RuntimeError("lost")

    for upto in (20, 45, 300):
        now = spark.createDataFrame([f for f in feed if f[0] <= upto], FEED)
        before = runner.last()
        with pytest.raises(RuntimeError):
            runner.run(now, fold, crash)
        assert runner.last() == before  # nothing of the lost run counts
        runner.run(now, fold, emit)
        assert rows(runner.output()) == brute_pending([f for f in feed if f[0] <= upto], log)
    good = seen[1::2]
    assert sum(map(len, good)) == len({f[0] for f in feed}) == len(set().union(*good))  # none skipped, none twice
    # a run without news folds nothing and commits the same result
    runner.run(now, fold, emit)
    assert len(seen) == 6 and rows(runner.output()) == brute_pending(feed, log)


def test_changes_conflict_and_empty(spark):
    empty = spark.createDataFrame([], FEED)
    runner = changes.ChangeProcessor(spark, new_path(spark, "changes"), "feed_no")
    runs = changes.succeeded_runs(spark.createDataFrame([], LOG))
    done = runner.run(empty, changes.fold_changes, changes.pending, runs)
    assert done.watermark is None and runner.output().count() == 0
    with pytest.raises(changes.CommitConflict):
        runner.commit(done)
    # the first numbers may be 0 or negative; a null one is refused, not skipped
    feed = [(-1, "a", "insert", 1, None, None), (0, "b", "insert", 1, None, None), (1, "c", "insert", 1, None, None)]
    assert runner.run(spark.createDataFrame(feed, FEED), changes.fold_changes, changes.pending, runs).watermark == 1
    assert rows(runner.output()) == [("a",), ("b",), ("c",)]
    with pytest.raises(changes.NoSequence):
        runner.run(spark.createDataFrame([(None, "d", "insert", 1, None, None)], FEED), changes.fold_changes, changes.pending, runs)


def test_changes_touch_only_their_buckets(spark):
    feed = [(k, f"d{k}", "insert", 1, None, None) for k in range(200)] + [(200, "d7", "mark", 1, "r1", None)]
    folder = new_path(spark, "changes")
    runner = changes.ChangeProcessor(spark, folder, "feed_no", buckets=16)
    run = lambda feed, log: runner.run(
        spark.createDataFrame(feed, FEED), changes.fold_changes, changes.pending,
        changes.succeeded_runs(spark.createDataFrame(log, LOG)), changes.outcome_changes,
    )
    first = run(feed, [])
    assert len(set(first.states.values())) == 1 and runner.output().count() == 200
    second = run([*feed, (201, "d9", "delete", 2, None, None)], [])
    moved = [b for b in second.states if second.states[b] != first.states[b]]
    assert len(moved) == 1 and [b for b in second.outputs if second.outputs[b] != first.outputs[b]] == moved
    assert runner.output().count() == 199 and runner.state().count() == 201
    # a run's end turns the output of marked ids without any new row; state stays
    third = run([*feed, (201, "d9", "delete", 2, None, None)], [("r1", 1, "succeeded", None)])
    assert third.states == second.states and sum(third.outputs[b] != second.outputs[b] for b in third.outputs) == 1
    assert rows(runner.output()) == sorted((f"d{k}",) for k in range(200) if k not in (7, 9))
    # what the last two commits don't name is gone
    assert set(names_in(spark, f"{folder}/data")) == second.folders() | third.folders()


# --- skew ----------------------------------------------------------------------------------------


def test_bucket_results(spark):
    rng = random.Random(3)
    data = [("hot", [f"i{rng.randrange(900)}" for _ in range(rng.randrange(8))], "x") for _ in range(400)]
    data += [(f"k{rng.randrange(60)}", [f"i{rng.randrange(30)}", None, "i1"], "x") for _ in range(300)]
    data += [(None, ["a"], "x"), ("nulls", [None, None], "x"), ("none", None, "x"), ("empty", [], "x")]
    data += data[:50]
    want = {}
    for k, ids, _ in data:
        for i in ids or []:
            if k is not None and i is not None:
                want.setdefault(k, set()).add(i)
    df = spark.createDataFrame(data, "bucket_key string, doc_ids array<string>, _task string")
    got = rows(skew.bucket_results(df, 6))
    assert got == sorted((k, len(v), min(v)) for k, v in want.items())
    assert skew.bucket_results(df.limit(0)).count() == 0


def test_hot_keys_are_cut_and_packed(spark):
    df = spark.range(10_000).select(F.when(F.col("id") < 6000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"))
    plan = skew.plan_shards(df, "key", F.lit(1), 8)
    assert len(plan.hot_keys["hot"]) >= 19 and len(set(plan.hot_keys["hot"])) == 8
    placed = skew.place(df.withColumn("m", F.rand(1)), plan, F.col("m"))
    loads = [r["n"] for r in placed.groupBy("_task").agg(F.count("*").alias("n")).collect()]
    assert max(loads) < 2 * 10_000 / 8


def test_fragment_replicate_join(spark):
    left = spark.createDataFrame([("h", i) for i in range(300)] + [(f"k{i}", i) for i in range(40)] + [(None, 1)], "key string, a int")
    right = spark.createDataFrame([("h", 1), ("h", 2), ("k1", 3), ("q", 4), (None, 5)], "key string, b int")
    got = skew.fragment_replicate_join(left, right, "key", F.col("a"), tasks=5)
    assert rows(got.select("key", "a", "b")) == rows(left.join(right, "key"))


def test_hot_keys_of_a_self_join_are_split(spark):
    rows_ = spark.createDataFrame([("hot", k) for k in range(300)] + [(f"k{k % 40}", k) for k in range(80)] + [(None, 1)], "key string, n int")
    hot = skew.hot_keys(rows_, "key", most=50)
    assert rows(hot) == [("hot", 6)]
    assert skew.hot_keys(rows_, "key", most=5000) is None
    left, right = rows_.withColumnRenamed("n", "a"), rows_.withColumnRenamed("n", "b")
    got = skew.pairs_within(left, right, "key", F.col("a"), hot)
    assert got.columns == ["key", "a", "b"] and got.where("a < b").count() == 300 * 299 // 2 + 40


def test_wrong_counts(spark):
    segments = [("a", ["x", "y", None], 2), ("a", ["y", "z", "z"], 3), ("b", ["x"], None), ("c", None, 0), ("d", [], 0), (None, ["q"], 1), ("c", ["w"], 1)]
    frame = spark.createDataFrame(segments, "bucket_key string, doc_ids array<string>, doc_count int")
    assert rows(skew.wrong_counts(frame, tasks=3)) == [("a", 3, 2, 1), ("b", 1, 1, 1), ("c", 1, 2, 0)]
    assert skew.wrong_counts(frame.limit(0)).count() == 0
