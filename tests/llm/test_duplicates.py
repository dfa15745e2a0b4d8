"""Near duplicates, chunk index, groups, formatting copies and survivors against brute force."""

import datetime
import random
import time
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows, union_find
from twinsieve.functions.grams import gram_set
from twinsieve.llm import chunks, consolidate, formatting, grams, neardup, survivor
from twinsieve.runtime import names_in, new_path

CORPUS = (
    "id string, content string, content_len int, filename string, is_parent boolean, loaded_at timestamp, "
    "key string, plain string, no bigint, total int"
)


def plain(t):
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t.lower()).split())


def prose(rng, n=130):
    return " ".join("".join(rng.choice("abcdefghij klmnopqrstuvwxyz").strip() or "q" for _ in range(rng.randrange(3, 9))) for _ in range(n))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], [words[k], "inserted"], ["changed"]])
    return " ".join(words)


def corpus(spark, data):
    """data: (id, content, is_parent); the other columns clash with names used inside."""
    return spark.createDataFrame([(i, c, None, None, p, None, "k", "p", 1, 2) for i, c, p in data], CORPUS)


def sample(seed=1):
    rng = random.Random(seed)
    data, n = [], 0
    for _ in range(25):
        base = prose(rng)
        for edits in (0, 0, 2, 6, 15, 40):
            state = rng.choice([None, True, False])
            text = edited(rng, base, edits)
            data.append((f"d{n:03}", rng.choice([str, str.upper])(text), state))
            n += 1
    moved = data[0][1].split()
    data.append(("moved", " ".join(moved[60:] + moved[:60]), True))
    data += [("nul", None, None), ("empty", "", True), ("short", "x" * 499, None), ("short2", "x" * 499, True)]
    data += [("edge", "é" * 250, True), ("edge2", "É" * 250 + "!", None), ("edge3", "É" * 250 + "?!", True)]
    data += [("signs1", "!" * 600, True), ("signs2", "!" * 600, None), ("signs3", "?" * 600, None)]
    data += [("long1", data[0][1] * 400, None), ("long2", data[0][1] * 399, True), (None, data[0][1], True)]
    return data


def brute_pairs(data):
    kept = [(i, c, p, gram_set(plain(c))) for i, c, p in data if i is not None and c is not None and len(c.encode()) > 500]
    out = set()
    for x in range(len(kept)):
        for y in range(x):
            a, b = kept[x], kept[y]
            if a[1] == b[1] or grams.jaccard(a[3], b[3]) >= 0.8:
                out.add((*sorted((a[0], b[0])), a[2], b[2]))
    return out


def test_near_duplicate_pairs(spark):
    data = sample()
    want = {(a, b) for a, b, _, _ in brute_pairs(data)}
    got = rows(neardup.near_duplicate_pairs(corpus(spark, data)))
    assert len(got) == len(set(got)) and set(got) == want
    assert ("signs1", "signs2") in want and ("edge2", "edge3") in want and not any("edge" in p and "signs" in p for p in want)


def test_near_duplicate_groups(spark):
    data = sample(2)
    pairs = brute_pairs(data)
    ids = [(i, i) for i, c, _ in data if i is not None and c is not None and len(c.encode()) > 500]
    want = union_find([(a, b) for a, b, _, _ in pairs] + ids)
    got = rows(neardup.near_duplicate_groups(corpus(spark, data)))
    assert {(i, g) for i, g, _ in got} == set(want.items()) and len(got) == len(want)
    assert {i for i, _, n in got if n == 0} >= {"signs1", "signs2", "signs3"}


def test_many_copies_of_one_text(spark):
    """Copies are one class: neither links nor groups expand them."""
    text = prose(random.Random(12))
    docs = spark.range(100_000).select(F.format_string("d%06d", "id").alias("id"), F.lit(text).alias("content"))
    near = edited(random.Random(13), text, 2)
    docs = docs.union(spark.createDataFrame([("e", near), ("f", near)], "id string, content string"))
    members, links = neardup.near_duplicates(docs)
    assert members.count() == 100_002 and links.count() == 1
    found = neardup.near_duplicate_groups(docs).groupBy("group_id", "n_links").count()
    assert rows(found) == [("d000000", 1, 100_002)]


def alike(rng, n):
    """Texts of one small vocabulary: more than a third similar by chance, none near."""
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(150)]
    return [" ".join(rng.choice(words) for _ in range(130)) for _ in range(n)]


def shuffled(spark):
    """Records that each stage wrote to shuffles, and the shuffle files that are there."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = context.statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    written = {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}
    files = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return written, {n for k in range(files.size()) if (n := files.apply(k).getName()).startswith("shuffle")}


def test_pairs_alike_by_chance_are_not_written(spark):
    """What shares a band by chance grows with the square of the texts; it ends in the task that meets it."""
    texts = alike(random.Random(21), 2400)
    docs = spark.createDataFrame([(f"d{k:04}", t) for k, t in enumerate(texts)], "id string, content string")
    before = shuffled(spark)
    members, links = neardup.near_duplicates(docs)
    assert links.count() == 0 and members.count() == 2400
    after = shuffled(spark)
    written = sum(n for stage, n in after[0].items() if stage not in before[0])
    assert neardup.BANDS * 2400 <= written < 1.5 * neardup.BANDS * 2400  # the bands of a text and a few rows more


def test_shuffle_files_go_with_the_steps(spark):
    docs = corpus(spark, sample(22)[:60])
    before = shuffled(spark)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(name)
    neardup.near_duplicates(docs)
    after = shuffled(spark)
    assert sum(after[0][s] for s in set(after[0]) - set(before[0])) > 0
    assert spark.conf.get(name) == kept
    for _ in range(20):  # executors remove them a little later
        if not (left := shuffled(spark)[1] - before[1]):
            break
        time.sleep(0.5)
    assert not left


def test_candidates_of_rounds_and_hot_keys(spark, monkeypatch):
    """Parts of the bands, and keys cut into shards, give the pairs that the bands give at once."""
    rng = random.Random(23)
    base = prose(rng)
    data = [(f"h{k:02}", edited(rng, base, rng.randrange(1, 6)), None) for k in range(40)] + sample(24)
    classes = neardup.sign_classes(grams.comparable(corpus(spark, data)))
    whole = rows(neardup.candidates(classes.df))
    assert len(whole) == len(set(whole)) > 500 and all(a < b for a, b in whole)
    assert rows(neardup.candidates(classes.df, rounds=5)) == whole
    monkeypatch.setattr(neardup, "HOT_ROWS", 7)
    monkeypatch.setattr(neardup, "HOT_SAMPLE", 1)
    assert rows(neardup.candidates(classes.df)) == whole
    near = {tuple(r)[:2] for r in neardup.class_pairs(classes).collect()}
    assert near <= set(whole)


def test_runs_go_on_over_batches():
    """Keys of many rows that several Arrow batches hold, against all pairs of each key."""
    rng = np.random.default_rng(25)
    n = 600
    band = np.sort(rng.choice([1, 2, 3, 9, 9, 9], n)).astype(np.int64)
    size = rng.integers(80, 120, n).astype(np.int32)
    order = np.lexsort([size, band])
    band, size = band[order], size[order]
    flips = rng.random((n, 256)) < rng.choice([0.02, 0.2], (n, 1))
    bits = (rng.random(256) < 0.5)[None, :] ^ flips
    words = np.packbits(bits, axis=1).view(np.int64)
    table = pa.table({"band": band, "no": rng.permutation(n).astype(np.int64), "grams": size, **{f"w{k}": words[:, k] for k in range(4)}})
    no, most = table["no"].to_numpy(), 25 + neardup.CARRIED_SLACK
    want = {
        (int(min(no[x], no[y])), int(max(no[x], no[y])))
        for x in range(n)
        for y in range(x)
        if band[x] == band[y] and min(size[x], size[y]) >= 0.8 * max(size[x], size[y]) and (bits[x] ^ bits[y]).sum() <= most
    }
    for step in (1, 7, 100, n):
        got = [r for b in neardup._bucket_pairs(iter(table.to_batches(step)), ["band"], 0.8) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_accepted_duplicates(spark):
    data = sample(3)
    want = {(a, b) for a, b, p, q in brute_pairs(data) if {p, q} == {None, True}}
    got = rows(chunks.accepted_duplicates(corpus(spark, data)))
    assert len(got) == len(set(got)) and set(got) == want and want


def test_accepted_duplicates_of_shuffled_clauses(spark):
    """Short clauses that change places leave the similarity above 0.8 and hardly a chunk whole."""
    rng = random.Random(11)
    data = []
    for n in range(100):
        clauses = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(9)) for _ in range(20)]
        data.append((f"o{n:02}", " ".join(clauses), True))
        rng.shuffle(clauses)
        data.append((f"n{n:02}", " ".join(clauses), None))
    want = {(a, b) for a, b, p, q in brute_pairs(data) if {p, q} == {None, True}}
    got = rows(chunks.accepted_duplicates(corpus(spark, data)))
    assert len(want) == 100 and len(got) == len(set(got)) and set(got) == want


def test_sketches_follow_the_similarity():
    rng = random.Random(6)
    text = prose(rng)
    for edits in (0, 3, 30, 130):
        a, b = gram_set(text), gram_set(edited(rng, text, edits))
        x, y = chunks.sketch([a, b])
        used = (x != chunks.EMPTY) | (y != chunks.EMPTY)
        assert abs((x == y)[used].mean() - grams.jaccard(a, b)) < 0.12
        keys, held = chunks.sketch_bands(np.stack([x, y]))
        assert edits or (keys[0] == keys[1]).all() and held.all()
    # a text of one sequence fills few bands, the empty one none
    _, held = chunks.sketch_bands(chunks.sketch([gram_set("aaaa"), gram_set("")]))
    assert 1 <= held[0].sum() <= chunks.FUNCTIONS and not held[1].any()


def test_empty_tables(spark):
    none = corpus(spark, [])
    for f in (neardup.near_duplicate_pairs, neardup.near_duplicate_groups, chunks.accepted_duplicates, formatting.formatting_copies, formatting.formatting_counts):
        assert f(none).count() == 0
    dupes = spark.createDataFrame([], "child_id string, parent_id string")
    assert consolidate.match_groups(dupes).count() == 0
    assert survivor.survivors(dupes, none).count() == 0


def test_chunk_index_grows_by_batches(spark):
    rng = random.Random(8)
    texts = [prose(rng) for _ in range(12)]
    frame = lambda part: chunks.distinct_texts(grams.comparable(corpus(spark, part)))
    folder = new_path(spark, "index")
    index = chunks.ChunkIndex(spark, folder, slots=4)
    new = frame([("n", edited(rng, texts[3], 3), None), ("m", edited(rng, texts[9], 3), None), ("s", texts[2], None), ("q", "?!" * 300, None)])
    assert index.probe(new).count() == 0
    index.append("b1", frame([(str(i), t, True) for i, t in enumerate(texts[:6])]))
    assert index.probe(new).count() == 2  # the edited and the same text
    index.append("b2", frame([(str(i), t, True) for i, t in enumerate([*texts[4:], "?!" * 300])]))
    index.append("b2", frame([(str(i), t, True) for i, t in enumerate([*texts[4:], "?!" * 300])]))  # again
    assert index.probe(new).count() == 4 and index.batches() == ["b1", "b2"]
    assert index._read("records").count() == 13  # texts that were there are not kept twice
    before = rows(index.probe(new))
    index.compact("all")
    assert chunks.ChunkIndex(spark, folder).slots == 4 and index.batches() == ["all"]
    assert rows(index.probe(new)) == before and len(names_in(spark, f"{folder}/data")) == 1


def test_a_failed_append_leaves_the_index_as_it_was(spark, monkeypatch):
    rng = random.Random(9)
    texts = [prose(rng) for _ in range(3)]
    frame = lambda part: chunks.distinct_texts(grams.comparable(corpus(spark, part)))
    folder = new_path(spark, "index")
    index = chunks.ChunkIndex(spark, folder, slots=2)
    index.append("b1", frame([("1", texts[0], True)]))
    with monkeypatch.context() as m:
        m.setattr(chunks.Ledger, "add", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.append("b1", frame([("2", texts[1], True)]))
    assert index.probe(frame([("n", texts[0], None), ("m", texts[1], None)])).count() == 1
    # a checked batch is accepted, but for what had a partner
    near = chunks.check_batch(index, "b2", grams.comparable(corpus(spark, [("n", edited(rng, texts[0], 2), None), ("m", texts[2], None)])))
    assert near.count() == 1 and index._read("records").count() == 2


def test_hot_chunks_are_split(spark, monkeypatch):
    """A passage that most records hold is split over shards and loses nothing."""
    monkeypatch.setattr(chunks, "HOT_ROWS", 5)
    rng = random.Random(10)
    shared = prose(rng, 120)
    data = [(f"o{k:02}", shared + " " + prose(rng, 12), True) for k in range(30)] + [(f"n{k}", shared + " " + prose(rng, 12), None) for k in range(4)]
    want = {(a, b) for a, b, p, q in brute_pairs(data) if {p, q} == {None, True}}
    got = rows(chunks.accepted_duplicates(corpus(spark, data)))
    assert set(got) == want and len(want) == 120


def test_chunks_cover_the_text_and_survive_edits():
    rng = random.Random(4)
    text = prose(rng, 300)
    low = (1 << chunks.LENGTH_BITS) - 1
    whole = chunks.chunk_numbers(text)
    assert sum(int(x) & low for x in whole) <= len(text.encode())
    other = chunks.chunk_numbers(text[:700] + "inserted words " + text[700:])
    shared = set(whole.tolist()) & set(other.tolist())
    assert sum(x & low for x in shared) > 0.9 * len(text)
    assert len(chunks.chunk_numbers("")) == 0
    flat = chunks.chunk_numbers("a" * 10_000)  # no boundary but the longest chunk
    assert all((int(x) & low) <= chunks.LONGEST for x in flat)


def test_minima_estimate_similarity():
    rng = random.Random(5)
    a, b = prose(rng), None
    b = edited(rng, a, 6)
    m = neardup.minima([gram_set(a), gram_set(b)], 504)
    exact = grams.jaccard(gram_set(a), gram_set(b))
    assert abs(float(np.mean(m[0] == m[1])) - exact) < 0.08
    bits = neardup.bit_words(m).view(np.uint64)
    differing = sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(*bits))
    assert abs(differing / 504 - (1 - exact) / 2) < 0.08
    keys = neardup.band_keys(m)
    assert keys.shape == (2, neardup.BANDS) and len(set(keys[0].tolist())) == neardup.BANDS


# --- groups --------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_match_groups(spark, seed):
    rng = random.Random(seed)
    name = lambda: f"{rng.randrange(60):03x}"
    pairs = [(name(), name()) for _ in range(45)] + [("hub", f"leaf{i}") for i in range(50)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)]
    dirty = [(rng.choice([a, a.upper(), f" {a} "]), rng.choice([b, f"\t{b}"])) for a, b in pairs]
    dirty += [("self", "SELF "), (None, "x"), ("y", None), ("  ", "z"), dirty[0], dirty[0][::-1]]
    got = rows(consolidate.match_groups(spark.createDataFrame(dirty, "child_id string, parent_id string")))
    assert dict(got) == union_find([*pairs, ("self", "self")]) and len(got) == len(dict(got))


# --- formatting ----------------------------------------------------------------------------------

FIELDS = {"Name": "Anna Berg", "Place": "Köln", "No.": "17-b", "note": "paid: in full"}


def test_formatting_copies(spark):
    record = "\n".join(f"{k}: {v}" for k, v in FIELDS.items())
    turned = " | ".join(f"{k.upper()} :{v.lower()}" for k, v in reversed(FIELDS.items()))
    data = [
        ("b", record), ("a", turned), ("c", record), ("c", record), ("d", "; ".join(f"{k}:\t{v}" for k, v in FIELDS.items())),
        ("e", record.replace("Köln", "Koln")), ("f", "\n".join(record.split("\n")[:3])), ("g", "\n".join(reversed(record.split("\n")[:3]))),
        ("h", "One two; THREE"), ("i", "one  two three!"), ("j", "two one three"), ("k", None), ("l", ""), ("m", "?!"), ("n", "?!"),
        (None, record), ("o", "x" * 200_000), ("p", "X" * 200_000 + "."),
    ]
    df = corpus(spark, [(i, c, None) for i, c in data])
    assert rows(formatting.formatting_copies(df)) == [("a", "b"), ("a", "c"), ("a", "d"), ("h", "i"), ("o", "p")]
    counts = dict(rows(formatting.formatting_counts(df)))
    assert counts["a"] == 5 and counts["h"] == 2 and counts["e"] == 1 and sum(counts.values()) == 13


def test_names_of_fields(spark):
    """A name may be long; lines of prose that hold a colon are no fields."""
    long = {"n" * 200: "1", "Place": "Köln", "v1.2": "x", "No.": "7"}
    prose_ = ["Item 4: it was said. Item 5: it was not", "Well, it was counted. Item 20: the ticket", "Action: do it", "Item 7,663,002: none"]
    texts = [
        ("a", "\n".join(f"{k}: {v}" for k, v in long.items())),
        ("b", "; ".join(f"{k.upper()} : {v}" for k, v in reversed(long.items()))),
        ("c", "\n".join(prose_)),
        ("d", " ".join(prose_).upper()),
        ("e", "\n".join(reversed(prose_))),
        ("f", ("w" * 9 + " ") * 20_000 + ": 1"),  # one very long name
    ]
    found = formatting.formatting_copies(spark.createDataFrame(texts, "id string, content string"))
    assert rows(found) == [("a", "b"), ("c", "d")]


def test_repeated_fields_count(spark):
    a = "x: 1\nx: 1\ny: 2\nz: 3"
    b = "x: 1\ny: 2\ny: 2\nz: 3"
    assert rows(formatting.formatting_copies(corpus(spark, [("1", a, None), ("2", b, None)]))) == []


# --- survivors -----------------------------------------------------------------------------------


def test_survivors(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    docs = [
        ("a", "short", "n.txt", None, t(1)), ("b", "the longest of all", None, False, t(9)), ("c", "trusted", "x.html", True, t(2)),
        ("d", "trusted", "y.HTM", True, None), ("e", None, "no ending", None, None), ("f", None, "z.", None, None),
        ("g", "alone", "g.txt", True, t(1)), ("h", "ab", "-", None, t(3)), ("i", "a😀", "k.tar.gz", None, t(4)),
    ]
    frame = spark.createDataFrame(docs, "id string, content string, filename string, is_parent boolean, loaded_at timestamp").selectExpr("*", "1 group_id", "2 rank")
    links = [("a", "b"), ("B", "c "), ("d", "c"), ("e", "f"), ("g", "g"), ("i", "h"), ("q", "r"), ("s", None)]
    got = rows(survivor.survivors(spark.createDataFrame(links, "child_id string, parent_id string"), frame))
    assert got == [
        ("a", "content", "c"), ("a", "filename", "c"), ("e", "content", "e"), ("h", "content", "i"), ("h", "filename", "i"),
    ]
    groups = consolidate.match_groups(spark.createDataFrame(links, "child_id string, parent_id string")).withColumn("rank", F.lit(1))
    assert rows(survivor.survivors(None, frame, groups)) == got
    built = rows(survivor.surviving_records(spark.createDataFrame(links, "child_id string, parent_id string"), frame))
    assert built == [("a", "trusted", "x.html"), ("e", None, None), ("h", "a😀", "k.tar.gz")]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_gram_sets_match_plain_python(text):
    want = {text[i : i + 3] for i in range(len(text) - 2)} if len(text) > 2 else {text} - {""}
    assert len(gram_set(text)) == len(want)
