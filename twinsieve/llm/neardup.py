"""Near-duplicate records: many universal hash minima with banding, signature verification, exact
check, and connected components by alternating large-star and small-star.

Equal plain texts are collapsed first; all further work is on one class per distinct text. A class gets
``BANDS * ROWS`` minima of its 3-character sequences under multiply-shift universal hash functions.
Each band of minima becomes one 64-bit key; classes that share a key are candidates. The lowest bit
of every minimum makes a one-bit signature, whose differing bits estimate the similarity; candidates
far below the threshold are dropped by it, and the rest are compared exactly.

A pair of similarity s is missed with probability (1 - s^ROWS)^BANDS: 8e-9 at 0.81, 3e-12 at 0.85. Keys that many
classes share are split over tasks.

Texts of one language are about 0.3 similar by chance, so pairs that share a key grow with the square of the
texts. Rows of a band therefore hold half of the signature and the number of sequences, and pairs that these exclude end
where they are met; only the others are written. Large tables take the bands in ``ROUNDS`` parts and candidates in slices of as
many pairs as there are texts. Shuffle files go as each step ends and tables once nothing reads them, so disk
is a few times the text, whatever the number of bands and candidates.

The operator's result is :func:`near_duplicates`: links between different texts, and the class of every document.
:func:`near_duplicate_pairs` expands it to pairs of documents, which for n copies of a text are n (n - 1) / 2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.grams import gram_set
from twinsieve.llm.grams import SIMILAR, comparable, exact_pairs
from twinsieve.operators.graph import connected_components
from twinsieve.operators.skew import HOT_ROWS, hot_keys, pairs_within
from twinsieve.runtime import Written, materialize, shuffles_dropped, write_out

BANDS, ROWS, SEED = 72, 7, 20240229
WORDS = 8  # 64-bit words of the one-bit signature; 512 bits hold the 504 minima
#: Differing bits of 504 at similarity s are about 252 (1 - s) with a deviation of at most 7 at 0.8.
SLACK_BITS = 36
#: Words that the rows of a band hold. About 128 (1 - s) of their 256 bits differ; more than this slack above those
#: at 0.8 with probability 1e-9 at 0.8 and 1e-10 at 0.81.
CARRIED, CARRIED_SLACK = 4, 33
#: Parts in which the bands are taken, by rows of bands that there are at most, and pairs that a task holds before it passes them on.
ROUNDS, HELD_PAIRS = ((1_000_000, 1), (20_000_000, 4), (math.inf, 8)), 200_000
#: One class in so many is counted to find hot keys.
HOT_SAMPLE = 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, n, dtype=np.uint64)


#: Bytes of the table of hash values that is held at a time, and sequences of a text taken together.
TABLE_BYTES, PIECE = 48_000_000, 4096


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """``len(sets) x n`` minima; no set may be empty.

    Each distinct sequence of the batch is hashed once, a row of values; a text's minima are those of its
    rows. The functions are taken in blocks that keep the table small whatever the texts.
    """
    all_grams, where = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    mixed = _mix(all_grams)
    functions = list(zip(*_functions(n)))
    out = np.empty((len(sets), n), np.uint32)
    step = min(n, max(16, TABLE_BYTES // (4 * len(all_grams))))
    for at in range(0, n, step):
        block = functions[at : at + step]
        table = np.empty((len(all_grams), len(block)), np.uint32)
        for k, (a, b) in enumerate(block):
            table[:, k] = (mixed * a + b) >> np.uint64(32)
        for i, end in enumerate(ends):
            start = end - len(sets[i])
            low = table[where[start : min(end, start + PIECE)]].min(axis=0)
            for more in range(start + PIECE, end, PIECE):
                low = np.minimum(low, table[where[more : min(end, more + PIECE)]].min(axis=0))
            out[i, at : at + len(block)] = low
    return out


def band_keys(minima_: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, which holds the band's number too."""
    cut = minima_.reshape(len(minima_), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), cut.shape[:2])
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, r])
    return key.view(np.int64)


def bit_words(minima_: np.ndarray) -> np.ndarray:
    bits = np.zeros((len(minima_), WORDS * 64), np.uint8)
    bits[:, : minima_.shape[1]] = minima_ & 1
    return np.packbits(bits, axis=1).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            sets = [gram_set(t) for t in batch.column("plain").to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            if not some:
                continue
            mins = minima([sets[i] for i in some], BANDS * ROWS)
            kept = batch.take(pa.array(some))
            keys, words = band_keys(mins), bit_words(mins)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [
                    kept.column("key"), kept.column("plain"), pa.array([len(sets[i]) for i in some], pa.int32()), lists,
                    *(pa.array(words[:, i]) for i in range(WORDS)),
                ],
                names=["key", "plain", "grams", "bands", *(f"w{i}" for i in range(WORDS))],
            )


def sign_classes(docs: DataFrame) -> Written:
    """``no, key, plain, grams, bands, w0..w7`` of the distinct plain texts. ``docs`` is from ``comparable``."""
    distinct = docs.groupBy("key").agg(F.first("plain").alias("plain"))
    schema = "key binary, plain string, grams int, bands array<bigint>, " + ", ".join(f"w{i} bigint" for i in range(WORDS))
    signed = distinct.mapInArrow(_sign, schema)
    return write_out(signed.withColumn("no", F.monotonically_increasing_id()), "classes")


def differing_bits() -> Column:
    total = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0")))
    for i in range(1, WORDS):
        total = total + F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}")))
    return total


def _near_in_runs(rows: dict[str, np.ndarray], by: list[str], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of the rows of one key that size and carried words allow. Rows are sorted by key, then by size, so a row
    meets the rows after it until one is too large; each step takes one such meeting of all rows at once."""
    most = int(64 * CARRIED * (1 - threshold) / 2) + CARRIED_SLACK
    no, grams, mine = rows["no"], rows["grams"], rows.get("mine")
    words = [rows[f"w{i}"].view(np.uint64) for i in range(CARRIED)]
    starts = np.flatnonzero(np.append(True, _key_changes(rows, by)))
    ends = np.repeat(np.append(starts[1:], len(no)), np.diff(np.append(starts, len(no))))
    i, step, found, held = np.arange(len(no)), 0, [], 0

    def batch() -> pa.RecordBatch:
        x, y = (np.concatenate(part) for part in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    while True:
        step += 1
        i = i[i + step < ends[i]]
        i = i[grams[i] >= threshold * grams[i + step] - 1e-6]
        if not len(i):
            break
        j = i + step
        differ = reduce(np.add, (np.bitwise_count(w[i] ^ w[j]).astype(np.uint16) for w in words))
        met = np.flatnonzero(differ <= most)
        x, y = i[met], j[met]
        if mine is not None:  # a pair is that of its smaller number's shard
            own = np.where(no[x] < no[y], mine[x], mine[y])
            x, y = x[own], y[own]
        if len(x):
            found.append((no[x], no[y]))
            held += len(x)
        if held >= HELD_PAIRS:
            yield batch()
            found, held = [], 0
    if found:
        yield batch()


def _key_changes(rows: dict[str, np.ndarray], by: list[str]) -> np.ndarray:
    return reduce(np.logical_or, (rows[c][1:] != rows[c][:-1] for c in by))


def _bucket_pairs(batches: Iterator[pa.RecordBatch], by: list[str], threshold: float) -> Iterator[pa.RecordBatch]:
    """``a, b`` of sorted rows; those of a key that goes on in the next batch are kept for it."""
    held: list[dict[str, np.ndarray]] = []

    def all_held() -> dict[str, np.ndarray]:
        return {c: np.concatenate([part[c] for part in held]) for c in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        changes = np.flatnonzero(_key_changes(rows, by))
        last = int(changes[-1]) + 1 if len(changes) else 0
        goes_on = held and all(held[-1][c][-1] == rows[c][0] for c in by)
        if last or not goes_on:
            if last:
                held.append({c: v[:last] for c, v in rows.items()})
            if held:
                yield from _near_in_runs(all_held(), by, threshold)
            held = []
        held.append({c: v[last:] for c, v in rows.items()})
    if held:
        yield from _near_in_runs(all_held(), by, threshold)


def bucket_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` of rows (``band, no, grams, w0..``) of one band that may be as similar as ``threshold``; ``a < b``, repeats
    possible. The rows of a hot key, found by a sample of classes, are copied to its shards, where each meets those whose
    own shard it is."""
    sample = rows.where(F.pmod(F.xxhash64("no"), F.lit(HOT_SAMPLE)) == 0)
    hot = hot_keys(sample, "band", max(1, HOT_ROWS // HOT_SAMPLE))
    by = ["band"]
    if hot is not None:
        by = ["band", "shard"]
        shards = F.coalesce("_shards", F.lit(1))
        rows = rows.join(hot, "band", "left").withColumn("own", F.pmod(F.xxhash64("no"), shards).cast("int"))
        rows = rows.withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1))).withColumn("mine", F.col("shard") == F.col("own"))
        rows = rows.drop("own", "_shards")
    runs = rows.repartition(*by).sortWithinPartitions(*by, "grams")
    return runs.mapInArrow(lambda batches: _bucket_pairs(batches, by, threshold), "a bigint, b bigint")


def candidates(classes: DataFrame, threshold: float = SIMILAR, rounds: int | None = None) -> DataFrame:
    """``a, b`` of classes that share a band and whose signatures allow the threshold, ``a < b``, written."""
    if rounds is None:
        n = classes.count() * BANDS
        rounds = next(r for most, r in ROUNDS if n <= most)
    size = math.ceil(BANDS / rounds)
    carried = [f"w{i}" for i in range(CARRIED)]
    found = []
    for at in range(0, BANDS, size):
        rows = classes.select(F.explode(F.slice("bands", at + 1, size)).alias("band"), "no", "grams", *carried)
        found.append(materialize(bucket_pairs(rows, threshold).distinct(), "met"))
    pairs = reduce(DataFrame.union, found).distinct()
    words = [f"w{i}" for i in range(WORDS)]
    sa = classes.select(F.col("no").alias("a"), *(F.col(w).alias("a" + w[1:]) for w in words))
    sb = classes.select(F.col("no").alias("b"), *(F.col(w).alias("b" + w[1:]) for w in words))
    most = int(BANDS * ROWS * (1 - threshold) / 2) + SLACK_BITS
    return materialize(pairs.join(sa, "a").join(sb, "b").where(differing_bits() <= most).select("a", "b"), "likely")


def class_pairs(classes: Written, threshold: float = SIMILAR) -> DataFrame:
    """``a, b, similarity`` of different texts at or above the threshold, ``a < b``, written. ``classes`` is dropped."""
    likely = candidates(classes.df, threshold)
    texts = write_out(classes.df.select("no", "plain"), "texts")
    classes.drop()
    slices = max(1, math.ceil(likely.count() / max(1, texts.df.count())))
    slice_of = F.pmod(F.xxhash64("a", "b"), F.lit(slices))
    found = [materialize(exact_pairs(likely.where(slice_of == k), texts.df, threshold), "pairs") for k in range(slices)]
    texts.drop()
    return reduce(DataFrame.union, found)


def near_duplicates(corpus: DataFrame, threshold: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """``members, links``, written: ``id, key, no`` of all documents above 500 bytes, and ``a, b, similarity`` of the
    different texts (by ``no``) at or above the threshold. Documents of one ``key`` are the same text.

    Null contents and contents of at most 500 UTF-8 bytes take no part. Contents without letter or
    digit have no ``no`` and equal only identical ones. Very long texts are compared whole.
    """
    with shuffles_dropped(corpus.sparkSession):
        docs = write_out(comparable(corpus), "docs")
        classes = sign_classes(docs.df)
        members = docs.df.select("id", "key").join(classes.df.select("key", "no"), "key", "left").select("id", "key", "no")
        members = materialize(members, "members")
        docs.drop()
        return members, class_pairs(classes, threshold)


def same_text_pairs(members: DataFrame) -> DataFrame:
    """Pairs of documents with one key; keys of one document are left out before the join, those of many split."""
    several = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    mine = members.select("id", "key").join(several, "key", "left_semi")
    a, b = mine.withColumnRenamed("id", "id_a"), mine.withColumnRenamed("id", "id_b")
    return pairs_within(a, b, "key", F.col("id_a"), hot_keys(mine, "key")).where("id_a < id_b").select("id_a", "id_b")


def near_duplicate_pairs(corpus: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """``id_a, id_b``: all pairs of documents above 500 bytes with similarity at or above the threshold.

    What takes part is said in :func:`near_duplicates`. Ids are expected to be unique; a repeated row of one
    id gives no pair with itself. An empty table gives no row.
    """
    members, links = near_duplicates(corpus, threshold)
    classed = members.where("no is not null")
    crossed = (
        links.join(classed.select(F.col("no").alias("a"), F.col("id").alias("ia")), "a")
        .join(classed.select(F.col("no").alias("b"), F.col("id").alias("ib")), "b")
        .where("ia <> ib")
        .select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    )
    return crossed.union(same_text_pairs(members)).distinct()


def near_duplicate_groups(corpus: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """``id, group_id, n_links``: the group of every comparable document and the number of different
    texts its own text is linked to. ``group_id`` is the smallest id of the group; documents of one
    text share a class, so a group of copies has no links. Nulls and short texts as in the pairs."""
    members, near = near_duplicates(corpus, threshold)
    roots = connected_components(near, "a", "b").select(F.col("node").alias("no"), "root")
    links = near.select(F.explode(F.array("a", "b")).alias("no")).groupBy("no").agg(F.count("*").alias("n_links"))
    tagged = (
        members.join(roots, "no", "left")
        .join(links, "no", "left")
        # texts without any letter have no class; identical ones still share their key
        .select("id", "n_links", F.coalesce(F.coalesce("root", "no").cast("string"), F.hex("key")).alias("root"))
    )
    first = tagged.groupBy("root").agg(F.min("id").alias("group_id"))
    return tagged.join(first, "root").select("id", "group_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")).distinct()
