"""New batches against all accepted records, by content-defined chunking.

A rolling hash over the last three characters of the plain text sets a boundary about every 16
characters, so an insertion only changes the chunks around it. A chunk is one 64-bit number: 51 bits
of its hash and, in the low 13, its length in bytes. :class:`ChunkIndex` keeps what was accepted, batch by batch, in
tables divided into "slots", so that a probe reads only the slots that it needs: ``chunks`` by chunk, ``bands`` by band,
``records`` by key. A batch counts once a ledger names its folder, which is one atomic step; appending it again
replaces it, and ``compact`` merges all batches.

Chunks of both sides are ranked alike, rarest first, by their number in history. A record takes part with its
rarest chunks until those left over hold less than ``UNSEEN`` of its bytes, and shared bytes are summed for
each pair of a new and an accepted record. The common chunks that one of both leaves out come last in the
ranking and hold less than ``UNSEEN`` of the larger one's bytes; so a pair whose chunks cover ``COVERAGE`` of them still
shares the difference, and nothing that reaches the coverage is lost, while chunks that most records
hold (page chrome) are not joined. Chunks that many records hold are split over tasks. Pairs whose numbers of distinct
3-character sequences already exclude the wanted similarity are dropped in the join.

Coverage does not follow from similarity: where short clauses change places, few chunks stay whole. For those pairs
the index also keeps a sketch of each record: ``FUNCTIONS`` universal hash functions part its 3-character sequences
into ``BINS`` bins and keep the least value of each; ``ROWS`` bins are one band, and a pair that shares a band is a
candidate too. A pair of similarity s below the coverage is missed with probability (1 - s^7)^36: 9e-5 at 0.81,
2e-6 at 0.85, 5e-11 at 0.9. Candidates whose lowest bits of these values exclude the similarity (by five standard
deviations) are dropped, and the rest are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsieve.functions.grams import gram_set
from twinsieve.llm.grams import SIMILAR, comparable, similarities
from twinsieve.operators.ledger import Ledger
from twinsieve.operators.skew import HOT_ROWS, hot_keys, pairs_within
from twinsieve.runtime import materialize, new_path, remove

AVERAGE, WINDOW, LONGEST = 16, 3, 64
COVERAGE, UNSEEN = 0.3, 0.2
LENGTH_BITS = 13
FUNCTIONS, BINS, ROWS, SEED = 4, 63, 7, 20240607
EMPTY = np.uint64(1 << 32)  # a bin without a sequence
WORDS = [f"w{i}" for i in range(4)]  # 256 bits hold the lowest ones of all values
SLOTS = 16

_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def chunk_numbers(text: str) -> np.ndarray:
    """Distinct chunk numbers of a text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c)
    if n == 0:
        return np.empty(0, np.int64)
    rolling = np.zeros(n, np.uint64)
    for k in range(min(WINDOW, n)):
        rolling[k:] += c[: n - k] * _WEIGHTS[k]
    cuts = np.flatnonzero(_mix(rolling) % np.uint64(AVERAGE) == 0) + 1
    ends = np.unique(np.append(cuts, n))
    starts = np.append(0, ends[:-1])
    if (long := ends - starts > LONGEST).any():
        extra = [np.arange(s + LONGEST, e, LONGEST) for s, e in zip(starts[long], ends[long])]
        ends = np.unique(np.concatenate([ends, *extra]))
        starts = np.append(0, ends[:-1])
    sums = np.append(np.uint64(0), np.cumsum(_mix(c + np.uint64(1)) * _powers(_BASE, n)))
    digest = (sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts]
    width = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
    size = np.append(0, np.cumsum(width))
    digest = _mix(digest + (ends - starts).astype(np.uint64))
    low = np.uint64((1 << LENGTH_BITS) - 1)
    return np.unique(((digest & ~low) | (size[ends] - size[starts]).astype(np.uint64)).view(np.int64))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """``len(sets) x (FUNCTIONS * BINS)`` least values, ``EMPTY`` where a bin has no sequence."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, FUNCTIONS, dtype=np.uint64)
    width = FUNCTIONS * BINS
    out = np.full(len(sets) * width, EMPTY, np.uint64)
    if sets:
        every = _mix(np.concatenate(sets))
        row = np.repeat(np.arange(len(sets), dtype=np.int64) * width, [len(s) for s in sets])
        for k in range(FUNCTIONS):
            value = (every * a[k] + b[k]) >> np.uint64(32)
            bins = ((value * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64) + k * BINS
            np.minimum.at(out, row + bins, value)
    return out.reshape(len(sets), width)


def sketch_bands(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, with the band's number in them, and which of them hold any sequence."""
    cut = values.reshape(len(values), -1, ROWS)
    key = np.broadcast_to(np.arange(1, cut.shape[1] + 1, dtype=np.uint64), cut.shape[:2])
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, r])
    return key.view(np.int64), (cut != EMPTY).any(axis=2)


def sketch_words(values: np.ndarray) -> np.ndarray:
    """The lowest bit of every value."""
    bits = np.zeros((len(values), 64 * len(WORDS)), np.uint8)
    bits[:, : values.shape[1]] = values & np.uint64(1)
    return np.packbits(bits, axis=1).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.empty(0, np.int64)])))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            texts = batch.column("plain").to_pylist()
            chunks = [chunk_numbers(t) for t in texts]
            grams = [gram_set(t) for t in texts]
            values = sketch(grams)
            keys, held = sketch_bands(values)
            words = sketch_words(values)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("plain"),
                    _lists(chunks),
                    pa.array([int((x & ((1 << LENGTH_BITS) - 1)).sum()) for x in chunks], pa.int32()),
                    pa.array([len(g) for g in grams], pa.int32()),
                    _lists([k[h] for k, h in zip(keys, held)]),
                    *(pa.array(words[:, i]) for i in range(len(WORDS))),
                ],
                names=["key", "plain", "chunks", "size", "grams", "bands", *WORDS],
            )


def cut_records(texts: DataFrame) -> DataFrame:
    """``no, key, plain, chunks, size, grams, bands, w0..`` of distinct texts (``key, plain``), written.
    Texts without any letter have neither chunks nor bands."""
    schema = "key binary, plain string, chunks array<bigint>, size int, grams int, bands array<bigint>, "
    cut = texts.select("key", "plain").mapInArrow(_cut, schema + ", ".join(f"{w} bigint" for w in WORDS))
    return materialize(cut.withColumn("no", F.monotonically_increasing_id()), "cut")


def rarest(rows: DataFrame, *record: str) -> DataFrame:
    """Rows of the rarest chunks of each record, with ``bytes``: those after which chunks of at least
    ``UNSEEN`` of its ``size`` are left, itself included. ``df`` ranks the chunks alike for all records."""
    rows = rows.withColumn("bytes", F.col("chunk").bitwiseAND((1 << LENGTH_BITS) - 1).cast("int"))
    commonest = Window.partitionBy(*record).orderBy(F.col("df").desc(), F.col("chunk").desc())
    left = F.sum("bytes").over(commonest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("left", left).where(F.col("left") >= UNSEEN * F.col("size"))


class ChunkIndex:
    """The persistent chunk-to-record table of everything accepted so far.

    ``slots`` is the number of parts of each table; at the first batch it is fixed for the index.
    """

    def __init__(self, spark: SparkSession, folder: str, slots: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.ledger = Ledger(spark, f"{self.folder}/batches")
        known = self._records()
        self.slots = known[0][1]["slots"] if known else slots or max(SLOTS, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _records(self) -> list[tuple[int, dict]]:
        """Ledger records that count: the last of each batch, without those that a compaction replaced."""
        found = self.ledger.records()
        last = {r["batch"]: n for n, r in found}
        gone = {g for _, r in found for g in r["replaces"]}
        return [(n, r) for n, r in found if last[r["batch"]] == n and n not in gone]

    def batches(self) -> list[str]:
        return [r["batch"] for _, r in self._records()]

    def _slot(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.slots)).cast("int")

    def _slots_of(self, rows: DataFrame, slot: Column) -> list[int]:
        return [r[0] for r in rows.select(slot.alias("s")).distinct().collect()]  # at most `slots` numbers

    def _read(self, table: str, slots: list[int] | None = None) -> DataFrame | None:
        kinds = {
            "chunks": "chunk bigint, no bigint, at int, grams int, size int",
            "bands": "band bigint, no bigint, at int, grams int",
            "records": "no bigint, key binary, plain string, size int, " + ", ".join(f"{w} bigint" for w in WORDS),
        }
        parts = [
            self.spark.read.schema(f"{kinds[table]}, slot int").parquet(f"{self.folder}/data/{r['folder']}/{table}").withColumn("batch", F.lit(n))
            for n, r in self._records()
        ]
        if not parts:
            return None
        whole = reduce(DataFrame.unionByName, parts)
        return whole if slots is None else whole.where(F.col("slot").isin(slots))

    def append(self, batch: str, texts: DataFrame) -> None:
        """Accept a batch of distinct texts (``key, plain``); texts that the index holds are not kept twice."""
        self._append(batch, cut_records(texts))

    def _append(self, batch: str, cut: DataFrame, replaces: tuple[int, ...] = (), all_new: bool = False) -> None:
        held = self._records()
        others = [r for n, r in held if r["batch"] != batch and n not in replaces]
        if others and not all_new:
            keys = self._read("records", self._slots_of(cut, self._slot("key")))
            keys = keys.where(F.col("batch").isin([n for n, r in held if r in others])).select("key")
            cut = materialize(cut.join(keys, "key", "left_anti"), "fresh")
        number = self.ledger.last()[0] + 1
        folder = new_path(self.spark, "b").rsplit("/", 1)[1]
        cut = cut.withColumn("at", self._slot("key"))

        def write(df: DataFrame, table: str, slot: Column) -> None:
            rows = df.withColumn("slot", slot).repartition("slot")
            rows.write.option("compression", "zstd").partitionBy("slot").parquet(f"{self.folder}/data/{folder}/{table}")

        write(cut.select(F.explode("chunks").alias("chunk"), "no", "at", "grams", "size"), "chunks", self._slot("chunk"))
        write(cut.select(F.explode("bands").alias("band"), "no", "at", "grams"), "bands", self._slot("band"))
        write(cut.select("no", "key", "plain", "size", *WORDS, "at"), "records", F.col("at"))
        self.ledger.add(number, {"batch": batch, "folder": folder, "slots": self.slots, "replaces": list(replaces)})
        for n, r in held:  # what no reader that starts now will name
            if r["batch"] == batch or n in replaces:
                remove(self.spark, f"{self.folder}/data/{r['folder']}")

    def compact(self, batch: str) -> None:
        """Merge all batches into one of this name."""
        known = self._read("records")
        if known is not None:
            self._append(batch, cut_records(known), tuple(n for n, _ in self._records()))

    def probe(self, texts: DataFrame, similarity: float = SIMILAR) -> DataFrame:
        """``key_a, key_b, similarity`` of new texts (``key, plain``) and accepted ones, written; equal texts too."""
        return self._probe(cut_records(texts), similarity)

    def _probe(self, new: DataFrame, similarity: float) -> DataFrame:
        if not self._records():
            return new.limit(0).select(F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(0.0).alias("similarity"))
        found = materialize(self._by_chunks(new, similarity).union(self._by_bands(new, similarity)).distinct(), "candidates")
        slots = self._slots_of(found, F.col("at"))
        kept = self._read("records", slots)
        side = lambda df, s, *more: df.select(*more, *(F.col(w).alias(f"{s}_{w}") for w in WORDS))
        met = found.join(side(kept, "b", "batch", F.col("no").alias("b"), F.col("key").alias("key_b")), ["batch", "b"])
        met = met.join(side(new, "a", F.col("no").alias("a"), F.col("key").alias("key_a")), "a")
        n = FUNCTIONS * BINS
        differing = reduce(Column.__add__, [F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in WORDS])
        expected = (1 - similarity) / 2
        most = n * expected + 5 * (n * expected * (1 - expected)) ** 0.5
        likely = met.where((F.col("key_a") == F.col("key_b")) | (differing <= most)).select("a", "batch", "b", "key_a", "key_b")
        likely = materialize(likely, "likely")
        both = likely.where("key_a <> key_b").join(kept.select("batch", F.col("no").alias("b"), F.col("plain").alias("pb")), ["batch", "b"])
        near = compare(both.join(new.select(F.col("no").alias("a"), F.col("plain").alias("pa")), "a"), similarity)
        # texts without any letter have no chunks; they pair by their key alone
        bare = new.where("size = 0").select("key")
        bare = bare.join(self._read("records").where("size = 0").select("key"), "key", "left_semi")
        same = likely.where("key_a = key_b").select("key_a").union(bare).distinct()
        return materialize(near.union(same.select("key_a", F.col("key_a").alias("key_b"), F.lit(1.0).alias("similarity"))), "near")

    def _by_chunks(self, new: DataFrame, similarity: float) -> DataFrame:
        """``a, batch, b, at`` of pairs whose chunks may cover ``COVERAGE`` of the larger record."""
        mine = new.select("no", F.explode("chunks").alias("chunk"), "size", "grams")
        # one scan of the slots that hold chunks of the batch, cut to those chunks; a small batch is broadcast at run time
        known = self._read("chunks", self._slots_of(mine, self._slot("chunk")))
        known = known.join(mine.select("chunk").distinct(), "chunk", "left_semi")
        known = known.withColumn("df", F.count("*").over(Window.partitionBy("chunk")).cast("int"))
        known = materialize(known.select("chunk", "batch", "no", "at", "grams", "size", "df"), "met")
        spread = known.groupBy("chunk").agg(F.first("df").alias("df"))
        shards = F.ceil(F.col("df") / HOT_ROWS).cast("int")
        probes = rarest(mine.join(spread, "chunk"), "no").select(
            "chunk", F.col("no").alias("a"), "bytes", F.col("size").alias("total"), F.col("grams").alias("g"),
            F.pmod(F.xxhash64("no"), shards).cast("int").alias("shard"),
        )
        met = rarest(known, "batch", "no").select(
            "chunk", "batch", F.col("no").alias("b"), "at", F.col("grams").alias("h"), "size",
            F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"),
        )
        return (
            probes.join(met, ["chunk", "shard"])
            .where(possible("g", "h", similarity))
            # one number a row: the chunk's share of the larger record
            .select("a", "batch", "b", "at", (F.col("bytes") / F.greatest("total", "size")).alias("share"))
            .groupBy("a", "batch", "b", "at")
            .agg(F.sum("share").alias("share"))
            .where(F.col("share") >= COVERAGE - UNSEEN - 1e-9)
            .select("a", "batch", "b", "at")
        )

    def _by_bands(self, new: DataFrame, similarity: float) -> DataFrame:
        """``a, batch, b, at`` of pairs that share a band, for those whose chunks cover too little."""
        mine = new.select(F.col("no").alias("a"), F.explode("bands").alias("band"), F.col("grams").alias("g"))
        known = self._read("bands", self._slots_of(mine, self._slot("band")))
        known = known.select("band", "batch", F.col("no").alias("b"), "at", F.col("grams").alias("h"))
        met = pairs_within(mine, known, "band", F.col("a"), hot_keys(known, "band"))
        return met.where(possible("g", "h", similarity)).select("a", "batch", "b", "at")


def possible(g: str, h: str, similarity: float) -> Column:
    """Whether sets of these sizes can be so similar."""
    return (F.col(g) >= similarity * F.col(h) - 1e-6) & (F.col(h) >= similarity * F.col(g) - 1e-6)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = similarities(batch.column("pa").to_pylist(), batch.column("pb").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("key_a"), batch.column("key_b"), pa.array(found)], names=["key_a", "key_b", "similarity"]
        )


def compare(pairs: DataFrame, threshold: float) -> DataFrame:
    rows = pairs.select("key_a", "key_b", "pa", "pb")
    out = rows.mapInArrow(_compare, "key_a binary, key_b binary, similarity double")
    return out.where(F.col("similarity") >= threshold)


def distinct_texts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("key").agg(F.first("plain").alias("plain"))


def check_batch(index: ChunkIndex, batch: str, docs: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """``key_a, key_b, similarity`` of a batch (``key, plain`` and more, from ``comparable``) against all that was
    accepted before; then its texts that have no such pair are accepted too."""
    cut = cut_records(distinct_texts(docs))
    near = index._probe(cut, similarity)
    accepted = cut.join(near.select(F.col("key_a").alias("key")).distinct(), "key", "left_anti")
    index._append(batch, materialize(accepted, "accepted"), all_new=True)
    return near


def accepted_duplicates(corpus: DataFrame, folder: str | None = None, parts: int = 2) -> DataFrame:
    """``id_a, id_b``: unprocessed records (is_parent null) with the accepted ones (is_parent true) that
    are the same text or at least 0.8 similar, the smaller id first.

    Accepted records come into the index in ``parts`` batches, as they would over time; the unprocessed ones are
    one more batch, checked against them, of which the texts without such a pair are accepted. Contents of at most 500
    UTF-8 bytes and null contents take no part; copies are collapsed before the chunking and come out again as
    pairs. ``folder`` is the index's place; by default a new one.
    """
    spark = corpus.sparkSession
    index = ChunkIndex(spark, folder or new_path(spark, "chunk-index"))
    docs = materialize(comparable(corpus.where("is_parent is null or is_parent"), "is_parent"), "docs")
    new, old = docs.where("is_parent is null"), docs.where("is_parent")
    for part in range(parts):
        index.append(f"accepted-{part}", distinct_texts(old.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)))
    linked = check_batch(index, "unprocessed", new)
    return (
        linked.join(new.select(F.col("key").alias("key_a"), F.col("id").alias("ia")), "key_a")
        .join(old.select(F.col("key").alias("key_b"), F.col("id").alias("ib")), "key_b")
        .where("ia <> ib")
        .select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
        .distinct()
    )
