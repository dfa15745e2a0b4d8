"""Signatures, bands, buckets and candidate pairs, and the index that keeps them."""

from __future__ import annotations

import json

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsieve.config import HASH_VERSION, NUM_PERM, SEED, TOKENIZER_VERSION, DedupeConfig
from twinsieve.functions.minhash import band_hashes, band_slices, signature_udf
from twinsieve.functions.text import is_boilerplate, normalize_content, size_within
from twinsieve.operators.skew import hot_keys, pairs_within
from twinsieve.runtime import exists, filesystem, names_in, publish, read_text, spread

#: Folders of an index's band keys.
SLOTS = 64


def classify(docs: DataFrame, config: DedupeConfig, patterns: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Adds ``verdict``: boilerplate first, then short, else index. Null contents count as empty."""
    content = F.coalesce("content", F.lit(""))
    return docs.withColumn(
        "verdict",
        F.when(is_boilerplate(content, patterns), "boilerplate")
        .when(F.octet_length(content) <= config.min_content_length, "short")
        .otherwise("index"),
    )


def sign(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``id, sig, content_len`` (UTF-8 bytes of the content)."""
    rows = spread(docs.select("id", F.coalesce("content", F.lit("")).alias("content")))
    rows = rows.select("id", "content", normalize_content(F.col("content")).alias("normalized"))
    return rows.select(
        "id", signature_udf(seed)("normalized", "content").alias("sig"), F.octet_length("content").cast("bigint").alias("content_len")
    )


def bands(signed: DataFrame, config: DedupeConfig = DedupeConfig()) -> DataFrame:
    """``id, band, key`` with the slots themselves as key."""
    return signed.select("id", F.inline(band_slices(F.col("sig"), config.num_bands, config.rows_per_band)))


def buckets(signed: DataFrame) -> DataFrame:
    """``band, key, doc_ids`` (sorted, distinct): the inverted index."""
    return bands(signed).groupBy("band", "key").agg(F.sort_array(F.collect_set("id")).alias("doc_ids"))


def large_buckets(
    signed: DataFrame, min_size: int, limit: int | None = 10_000, batch: DataFrame | None = None, config: DedupeConfig = DedupeConfig()
) -> DataFrame:
    """``band, key, size``: the ``limit`` largest buckets of at least ``min_size`` documents, or all with
    None; with ``batch`` only of those that hold one of its ids."""
    rows = bands(signed, config)
    if batch is not None:
        mine = bands(signed.join(batch.select("id").distinct(), "id", "left_semi"), config).select("band", "key").distinct()
        rows = rows.join(mine, ["band", "key"], "left_semi")
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    return sizes if limit is None else sizes.orderBy(F.col("size").desc(), "band", "key").limit(limit)


def bucket_samples(signed: DataFrame, found: DataFrame, most: int = 5) -> DataFrame:
    """The given ``band, key`` rows with ``samples``: their ``most`` smallest ids, joined by commas."""
    members = bands(signed).join(found.select("band", "key"), ["band", "key"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("band", "key").orderBy("id"))
    few = members.withColumn("_rank", rank).where(F.col("_rank") <= most)
    listed = few.groupBy("band", "key").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("samples"))  # at most `most`
    return found.join(listed, ["band", "key"])


def band_keys(signed: DataFrame, config: DedupeConfig = DedupeConfig()) -> DataFrame:
    """``id, content_len, bucket``: a 64-bit number for each band of each document."""
    kept = [c for c in ("content_len",) if c in signed.columns]
    return signed.select("id", *kept, F.explode(band_hashes(F.col("sig"), config.num_bands, config.rows_per_band)).alias("bucket"))


def candidate_pairs(
    signed: DataFrame, batch: DataFrame | None = None, size_diff: float | None = None, linked: DataFrame | None = None,
    known: DataFrame | None = None, config: DedupeConfig = DedupeConfig(),
) -> DataFrame:
    """``p, c``: pairs that share a band, each once. Without ``batch``, ``p`` is the smaller id of every
    pair; with it, ``p`` runs over the batch's ids and ``c`` over everything, and a pair inside the
    batch belongs to its smaller id. Sizes are compared in the join where ``size_diff`` is given.
    Members of one cluster of ``linked`` (``cluster, id``), which are linked already, make no pair.
    ``known`` (``bucket, id, content_len``) is the table of band keys of everything, where an index keeps it.
    Buckets of many documents are split over tasks."""
    clusters = None if linked is None else linked.groupBy("id").agg(F.min("cluster").alias("cluster"))
    tag = lambda rows: rows.withColumn("cluster", F.lit(None).cast("string")) if clusters is None else rows.join(clusters, "id", "left")
    right = tag(band_keys(signed, config) if known is None else known.select("id", "content_len", "bucket"))
    ids = None if batch is None else batch.select("id").distinct()
    left = right if ids is None else tag(band_keys(signed.join(ids, "id", "left_semi"), config))
    side = lambda rows, s: rows.select(F.col("id").alias(s), F.col("content_len").alias(f"len_{s}"), F.col("cluster").alias(f"cluster_{s}"), "bucket")
    left, right = side(left, "p"), side(right, "c")
    # a small batch is broadcast at run time, and history is only scanned
    pairs = pairs_within(left, right, "bucket", F.col("p"), hot_keys(right, "bucket")).where("p < c" if ids is None else "p <> c")
    if linked is not None:
        pairs = pairs.where("cluster_p is null or cluster_c is null or cluster_p <> cluster_c")
    if size_diff is not None:
        pairs = pairs.where(size_within(F.col("len_p"), F.col("len_c"), size_diff))
    pairs = pairs.select("p", "c").distinct()
    if ids is None:
        return pairs
    tagged = pairs.join(ids.select(F.col("id").alias("c"), F.lit(True).alias("in_batch")), "c", "left")
    return tagged.where("in_batch is null or p < c").select("p", "c")


class MetadataMismatch(RuntimeError):
    """The stored index was built with other parameters."""


class LshIndex:
    """Signatures and band keys kept under a folder, one directory per batch of each.

    ``metadata.json`` holds what the stored values depend on and is checked each time; a filled index
    without it is refused. A document is signed once: inserting a batch again signs what no batch holds yet and
    adds it. Band keys lie in ``SLOTS`` folders by key, so that a batch reads those of its own keys.
    """

    def __init__(self, spark: SparkSession, folder: str, config: DedupeConfig = DedupeConfig()):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config
        self.metadata = {
            "seed": config.seed,
            "num_perm": NUM_PERM,
            "num_bands": config.num_bands,
            "rows_per_band": config.rows_per_band,
            "tokenizer_version": TOKENIZER_VERSION,
            "hash_version": HASH_VERSION,
        }
        self._check()

    def _check(self) -> None:
        path = f"{self.folder}/metadata.json"
        if exists(self.spark, path):
            stored = json.loads(read_text(self.spark, path))
            if stored != self.metadata:
                raise MetadataMismatch(f"index has {stored}, run has {self.metadata}")
        elif self.batches():
            raise MetadataMismatch("a filled index without metadata")
        elif not publish(self.spark, path, json.dumps(self.metadata)):
            self._check()  # another run was first

    def batches(self) -> list[str]:
        at = f"{self.folder}/signatures"
        return [n for n in names_in(self.spark, at) if exists(self.spark, f"{at}/{n}/_SUCCESS")]

    def insert(self, docs: DataFrame, batch: str) -> DataFrame:
        """Sign and keep documents that the index lacks; gives the batch's signatures."""
        old, path = self.ids(), f"{self.folder}/signatures/{batch}"
        fresh = docs if old is None else docs.join(old, "id", "left_anti")
        sign(fresh.dropDuplicates(["id"]), self.config.seed).write.mode("append").parquet(path)
        self._write_keys(batch)
        return self.spark.read.parquet(path)

    def _slot(self) -> Column:
        return F.pmod("bucket", F.lit(SLOTS)).cast("int")

    def _write_keys(self, batch: str) -> None:
        rows = band_keys(self.spark.read.parquet(f"{self.folder}/signatures/{batch}"), self.config).withColumn("slot", self._slot())
        rows.repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.folder}/bands/{batch}")

    def keys(self, wanted: DataFrame | None = None) -> DataFrame | None:
        """``id, content_len, bucket`` of everything indexed; with ``wanted`` (``bucket``) only folders that hold one."""
        names = self.batches()
        if not names:
            return None
        for name in names:  # of a batch whose writer died between both tables
            if not exists(self.spark, f"{self.folder}/bands/{name}/_SUCCESS"):
                self._write_keys(name)
        kind = self.spark.read.parquet(f"{self.folder}/signatures/{names[0]}").schema["id"].dataType.simpleString()
        schema = f"id {kind}, content_len bigint, bucket bigint, slot int"
        rows = reduce(DataFrame.unionByName, (self.spark.read.schema(schema).parquet(f"{self.folder}/bands/{n}") for n in names))
        if wanted is not None:
            rows = rows.where(F.col("slot").isin([r[0] for r in wanted.select(self._slot().alias("s")).distinct().collect()]))
        return rows.drop("slot")

    def signatures(self) -> DataFrame | None:
        paths = [f"{self.folder}/signatures/{n}" for n in self.batches()]
        return self.spark.read.parquet(*paths) if paths else None

    def count(self) -> int:
        found = self.signatures()
        return found.count() if found is not None else 0

    def get(self, ids: DataFrame) -> DataFrame | None:
        found = self.signatures()
        return None if found is None else found.join(ids.select("id"), "id", "left_semi")

    def ids(self) -> DataFrame | None:
        found = self.signatures()
        return None if found is None else found.select("id")

    def has(self, ids: DataFrame) -> DataFrame:
        """``id, present`` of the given ids."""
        found = self.ids()
        if found is None:
            return ids.select("id").withColumn("present", F.lit(False))
        mark = found.withColumn("_in", F.lit(True))
        return ids.select("id").join(mark, "id", "left").select("id", F.col("_in").isNotNull().alias("present"))

    def bucket_docs(self, wanted: DataFrame) -> DataFrame:
        """``band, key, id``: the members of the given ``band, key`` rows."""
        return bands(self.signatures(), self.config).join(wanted.select("band", "key").distinct(), ["band", "key"], "left_semi")

    def query(self, docs: DataFrame) -> DataFrame:
        """``id, other``: indexed documents that share a band with the given ones, themselves left out.

        The given documents need not be in the index.
        """
        asked = band_keys(sign(docs, self.config.seed), self.config).select("id", "bucket")
        known = self.keys(asked).select(F.col("id").alias("other"), "bucket")
        return asked.join(known, "bucket").where("id <> other").select("id", "other").distinct()

    def compact(self, batch: str) -> None:
        """Rewrite all batches as one of a new name; the old ones go once it is whole."""
        found, old = self.signatures(), self.batches()
        if found is None:
            return
        if batch not in old:
            found.write.parquet(f"{self.folder}/signatures/{batch}")
            self._write_keys(batch)
            for name in old:
                for table in ("signatures", "bands"):
                    fs, at = filesystem(self.spark, f"{self.folder}/{table}/{name}")
                    fs.delete(at, True)
