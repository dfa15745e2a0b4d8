"""Per-key results over a few hot keys, by fragment and replicate.

:func:`plan_shards` estimates the load of every key, cuts keys above a task's share into
proportionate shards and packs shards and light keys to tasks, largest first. :func:`place` tags rows
with their shard and task; :func:`replicate` copies the rows of a matching side to the shards of their
key only. What reaches the driver is bounded: at most ``tasks * per_task`` hot keys, since each
holds more than one such share of the total, and ``LIGHT_BINS`` sums for all other keys together.

:func:`pairs_within` is the same for joins of a table with itself, where a key of n rows makes n² pairs: keys of
many rows are found by :func:`hot_keys` and split into shards.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.runtime import materialize

LIGHT_BINS = 1024
#: Rows of a key beyond which a self-join splits it, and classes of keys that are counted to find such keys.
HOT_ROWS, COUNT_BINS = 5_000, 1 << 16
#: Hot keys up to which they are broadcast; their number is counted first.
MOST_BROADCAST = 50_000


class ShardPlan:
    def __init__(self, spark: SparkSession, key: str, tasks: int, hot: list[tuple], light: list[int]):
        self.key, self.tasks = key, tasks
        self.hot_keys = {k: ts for k, ts in hot}
        self.hot = spark.createDataFrame(hot, f"{key} string, _tasks array<int>")
        self.light = spark.createDataFrame(list(enumerate(light)), "_bin int, _task int")

    def light_bin(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(LIGHT_BINS)).cast("int")


def plan_shards(df: DataFrame, key: str, load: Column, tasks: int, per_task: int = 4) -> ShardPlan:
    """Estimate loads and pack. ``load`` is the load of a row; ``per_task`` shards of full size fill a task."""
    spark = df.sparkSession
    loads = df.groupBy(F.col(key).cast("string").alias(key)).agg(F.sum(load).alias("load"))
    loads = materialize(loads.withColumn("_bin", F.pmod(F.xxhash64(key), F.lit(LIGHT_BINS)).cast("int")), "loads")
    total = loads.agg(F.sum("load")).first()[0] or 0
    share = max(1, math.ceil(total / (tasks * per_task)))
    hot = loads.where(F.col("load") > share).select(key, "load").collect()  # fewer than tasks * per_task rows
    bins = [0] * LIGHT_BINS
    for row in loads.where(F.col("load") <= share).groupBy("_bin").agg(F.sum("load").alias("load")).collect():
        bins[row["_bin"]] = row["load"]
    items = [(b, "light", i, 0) for i, b in enumerate(bins)]
    for row in hot:
        shards = math.ceil(row["load"] / share)
        items += [(row["load"] / shards, "hot", row[key], i) for i in range(shards)]
    heap = [(0.0, t) for t in range(tasks)]
    placed: dict[tuple, int] = {}
    for size, kind, name, i in sorted(items, key=lambda x: (-x[0], str(x[1:]))):
        now, task = heapq.heappop(heap)
        placed[kind, name, i] = task
        heapq.heappush(heap, (now + size, task))
    lists = [(row[key], [placed["hot", row[key], i] for i in range(math.ceil(row["load"] / share))]) for row in hot]
    return ShardPlan(spark, key, tasks, lists, [placed["light", i, 0] for i in range(LIGHT_BINS)])


def place(df: DataFrame, plan: ShardPlan, member: Column) -> DataFrame:
    """Add ``_shard`` and ``_task``: a hot key's rows go to the shard that ``member`` hashes to."""
    hot, light = F.broadcast(plan.hot), F.broadcast(plan.light)  # both bounded, see the module's text
    shard = F.pmod(F.xxhash64(member), F.size("_tasks")).cast("int")
    return (
        df.join(hot, plan.key, "left")
        .withColumn("_bin", plan.light_bin())
        .join(light, "_bin", "left")
        .withColumn("_shard", F.when(F.col("_tasks").isNotNull(), shard).otherwise(F.lit(0)))
        .withColumn("_task", F.when(F.col("_tasks").isNotNull(), F.get("_tasks", "_shard")).otherwise(F.col("_task")))
        .drop("_bin", "_tasks")
    )


def replicate(df: DataFrame, plan: ShardPlan) -> DataFrame:
    """Copy each row to every shard of its key: one copy for light keys, one per shard for hot ones."""
    hot, light = F.broadcast(plan.hot), F.broadcast(plan.light)
    return (
        df.join(hot, plan.key, "left")
        .withColumn("_bin", plan.light_bin())
        .join(light, "_bin", "left")
        .select("*", F.posexplode(F.coalesce("_tasks", F.array("_task"))).alias("_shard", "_to"))
        .drop("_bin", "_tasks", "_task")
        .withColumnRenamed("_to", "_task")
    )


def fragment_replicate_join(
    left: DataFrame, right: DataFrame, key: str, member: Column, load: Column | None = None, tasks: int | None = None
) -> DataFrame:
    """Inner join on ``key`` where ``left`` is fragmented by load and ``right`` is copied to those fragments."""
    tasks = tasks or task_count(left.sparkSession)
    plan = plan_shards(left, key, load if load is not None else F.lit(1), tasks)
    a = place(left, plan, member).repartitionById(tasks, F.col("_task"))
    b = replicate(right, plan).repartitionById(tasks, F.col("_task"))
    return a.join(b, ["_task", "_shard", key]).drop("_task", "_shard")


def hot_keys(rows: DataFrame, key: str, most: int = HOT_ROWS) -> DataFrame | None:
    """``key, _shards`` of keys with many more than ``most`` rows, or None.

    Rows are first counted by ``COUNT_BINS`` classes of keys, which map-side sums keep small, and only keys
    of classes that stand out are counted one by one. A key that hides in a light class costs time, nothing else.
    """
    bin_of = F.pmod(F.xxhash64(key), F.lit(COUNT_BINS)).cast("int")
    counts = {r["b"]: r["n"] for r in rows.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n")).collect()}
    usual = sum(counts.values()) / COUNT_BINS
    heavy = [b for b, n in counts.items() if n > usual + most]
    if not heavy:
        return None
    picked = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(b,) for b in heavy], "_b int")), bin_of == F.col("_b"), "left_semi")
    found = picked.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most)
    found = materialize(found.select(key, F.ceil(F.col("n") / most).cast("int").alias("_shards")), "hot")
    number = found.count()
    if not number:
        return None
    return F.broadcast(found) if number <= MOST_BROADCAST else found


def pairs_within(
    left: DataFrame, right: DataFrame, key: str, member: Column, hot: DataFrame | None = None
) -> DataFrame:
    """Inner join of two sides on ``key``, keys in ``hot`` (from :func:`hot_keys`) split: the left row goes to the
    shard that ``member`` hashes to and the right one to all of them, so no task meets all pairs of a hot key."""
    if hot is None:
        return left.join(right, key)
    shards = F.coalesce("_shards", F.lit(1))
    a = left.join(hot, key, "left").withColumn("_shard", F.pmod(F.xxhash64(member), shards).cast("int")).drop("_shards")
    b = right.join(hot, key, "left").withColumn("_shard", F.explode(F.sequence(F.lit(0), shards - 1))).drop("_shards")
    return a.join(b, [key, "_shard"]).drop("_shard")


def task_count(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def bucket_results(segments: DataFrame, tasks: int | None = None) -> DataFrame:
    """``bucket_key, n_docs, first_id``: distinct member count and smallest member of every bucket.

    Null keys, null arrays and null ids are left out; a key without any id gives no row. A member of
    a hot bucket always hashes to the same shard, so the distinct counts of shards add up.
    """
    tasks = tasks or task_count(segments.sparkSession)
    rows = segments.where(F.col("bucket_key").isNotNull() & F.col("doc_ids").isNotNull())
    members = rows.select("bucket_key", F.explode(F.array_distinct(F.array_compact("doc_ids"))).alias("id"))
    # repeats go before the exchange, which spreads members of any bucket evenly; the loads planned are those left
    unique = materialize(members.distinct(), "members")
    plan = plan_shards(unique, "bucket_key", F.lit(1), tasks)
    return (
        place(unique, plan, F.col("id"))
        .repartitionById(tasks, F.col("_task"))
        .groupBy("_task", "bucket_key", "_shard")
        .agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
        .groupBy("bucket_key")
        .agg(F.sum("n").alias("n_docs"), F.min("first_id").alias("first_id"))
    )


def wrong_counts(segments: DataFrame, tasks: int | None = None) -> DataFrame:
    """``bucket_key, n_segments, n_wrong, n_docs``: how many segments of each bucket record another size than
    they have (ids, null ones left out, repeats counted once), beside the bucket's whole size.

    The bucket's result is copied to the shards of its segments, which are cut by load. A null
    size is another one. Null keys and keys without any id give no row.
    """
    rows = segments.where(F.col("bucket_key").isNotNull()).select(
        "bucket_key", "doc_ids", "doc_count", F.size(F.array_distinct(F.array_compact(F.coalesce("doc_ids", F.array())))).alias("size")
    )
    rows = rows.select("bucket_key", (~F.col("doc_count").eqNullSafe(F.col("size"))).cast("bigint").alias("wrong"), F.xxhash64("doc_ids", "doc_count").alias("row"))
    joined = fragment_replicate_join(rows, bucket_results(segments, tasks), "bucket_key", F.col("row"), tasks=tasks)
    return joined.groupBy("bucket_key", "n_docs").agg(F.count("*").alias("n_segments"), F.sum("wrong").alias("n_wrong"))
