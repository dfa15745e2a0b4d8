"""Filling fixed-capacity containers with items of varying length.

Only the histogram of lengths reaches the driver: at most ``capacity`` counts however many items there
are. There, shallow combinations (up to three lengths) that exactly fill a window are enumerated,
their repeat counts solved against the histogram by non-negative least squares, and rounded down to what
the histogram has; a container holds a whole number of windows of one combination. What is left is
packed greedily, still on counts: longest lengths first, each into the tightest open space. The
plan is a list of patterns with repeats, whose size depends on the capacity only. Items get a
rank among those of their length, in shards of bounded size, and find their container by binary search
in the plan.

An item above the capacity fills whole containers of its own, and its rest is an item like others; no
other item is split. Items without length are spread over the containers.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.runtime import materialize

BINS = 192  # lengths of a window are rounded up to this many steps
DEPTH = 3
SHARD_ROWS = 1_000_000


def combinations(bins: int) -> np.ndarray:
    """All ascending triples, pairs and singles of 1..bins that sum to ``bins``; zeros fill up."""
    rows = [(0, 0, bins)]
    rows += [(0, a, bins - a) for a in range(1, bins // 2 + 1)]
    for a in range(1, bins // 3 + 1):
        rows += [(a, b, bins - a - b) for b in range(a, (bins - a) // 2 + 1)]
    return np.array(rows, np.int64)


def nonnegative_least_squares(combos: np.ndarray, target: np.ndarray, rounds: int = 4000, near: float = 1e-5) -> np.ndarray:
    """x >= 0 that brings the use of each bin near ``target``, by accelerated projected gradients, until a round
    changes no count by more than ``near`` of the largest."""
    bins = len(target)
    flat = combos.ravel()
    used = flat > 0
    cols = np.repeat(np.arange(len(combos)), combos.shape[1])[used]
    rows = flat[used] - 1
    weight = np.where(target > 0, 1.0, 4.0)  # overdrawing an empty bin costs more
    scale = max(1.0, float(target.max(initial=0)))
    want = target / scale

    def apply(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows, x[cols], bins)

    def back(y: np.ndarray) -> np.ndarray:
        return np.bincount(cols, y[rows], len(combos))

    probe = np.ones(len(combos))
    for _ in range(30):  # the largest eigenvalue bounds the step
        probe = back(weight * apply(probe))
        norm = float(np.linalg.norm(probe)) or 1.0
        probe /= norm
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, z - back(weight * (apply(z) - want)) / norm)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t_new * (new - x)
        still = np.abs(new - x).max() <= near * new.max()
        x, t = new, t_new
        if still:
            break
    return x * scale


@dataclass
class Plan:
    """Patterns of lengths with how often each is repeated; containers are numbered by pattern."""

    capacity: int
    patterns: list[tuple[dict[int, int], int]]

    @property
    def containers(self) -> int:
        return sum(n for _, n in self.patterns)

    def ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted ``length, first rank, first container, items per container`` of the plan."""
        at: dict[int, int] = defaultdict(int)
        rows, base = [], 0
        for lengths, repeat in self.patterns:
            for length, times in lengths.items():
                rows.append((length, at[length], base, times))
                at[length] += times * repeat
            base += repeat
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def _windows(histogram: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Containers of whole windows, by non-negative least squares; takes its items off the histogram."""
    lengths = np.arange(capacity + 1)
    items = histogram.sum()
    if items == 0:
        return []
    mean = max(1.0, (histogram * lengths).sum() / items)
    windows = max(1, round(capacity / (DEPTH * mean)))
    window = capacity // windows
    step = max(1, -(-window // BINS))
    bins = window // step
    if bins < 1:
        return []
    inside = lengths[1 : bins * step + 1]
    target = np.bincount((inside + step - 1) // step - 1, histogram[inside], bins)
    combos = combinations(bins)
    solved = nonnegative_least_squares(combos, target)
    out = []
    for c in np.argsort(-solved, kind="stable"):
        wanted = int(solved[c] + 0.5)
        if wanted < windows:
            break
        need = defaultdict(int)
        for b in combos[c]:
            if b:
                need[int(b)] += 1
        left = wanted // windows  # containers of this combination
        while left:
            chosen: dict[int, int] = {}
            repeat = left
            for b, times in need.items():
                # the longest length of the step that still has enough for whole containers
                for length in range(b * step, (b - 1) * step, -1):
                    if histogram[length] >= times * windows:
                        chosen[length] = times * windows
                        repeat = min(repeat, int(histogram[length]) // (times * windows))
                        break
                else:
                    repeat = 0
                    break
            if not repeat:
                break
            for length, times in chosen.items():
                histogram[length] -= times * repeat
            out.append((chosen, repeat))
            left -= repeat
    return out


def _greedy(histogram: np.ndarray, capacity: int, started: list[tuple[dict[int, int], int]]) -> list:
    """Longest first into the tightest open space, on counts; ``started`` containers are open too."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    for lengths, repeat in started:
        open_[capacity - sum(k * v for k, v in lengths.items())].append((lengths, repeat))
    spaces = sorted(open_)

    def put(space: int, entry: tuple[dict[int, int], int]) -> None:
        if space not in open_ or not open_[space]:
            i = bisect.bisect_left(spaces, space)
            if i == len(spaces) or spaces[i] != space:
                spaces.insert(i, space)
        open_[space].append(entry)

    for length in range(capacity, 0, -1):
        count = int(histogram[length])
        while count:
            i = bisect.bisect_left(spaces, length)
            while i < len(spaces) and not open_[spaces[i]]:
                spaces.pop(i)
            if i == len(spaces):
                each = capacity // length
                full, rest = divmod(count, each)
                if full:
                    put(capacity - each * length, ({length: each}, full))
                if rest:
                    put(capacity - rest * length, ({length: rest}, 1))
                count = 0
                break
            space = spaces[i]
            lengths, repeat = open_[space].pop()
            each = min(space // length, count)
            take = min(repeat, count // each)
            if repeat > take:
                open_[space].append((lengths, repeat - take))
            grown = dict(lengths)
            grown[length] = grown.get(length, 0) + each
            put(space - each * length, (grown, take))
            count -= each * take
    return [entry for entries in open_.values() for entry in entries]


def plan_packing(histogram: dict[int, int], capacity: int) -> Plan:
    """A plan for items of length 1..capacity given as counts."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    started = _windows(counts, capacity)
    return Plan(capacity, _greedy(counts, capacity, started))


def pack(sizes: DataFrame, specs: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``spec_id, container_id, key, part_no, start_token, n_tokens``: every item of every capacity.

    ``specs`` (``spec_id, capacity``) is a small table of settings. Items above the capacity come
    out in parts 0.., all others as part 0. A size that is null or negative counts as 0. Rows with one
    key are items of their own. A spec with null or non-positive capacity is left out.
    """
    spark = sizes.sparkSession
    settings = [tuple(r) for r in specs.where("capacity > 0 and spec_id is not null").distinct().collect()]
    amount = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0).cast("bigint"))
    base = materialize(
        sizes.select(F.col(key), amount.alias("n")).withColumn("item", F.monotonically_increasing_id()), "sizes"
    )
    shards = max(1, -(-base.count() // SHARD_ROWS))
    kind = dict(sizes.dtypes)[key]
    schema = f"spec_id int, container_id string, {key} {kind}, part_no int, start_token bigint, n_tokens bigint"
    if not settings:
        return spark.createDataFrame([], schema)
    wanted = F.explode(F.array(*(F.struct(F.lit(s).alias("spec_id"), F.lit(c).alias("capacity")) for s, c in settings)))
    each = base.select("*", wanted.alias("s")).select(key, "n", "item", "s.spec_id", F.col("s.capacity").alias("capacity"))
    each = each.withColumn("parts", F.when(F.col("n") > F.col("capacity"), F.expr("n div capacity")).otherwise(0))
    each = each.withColumn("rest", F.col("n") - F.col("parts") * F.col("capacity"))
    # a part that ends with the item leaves no rest to place
    each = each.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int"))
    placed = each.where("rest > 0 or n = 0")
    counts = placed.groupBy("spec_id", "rest", "shard").agg(F.count("*").alias("c"))
    counts = materialize(counts, "counts")
    plans = {}
    for spec_id, capacity in settings:
        rows = counts.where(F.col("spec_id") == spec_id).groupBy("rest").agg(F.sum("c").alias("c"))
        # at most one row for each length up to the capacity
        plans[spec_id] = plan_packing({r["rest"]: r["c"] for r in rows.where("rest > 0").collect()}, capacity)
    shared = spark.sparkContext.broadcast({s: (p.containers, *p.ranges()) for s, p in plans.items()})
    in_shard = Window.partitionBy("spec_id", "rest").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("spec_id", "rest", "shard", F.coalesce(F.sum("c").over(in_shard), F.lit(0)).alias("before"))
    order = Window.partitionBy("spec_id", "rest", "shard").orderBy("item")
    ranked = placed.withColumn("place", F.row_number().over(order)).join(before, ["spec_id", "rest", "shard"])
    ranked = ranked.select(
        "spec_id", key, F.col("parts").cast("int").alias("part_no"), (F.col("n") - F.col("rest")).alias("start_token"),
        F.col("rest").alias("n_tokens"), (F.col("before") + F.col("place") - 1).alias("rank"),
    )

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spec = batch.column("spec_id").to_numpy(zero_copy_only=False)
            length = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            number = np.zeros(len(spec), np.int64)
            for s in np.unique(spec):
                containers, lengths, firsts, bases, each_ = shared.value[int(s)]
                mine = spec == s
                real = mine & (length > 0)
                # keys of the plan are sorted by length, then first rank
                at = np.searchsorted(lengths * (1 << 42) + firsts, length[real] * (1 << 42) + rank[real], "right") - 1
                number[real] = bases[at] + (rank[real] - firsts[at]) // each_[at]
                empty = mine & (length == 0)
                number[empty] = rank[empty] % max(1, containers)
            names = pa.array(number).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("spec_id"), names, *(batch.column(i) for i in range(1, 5))],
                names=["spec_id", "container_id", *batch.schema.names[1:5]],
            )

    rests = ranked.mapInArrow(locate, schema)
    part = F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))
    whole = each.where("parts > 0").select("*", part.alias("part_no")).select(
        "spec_id",
        F.concat(F.lit("x"), F.col("item").cast("string"), F.lit("-"), F.col("part_no").cast("string")).alias("container_id"),
        key,
        "part_no",
        (F.col("part_no") * F.col("capacity")).cast("bigint").alias("start_token"),
        F.col("capacity").cast("bigint").alias("n_tokens"),
    )
    return rests.unionByName(whole)


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_id, capacity, n_items, n_containers, n_tokens, fill`` of a packing."""
    used = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("i"))
    per = used.groupBy("spec_id").agg(
        F.sum("i").alias("n_items"), F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest")
    )
    return per.join(specs.select("spec_id", "capacity").distinct(), "spec_id").select(
        "spec_id", "capacity", "n_items", "n_containers", "n_tokens", "fullest",
        F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6).alias("fill"),
    )
