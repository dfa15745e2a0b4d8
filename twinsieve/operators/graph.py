"""Connected components and related graph operators on edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.runtime import write_out

#: Edges that a task contracts at a time, which bounds its memory whatever the size of a partition.
CONTRACTED = 200_000


def _forest(u: list, v: list) -> dict:
    """Every node of the edges with a link towards the smallest node of its component among them."""
    up: dict = {}
    for a, b in zip(u, v):
        while (x := up.setdefault(a, a)) != a:
            up[a] = a = up[x]
        while (x := up.setdefault(b, b)) != b:
            up[b] = b = up[x]
        if a < b:
            up[b] = a
        elif b < a:
            up[a] = b
    for a in up:
        root = a
        while up[root] != root:
            root = up[root]
        while up[a] != root:
            up[a], a = root, up[a]
    return up


def _contract(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    def stars(u: list, v: list, schema: pa.Schema) -> pa.RecordBatch:
        rows = [(a, b) for a, b in _forest(u, v).items() if a != b]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.types[k]) for k in (0, 1)], names=["u", "v"])

    u, v, schema = [], [], None
    for batch in batches:
        schema = batch.schema
        u += batch.column(0).to_pylist()
        v += batch.column(1).to_pylist()
        while len(u) >= most:
            yield stars(u[:most], v[:most], schema)
            u, v = u[most:], v[most:]
    if u:
        yield stars(u, v, schema)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    links = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.union(low.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v``, which is no ``u`` itself: then each star is a whole component."""
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("downs")),
    )
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return nodes.where("ups > 1 or (ups = 1 and downs = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str = "u", b: str = "v", max_rounds: int = 100) -> DataFrame:
    """``node, root``: every node of an undirected edge table with the smallest node of its component.

    Each task first replaces the edges it holds, a bounded number at a time, by stars of their own components.
    Then large-star and small-star alternate until every component is one star, which takes a number
    of rounds logarithmic in the number of nodes. A hot node's edges are joined to one small row per
    node, which adaptive execution splits where the partition is skewed, and no node's neighbours are
    ever gathered into one row. Self-edges give their node its own component; null ends are left out.
    """
    base = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    links = base.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    most = CONTRACTED
    now = write_out(links.mapInArrow(lambda batches: _contract(batches, most), links.schema), "edges")
    for _ in range(max_rounds):
        if _are_stars(now.df):
            break
        now, old = write_out(_small_star(_large_star(now.df)), "stars"), now
        old.drop()
    else:
        raise RuntimeError(f"components were not stable after {max_rounds} rounds")
    rows = now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.df.select("v", "v").distinct())
    return rows.union(base.where("u = v")).groupBy("node").agg(F.min("root").alias("root"))
