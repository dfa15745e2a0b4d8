"""The persistent edge table, its adjacency index, and the edges connected to given seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.operators.graph import connected_components
from twinsieve.operators.matching import EDGE, edge_of_child, upsert_edges
from twinsieve.runtime import exists, filesystem, materialize, names_in


def adjacency(edges: DataFrame) -> DataFrame:
    """``node, other`` and the edge's columns: two rows for each real edge, none for self-edges."""
    real = edges.where("child_id <> parent_id").select(*EDGE)
    ends = F.array(
        F.struct(F.col("child_id").alias("node"), F.col("parent_id").alias("other")),
        F.struct(F.col("parent_id").alias("node"), F.col("child_id").alias("other")),
    )
    return real.select(F.inline(ends), *EDGE)


MEASURES = "jaccard_similarity double, size_difference int, size_difference_pct double"


class LookupMismatch(RuntimeError):
    """Both ways of finding connected edges gave different sets."""


def reachable(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node``: the seeds and everything linked to them; the first two columns of ``links`` are ends of links.

    The components of the links, of which those that hold a seed are taken: a number of rounds logarithmic in
    the number of nodes, however long the chains are.
    """
    wanted = seeds.select(F.col(seeds.columns[0]).alias("node")).where("node is not null").distinct()
    found = materialize(connected_components(links, *links.columns[:2]), "components")
    hit = found.join(wanted, "node", "left_semi").select("root").distinct()
    return found.join(hit, "root", "left_semi").select("node").union(wanted).distinct()


def node_bucket(node: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def reachable_in_index(index: DataFrame, seeds: DataFrame, buckets: int, hops: int = 3) -> tuple[DataFrame, list[int] | None]:
    """As :func:`reachable` over an adjacency table in folders by ``bucket``, reading only folders that a hop
    needs; and the folders of all nodes found. Once a hop needs half of the folders, or after ``hops`` of
    them, the whole index is taken up by components instead (and None given for the folders), so long chains
    don't cost a round for each link; the nodes are the same either way.
    """
    seen = seeds.select(F.col(seeds.columns[0]).alias("node")).where("node is not null").distinct()
    seen = front = materialize(seen, "seen")
    read: set[int] = set()
    for _ in range(hops):
        # at most `buckets` numbers
        folders = [r[0] for r in front.select(node_bucket("node", buckets).alias("b")).distinct().collect()]
        read.update(folders)
        if not folders:
            return seen, sorted(read)
        if 2 * len(folders) >= buckets:
            break
        step = index.where(F.col("bucket").isin(folders)).join(front, "node", "left_semi").select(F.col("other").alias("node"))
        front = materialize(step.distinct().join(seen, "node", "left_anti"), "front")
        seen = materialize(seen.union(front), "seen")
    return reachable(index.where("node < other").select("node", "other"), seen), None


def connected_edges(
    edges: DataFrame, seeds: DataFrame, lookup: str = "scan", index: DataFrame | None = None, buckets: int | None = None
) -> DataFrame:
    """Real edges in components that hold a seed.

    ``scan`` takes the components of the edge table, ``index`` reads the adjacency table given, by its
    ``bucket`` folders where ``buckets`` says that it has them, ``auto`` uses the index if there is one,
    and ``shadow`` runs both and compares the sets.
    """
    if lookup == "shadow":
        if index is None:
            raise ValueError("shadow needs an index")
        a, b = (materialize(connected_edges(edges, seeds, way, index, buckets), "way") for way in ("scan", "index"))
        marked = a.withColumn("n", F.lit(1)).unionByName(b.withColumn("n", F.lit(-1)))
        if not marked.groupBy(*EDGE).agg(F.sum("n").alias("n")).where("n <> 0").isEmpty():
            raise LookupMismatch("scan and index differ")
        return a
    if lookup == "index" and index is None:
        raise ValueError("there is no adjacency index")
    real = edges.where("child_id <> parent_id").select(*EDGE)
    if index is not None and lookup in ("index", "auto"):
        at_smaller = index.where("node < other")
        if buckets is None:
            nodes = reachable(at_smaller.select("node", "other"), seeds)
        else:
            nodes, folders = reachable_in_index(index, seeds, buckets)
            if folders is not None:
                at_smaller = at_smaller.where(F.col("bucket").isin(folders))
        mine = at_smaller.join(nodes, "node", "left_semi")
        return upsert_edges(None, mine)  # each edge is taken at its smaller end; several batches may hold it
    nodes = reachable(real, seeds)
    return real.join(nodes.withColumnRenamed("node", "child_id"), "child_id", "left_semi")


class EdgeStore:
    """Edges under a folder: each batch a directory, replaced when written again.

    Readers see one row per (child, parent), the most similar. The adjacency index holds the edges by
    node, a directory for each batch with one folder for each of ``buckets`` hash classes of nodes, so that indexing a
    new batch leaves the old ones alone and a lookup of few seeds reads few folders; it is
    used only while it covers all batches. ``compact`` merges the batches of both.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _done(self, table: str) -> list[str]:
        at = f"{self.folder}/{table}"
        return [n for n in names_in(self.spark, at) if exists(self.spark, f"{at}/{n}/_SUCCESS")]

    def batches(self) -> list[str]:
        return self._done("edges")

    def _remove(self, path: str) -> None:
        fs, at = filesystem(self.spark, f"{self.folder}/{path}")
        fs.delete(at, True)

    def insert(self, edges: DataFrame, batch: str) -> None:
        self._remove(f"adjacency/{batch}")  # it would no longer be the batch's
        edges.select(*EDGE).write.mode("overwrite").parquet(f"{self.folder}/edges/{batch}")

    def edges(self) -> DataFrame | None:
        paths = [f"{self.folder}/edges/{n}" for n in self.batches()]
        return upsert_edges(None, self.spark.read.parquet(*paths)) if paths else None

    def count(self) -> int:
        found = self.edges()
        return 0 if found is None else found.count()

    def real_edges(self) -> DataFrame | None:
        found = self.edges()
        return None if found is None else found.where("child_id <> parent_id")

    def best_of(self, children: DataFrame) -> DataFrame | None:
        """The best real edge of each of the given ``id`` rows."""
        found = self.real_edges()
        if found is None:
            return None
        return edge_of_child(found.join(children.select(F.col("id").alias("child_id")).distinct(), "child_id", "left_semi"))

    def contains(self, pairs: DataFrame) -> DataFrame:
        """``child_id, parent_id`` rows of ``pairs`` that are stored."""
        found = self.edges()
        wanted = pairs.select("child_id", "parent_id").distinct()
        return wanted.limit(0) if found is None else wanted.join(found.select("child_id", "parent_id"), ["child_id", "parent_id"])

    def clear(self) -> None:
        self._remove("edges")
        self._remove("adjacency")

    def compact(self, batch: str) -> None:
        """Rewrite all batches as one of one row per edge; the old ones go once the new one is whole."""
        found, old = self.edges(), self.batches()
        if found is None or old == [batch]:
            return
        self.insert(materialize(found, "edges"), batch)
        for name in old:
            if name != batch:
                self._remove(f"edges/{name}")
                self._remove(f"adjacency/{name}")
        self.build_adjacency()

    def build_adjacency(self) -> bool:
        """Index the batches that are not yet; False where there are none."""
        missing = sorted(set(self.batches()) - set(self._done("adjacency")))
        for name in missing:
            found = adjacency(self.spark.read.parquet(f"{self.folder}/edges/{name}"))
            found = found.withColumn("bucket", node_bucket("node", self.buckets)).repartition("bucket").sortWithinPartitions("bucket", "node")
            found.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/adjacency/{name}")
        return bool(missing)

    def index(self) -> DataFrame | None:
        names = self._done("adjacency")
        if not names or names != self.batches():
            return None
        at = f"{self.folder}/adjacency"
        schema = f"node {self._kind()}, other {self._kind()}, child_id {self._kind()}, parent_id {self._kind()}, {MEASURES}, bucket int"
        parts = [self.spark.read.schema(schema).option("basePath", f"{at}/{n}").parquet(f"{at}/{n}") for n in names]
        return reduce(DataFrame.unionByName, parts)

    def _kind(self) -> str:
        return self.spark.read.parquet(f"{self.folder}/edges/{self.batches()[0]}").schema["child_id"].dataType.simpleString()

    def connected(self, seeds: DataFrame, lookup: str = "auto") -> DataFrame | None:
        found = self.edges()
        return None if found is None else connected_edges(found, seeds, lookup, self.index(), self.buckets)
