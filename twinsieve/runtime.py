"""Session helpers: the shared scratch folder, written intermediate tables, small files, table reading.

Iterative operators cut their lineage with :func:`materialize`, which writes a table to the folder
that the cluster names in ``spark.checkpoint.dir``. Every executor can read it again after another
executor was lost, which a block kept on one executor's disk would not survive.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


class NoSharedFolder(RuntimeError):
    """A cluster without a folder that all executors share."""


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``.

    Where that is unset, one of our own on this machine, which only a session in one process can use:
    any other master is refused, as its executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master or ""
        if master.split("[")[0] != "local":
            raise NoSharedFolder(f"master {master!r} needs spark.checkpoint.dir, a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="twinsieve-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder, which is removed when the process or :func:`scratch` ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-tables/{tag}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the intermediate tables that were written within; a long-lived process runs its rounds in it."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            remove(_written[path], path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path objects of a path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)
    _written.pop(path, None)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = filesystem(spark, path)
    return fs.exists(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where it doesn't exist."""
    fs, at = filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = filesystem(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put(fs, at, text: str, overwrite: bool) -> None:
    out = fs.create(at, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its whole content, or return False where there is one; one of several wins.

    Local files are linked from a draft, which fails where the name is taken. File systems with a
    rename of their own (HDFS and its kin) refuse to rename onto a file. Object stores put a whole object at
    once; they decide between two writers only where their connector creates conditionally.
    """
    fs, at = filesystem(spark, path)
    fs.mkdirs(at.getParent())
    scheme = fs.getUri().getScheme()
    if scheme in ("s3a", "s3", "s3n", "gs", "oss", "cosn", "swift", "wasb", "wasbs"):
        try:
            _put(fs, at, text, False)
        except Exception as e:
            if "exist" in str(e).lower() or "412" in str(e):
                return False
            raise
        return True
    _, draft = filesystem(spark, f"{str(at.getParent())}/.{uuid.uuid4().hex}")
    _put(fs, draft, text, False)
    if scheme == "file":
        try:
            os.link(draft.toUri().getPath(), at.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(draft, False)
    if not fs.exists(at) and fs.rename(draft, at):
        return True
    fs.delete(draft, False)
    return False


class Written:
    """A DataFrame that was written to the shared folder; ``drop()`` deletes it.

    ``fingerprint`` is the row count and an order-free checksum of a table without repeated rows, where
    it was asked for; equal means unchanged."""

    def __init__(self, spark: SparkSession, path: str, df: DataFrame, fingerprint: tuple[int, int] | None = None):
        self.spark, self.path, self.df, self.fingerprint = spark, path, df, fingerprint

    def drop(self) -> None:
        remove(self.spark, self.path)


def write_out(df: DataFrame, tag: str, fingerprint: bool = False) -> Written:
    """Run the plan and keep its rows in the shared folder; a fingerprint is taken as the rows pass."""
    spark, schema = df.sparkSession, df.schema
    ship(spark)
    path, seen = new_path(spark, tag), None
    if fingerprint:
        seen = Observation()
        row = F.xxhash64(*df.columns).cast("decimal(38,0)")
        df = df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(row).alias("s"))
    df.write.option("compression", "zstd").parquet(path)  # read soon and few times: size counts
    mark = (int(seen.get["n"]), int(seen.get["s"] or 0)) if seen is not None else None
    return Written(spark, path, spark.read.schema(schema).parquet(path), mark)


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Run the plan once and go on from the written table."""
    return write_out(df, tag).df


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Removes the shuffle files of each query that runs within as the query ends, not when the driver's garbage is
    collected. A DataFrame that ran within must not run a second time; go on from what it wrote."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already
            pass


atexit.register(_clean)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors once per application; their workers import it by name."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="twinsieve-"), "twinsieve.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)  # served by the driver, so it need not be on a shared folder
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over all cores where the files scan as fewer partitions than there are cores.

    A scan of many files already has enough partitions; then no exchange is added.
    """
    ship(df.sparkSession)  # what is spread goes to Python workers
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
