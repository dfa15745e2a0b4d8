"""Continuous dedupe: documents arrive as a stream, each micro-batch is matched against all history.

The stream's checkpoint makes every batch come again after a failure with the same number and rows. The
batch's tables are written under that number and replaced when it comes again, and the source
of truth is only marked at the batch's end, so a batch takes effect once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinsieve.config import DedupeConfig
from twinsieve.plans.pipeline import DedupePipeline
from twinsieve.sources.table import TableSource


class StreamingDedupe:
    """Feeds a :class:`DedupePipeline` over a table source from a stream of documents."""

    def __init__(self, spark: SparkSession, folder: str, config: DedupeConfig = DedupeConfig()):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config
        self.source = TableSource(spark, f"{self.folder}/tables")

    def batch(self, docs: DataFrame, number: int) -> None:
        name = f"batch-{number:09d}"
        docs = docs.select("id", "content", "content_len", "filename")
        known = self.source.states.read()
        if known is None:
            blank = docs.withColumn("is_parent", F.lit(None).cast("boolean"))
            TableSource.create(self.spark, f"{self.folder}/tables", blank)
        else:
            # a document that came before keeps its state; this batch's own rows may come again
            before = known.where(F.col("part") != TableSource.part_name(name)).select("id")
            self.source.add(docs.join(before, "id", "left_anti"), name)
        DedupePipeline(self.spark, self.source, f"{self.folder}/state", self.config).run(name)

    def start(self, stream: DataFrame, interval: str | None = None) -> StreamingQuery:
        """Run until everything there now was taken, or every ``interval``."""
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.folder}/checkpoint")
        trigger = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
        return trigger.start()
