"""Invented documents for demonstrations and load tests, made on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYLLABLES = "ka lo mi ren su ta vel no dri pas hem ul ger bo fin qua".split()


def demo_documents(spark: SparkSession, groups: int = 50, copies: int = 3, singles: int = 50, words: int = 140, edits: int = 40, seed: int = 1) -> DataFrame:
    """``id, content, content_len, filename, is_parent``: ``groups`` texts with ``copies`` each, of which about one word
    in ``edits`` differs, and ``singles`` that have none. The same arguments give the same rows."""
    number = F.col("number")
    rows = spark.range(groups * copies + singles).withColumnRenamed("id", "number")
    rows = rows.select("number", F.when(number < groups * copies, F.floor(number / F.lit(copies))).otherwise(number).alias("text"))
    pick = lambda *of: F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(len(SYLLABLES))).cast("int")
    table = F.array(*(F.lit(s) for s in SYLLABLES))

    def word(i):
        other = (F.pmod(F.xxhash64(F.lit(seed), "number", i), F.lit(edits)) == 0) & (number < groups * copies)
        of = F.when(other, -number - 1).otherwise(F.col("text"))
        return F.concat(*(F.get(table, pick(of, i, F.lit(k))) for k in range(3)))

    content = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), word), " ")
    made = rows.select(F.format_string("doc-%012d", "number").alias("id"), content.alias("content"))
    return made.select(
        "id", "content", F.char_length("content").alias("content_len"), F.concat("id", F.lit(".txt")).alias("filename"),
        F.lit(None).cast("boolean").alias("is_parent"),
    )
