"""Comparable documents, and the exact similarity of pairs of texts over their 3-character sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.grams import gram_set
from twinsieve.functions.text import plain

MIN_BYTES = 500
SIMILAR = 0.8


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all; two empty sets share nothing."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) if len(both) else 0.0


def comparable(docs: DataFrame, *keep: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``id, key, plain`` and the columns in ``keep`` of documents above ``min_bytes`` UTF-8 bytes.

    ``key`` is the SHA-256 of the plain text, or of the raw content where no letter or digit is left,
    so that such contents equal only identical ones. Null contents and null ids are left out.
    """
    text = docs.where(F.col("id").isNotNull() & (F.octet_length("content") > min_bytes)).select(
        "id", *keep, "content", plain(F.col("content")).alias("plain")
    )
    key = F.when(F.col("plain") == "", F.concat(F.lit("\0raw:"), "content")).otherwise(F.col("plain"))
    return text.select("id", *keep, F.unhex(F.sha2(key, 256)).alias("key"), "plain")


def similarities(left: list[str], right: list[str]) -> np.ndarray:
    """Exact similarities of texts side by side; sets met before in the same call are kept for a while."""
    kept: dict[str, np.ndarray] = {}

    def of(text: str) -> np.ndarray:
        if text not in kept:
            if len(kept) >= 2000:
                kept.clear()
            kept[text] = gram_set(text)
        return kept[text]

    return np.array([jaccard(of(a), of(b)) for a, b in zip(left, right)], np.float64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = similarities(batch.column("plain_a").to_pylist(), batch.column("plain_b").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(found)], names=["a", "b", "similarity"]
        )


def exact_pairs(pairs: DataFrame, texts: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """``a, b, similarity`` of the pairs at or above the threshold. ``texts`` has ``no, plain``."""
    left = texts.select(F.col("no").alias("a"), F.col("plain").alias("plain_a"))
    right = texts.select(F.col("no").alias("b"), F.col("plain").alias("plain_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.mapInArrow(_compare, "a bigint, b bigint, similarity double").where(F.col("similarity") >= threshold)
