"""Queries of this subpackage, for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinsieve.llm import chunks, consolidate, formatting, neardup, packing, pii, survivor, tokens
from twinsieve.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, sf_dir, "corpus_docs"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, sf_dir, "corpus_docs"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.match_groups(table(spark, sf_dir, "dupes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.formatting_copies(table(spark, sf_dir, "corpus_docs"))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.formatting_counts(table(spark, sf_dir, "corpus_docs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.accepted_duplicates(table(spark, sf_dir, "corpus_docs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.survivors(table(spark, sf_dir, "dupes"), table(spark, sf_dir, "corpus_docs"))


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.surviving_records(table(spark, sf_dir, "dupes"), table(spark, sf_dir, "corpus_docs"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def p9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.token_counts(table(spark, sf_dir, "documents"))
    return packing.pack(sizes, table(spark, sf_dir, "pack_specs"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p9_packing(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"), table(spark, sf_dir, "known_names"))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact_personal(table(spark, sf_dir, "documents"), table(spark, sf_dir, "known_names"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p2_found, p2_groups, p3_found, p4_found, p4_counts, p6_found, p7_found, p7_records, p8_ids, p9_packing,
            p9_report, p10_found, p10_redacted,
        )
    }
