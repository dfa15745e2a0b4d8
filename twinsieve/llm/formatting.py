"""Records that are equal but for formatting: collapse raw copies, canonicalise survivors, group again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.text import plain
from twinsieve.runtime import materialize

MIN_FIELDS = 4
SEPARATORS = ("\n", r"\|", ";")
#: A field begins with its name and a colon. A name is a label of any length on one line: text in which a
#: clause or sentence ends is none, though a line of prose may hold a colon too.
NAME = r"^\s*([^:：\n,;!?。，；！？]+)[:：]"
ENDED = r"\.\s+\S"
NAMED = r"[\p{L}\p{N}]"


def _segments(content: Column, separator: str) -> Column:
    parts = F.split(F.regexp_replace(content, r"\r\n?", "\n"), separator)
    return F.filter(parts, lambda p: F.regexp_replace(p, r"[\s\p{Z}]+", "") != "")


def _fields(content: Column, separator: str) -> Column:
    """The canonical form of a record of fields under one separator, null where it isn't one."""
    parts = _segments(content, separator)
    name = lambda p: plain(F.regexp_extract(p, NAME, 1))
    value = lambda p: plain(F.regexp_replace(p, NAME, ""))
    label = lambda n: n.rlike(NAMED) & ~n.rlike(ENDED)
    wholly = F.forall(parts, lambda p: label(F.regexp_extract(p, NAME, 1)))
    each = F.array_sort(F.transform(parts, lambda p: F.concat(name(p), F.lit("\x1f"), value(p))))
    return F.when((F.size(parts) >= MIN_FIELDS) & wholly, F.concat(F.lit("fields\x1e"), F.array_join(each, "\x1e")))


def canonical(content: Column) -> Column:
    """Equal for records that are equal but for letter case, white space, punctuation and field order.

    A content made wholly of four or more ``name: value`` fields, divided by line ends, bars or
    semicolons, becomes its sorted fields; any other content its words in order. Names, values and
    words are in lower case with each run of other characters one blank. A name has a letter or digit, stands
    on one line and holds no comma, semicolon, exclamation or question mark and no full stop before a blank; its
    length doesn't matter.
    """
    record = F.coalesce(*(_fields(content, s) for s in SEPARATORS))
    return F.coalesce(record, F.concat(F.lit("prose\x1e"), plain(content)))


def collapse(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``raw, records``: classes of identical contents, written, and those grouped on canonical text.

    raw: ``digest, keep_raw, n_raw, canon, form``; records: ``canon, keep_id, copies``. Null contents
    and those without letter or digit are left out, as are null ids.
    """
    rows = docs.where(F.col("id").isNotNull() & F.col("content").rlike(NAMED)).select("id", "content")
    raw = rows.groupBy("content").agg(F.min("id").alias("keep_raw"), F.count("*").alias("n_raw"))
    raw = raw.select(
        F.unhex(F.sha2("content", 256)).alias("digest"), "keep_raw", "n_raw", canonical(F.col("content")).alias("canon")
    ).withColumn("form", F.unhex(F.sha2("canon", 256)))
    raw = materialize(raw, "raw")
    records = raw.groupBy("canon").agg(F.min("keep_raw").alias("keep_id"), F.sum("n_raw").alias("copies"))
    return raw, records


def formatting_counts(docs: DataFrame) -> DataFrame:
    """``keep_id, copies``: one row for each distinct record, with the number of its rows."""
    return collapse(docs)[1].select("keep_id", "copies")


def formatting_copies(docs: DataFrame) -> DataFrame:
    """``keep_id, copy_id``: the smallest id of each record with every other id of it.

    Only classes of records with several rows are joined back to the ids, on the digest of the raw
    content. Repeated rows of one id give no pair of the id with itself.
    """
    raw, records = collapse(docs)
    several = records.where("copies > 1").select(F.unhex(F.sha2("canon", 256)).alias("form"), "keep_id")
    keep = raw.select("digest", "form").join(several, "form").select("digest", "keep_id")
    rows = docs.where(F.col("id").isNotNull() & F.col("content").isNotNull())
    return (
        rows.select(F.col("id").alias("copy_id"), F.unhex(F.sha2("content", 256)).alias("digest"))
        .join(keep, "digest")
        .where("copy_id <> keep_id")
        .select("keep_id", "copy_id")
        .distinct()
    )
