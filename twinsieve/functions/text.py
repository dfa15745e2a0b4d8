"""Text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(text: Column) -> Column:
    """Lower case, each run of characters other than letters and digits one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def normalize_content(text: Column) -> Column:
    """As :func:`plain`, by the Unicode property Alphabetic, and letter by letter: a final sigma stays
    a plain one."""
    lowered = F.lower(F.translate(text, "Σ", "σ"))
    return F.trim(F.regexp_replace(lowered, r"[^\p{IsAlphabetic}\p{N}]+", " "))


def char_ngrams(normalized: Column, width: int = 3) -> Column:
    """Overlapping n-grams, repeats kept; a text no longer than ``width`` is one, an empty one none.

    The text is split into characters once, and the array joined with itself moved by one and so on.
    Taking substrings or array items by position inside a lambda would split the text again for each.
    """
    if width < 1:
        raise ValueError("width must be positive")
    chars = F.filter(F.split(normalized, ""), lambda c: c != "")
    size = F.size(chars)
    grams = chars
    for k in range(1, width):
        grams = F.zip_with(grams, F.slice(chars, k + 1, F.greatest(size, F.lit(1))), lambda x, y: F.concat(x, y))
    return (
        F.when(normalized.isNull(), F.lit(None))
        .when(size == 0, F.array().cast("array<string>"))
        .when(size <= width, F.array(normalized))
        .otherwise(F.slice(grams, 1, F.greatest(size - (width - 1), F.lit(0))))
    )


def n_lines(text: Column) -> Column:
    """Lines of a text: line feeds and one more."""
    return F.length(F.regexp_replace(text, r"[^\n]+", "")) + 1


def unicode_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def is_boilerplate(content: Column, patterns: list[str] | tuple[str, ...] = (), max_lines: int = 20, min_mean: int = 20) -> Column:
    """Blank contents, contents with one of the literal patterns, and long lists of very short lines."""
    trimmed = unicode_trim(content)
    lines = n_lines(trimmed)
    found = (trimmed == "") | ((lines > max_lines) & (F.octet_length(trimmed) / lines < min_mean))
    for p in patterns:
        found = found | F.contains(content, F.lit(p))
    return F.coalesce(found, F.lit(True))


def parse_junk_patterns(text: str) -> list[str]:
    """Patterns of a text file: blank lines and those after ``#`` are left out, ``\\n`` is a line end."""
    lines = (line.strip() for line in text.splitlines())
    return [line.replace("\\n", "\n") for line in lines if line and not line.startswith("#")]


def size_within(a: Column, b: Column, limit: float) -> Column:
    """Sizes are close: their difference over the larger is at most ``limit``; a zero passes."""
    big = F.greatest(a, b)
    return (a == 0) | (b == 0) | ((big - F.least(a, b)) / big <= limit)


def size_difference_pct(a: Column, b: Column) -> Column:
    big = F.greatest(a, b)
    return F.when(big == 0, F.lit(0.0)).otherwise(F.abs(a - b) / big)
