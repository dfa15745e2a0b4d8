"""Settings of the deduplication pipeline, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the index format.
NUM_PERM = 128
NUM_BANDS = 16
ROWS_PER_BAND = 8
NGRAM_WIDTH = 3
SEED = 42
TOKENIZER_VERSION = 2
HASH_VERSION = 1


@dataclass(frozen=True)
class DedupeConfig:
    """``batch_size``: rows that a database source reads or writes at a time. ``large_bucket_limit``: buckets that the
    report of large buckets lists; cluster search looks at all, however many."""

    threshold: float = 0.8
    size_diff: float = 0.3
    seed: int = SEED
    num_bands: int = NUM_BANDS
    rows_per_band: int = ROWS_PER_BAND
    min_content_length: int = 500
    process_all: bool = False
    fresh: bool = False
    skip_write: bool = False
    max_matches_per_doc: int | None = None
    edge_lookup: str = "auto"
    pathological_min_bucket: int = 1000
    pathological_min_bands: int = 14
    large_bucket_limit: int = 10_000
    batch_size: int = 10_000

    def __post_init__(self):
        checks = (
            (0.0 <= self.threshold <= 1.0, "threshold must lie in [0, 1]"),
            (self.size_diff >= 0.0, "size_diff must not be negative"),
            (self.min_content_length >= 0, "min_content_length must not be negative"),
            (self.max_matches_per_doc is None or self.max_matches_per_doc > 0, "max_matches_per_doc must be positive"),
            (self.large_bucket_limit > 0, "large_bucket_limit must be positive"),
            (self.batch_size > 0, "batch_size must be positive"),
            (self.edge_lookup in ("scan", "index", "auto", "shadow"), "edge_lookup is scan, index, auto or shadow"),
            (self.pathological_min_bucket > 1, "pathological_min_bucket must be above 1"),
            (self.num_bands > 0 and self.rows_per_band > 0, "num_bands and rows_per_band must be positive"),
            (self.num_bands * self.rows_per_band <= NUM_PERM, "bands hold more rows than a signature has"),
            (1 <= self.pathological_min_bands <= max(NUM_BANDS, self.num_bands), "pathological_min_bands must not exceed the bands"),
        )
        for good, message in checks:
            if not good:
                raise ValueError(message)
