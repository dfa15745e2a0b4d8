"""Seeded MinHash signatures of character 3-grams, their bands and their similarity."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsieve.config import NUM_BANDS, NUM_PERM, ROWS_PER_BAND, SEED
from twinsieve.functions.grams import gram_set, gram_text

_MASK = (1 << 64) - 1
# Offset and multiplier of the item hash.
HASH_OFFSET = 0xCBF29CE484222325
HASH_PRIME = 0x100000001B3


def item_hash(data: bytes) -> int:
    """h = h * prime + word over 8-byte little-endian words, then over the bytes left, mod 2^64."""
    h = HASH_OFFSET
    whole = len(data) & ~7
    for i in range(0, whole, 8):
        h = (h * HASH_PRIME + int.from_bytes(data[i : i + 8], "little")) & _MASK
    for byte in data[whole:]:
        h = (h * HASH_PRIME + byte) & _MASK
    return h


def _splitmix(state: int):
    while True:
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        yield z ^ (z >> 31)


def _xoshiro(seed: int):
    """The public xoshiro256++ generator, its state filled by SplitMix64."""
    fill = _splitmix(seed)
    s = [next(fill) for _ in range(4)]
    rotl = lambda x, k: ((x << k) | (x >> (64 - k))) & _MASK
    while True:
        yield (rotl((s[0] + s[3]) & _MASK, 23) + s[0]) & _MASK
        t = (s[1] << 17) & _MASK
        s[2] ^= s[0]
        s[3] ^= s[1]
        s[1] ^= s[2]
        s[0] ^= s[3]
        s[2] ^= t
        s[3] = rotl(s[3], 45)


@lru_cache(maxsize=8)
def permutations(num_perm: int = NUM_PERM, seed: int = SEED) -> tuple[tuple[int, int], ...]:
    """``(a, b)`` of every slot; a is odd."""
    stream = _xoshiro(seed)
    return tuple((next(stream) | 1, next(stream)) for _ in range(num_perm))


_gram_hashes: dict[int, int] = {}


def _hash_of(gram: int) -> int:
    h = _gram_hashes.get(gram)
    if h is None:
        if len(_gram_hashes) >= 1_000_000:
            _gram_hashes.clear()
        h = _gram_hashes[gram] = item_hash(gram_text(gram).encode("utf-8", "surrogatepass"))
    return h


def signatures(normalized: list[str], raw: list[str], num_perm: int = NUM_PERM, seed: int = SEED) -> np.ndarray:
    """One row of ``num_perm`` minima for each text; a text without letters hashes its raw bytes."""
    sets = [gram_set(t) for t in normalized]
    grams, where = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)
    hashes = [_hash_of(int(g)) for g in grams]
    bare = [i for i, s in enumerate(sets) if not len(s)]
    hashes += [item_hash(raw[i].encode("utf-8", "surrogatepass")) for i in bare]
    place = {i: len(grams) + k for k, i in enumerate(bare)}
    order, sizes, at = [], [], 0
    for i, s in enumerate(sets):
        order.append(where[at : at + len(s)] if len(s) else np.array([place[i]]))
        sizes.append(max(1, len(s)))
        at += len(s)
    items = np.concatenate(order)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    h = np.array(hashes, np.uint64)
    out = np.empty((len(sets), num_perm), np.int64)
    for k, (a, b) in enumerate(permutations(num_perm, seed)):
        slot = ((h * np.uint64(a) + np.uint64(b)) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(slot[items], starts)
    return out


def signature_udf(seed: int = SEED, num_perm: int = NUM_PERM):
    """Arrow UDF of (normalized, content) to the signature, an array of ``num_perm`` 32-bit values."""

    def sign(normalized: pd.Series, content: pd.Series) -> pd.Series:
        out: list = []
        for at in range(0, len(normalized), 2000):
            part = slice(at, at + 2000)
            out += list(signatures(list(normalized[part].fillna("")), list(content[part].fillna("")), num_perm, seed))
        return pd.Series(out)

    return F.pandas_udf(sign, "array<bigint>")


def signature_jaccard(a: Column, b: Column) -> Column:
    """Share of equal slots; 0.0 where lengths differ or are zero."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), equal / F.size(a)).otherwise(F.lit(0.0))


def band_slices(sig: Column, bands: int = NUM_BANDS, rows: int = ROWS_PER_BAND) -> Column:
    """Array of ``(band, key)``: the slots of a band are its key, so keys never collide."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.struct(
            b.cast("int").alias("band"), F.array_join(F.slice(sig, b * rows + 1, rows).cast("array<string>"), "-").alias("key")
        ),
    )


def band_hashes(sig: Column, bands: int = NUM_BANDS, rows: int = ROWS_PER_BAND) -> Column:
    """Array of one 64-bit number for each band, which covers the band's position too."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice(sig, b * rows + 1, rows)))


def valid_signature(sig: Column, num_perm: int = NUM_PERM) -> Column:
    return F.size(sig) == num_perm
