"""Byte-pair encoding of whole columns with a public rank file.

Texts are cut where a blank stands before a visible character, which is always a border of the
pattern's pieces. Each distinct unit is encoded once per worker: the pattern splits it into words, and
the new words of a batch are merged together in numpy rounds over one flat array of symbols. In
each round the ranks of all neighbouring pairs are found by binary search over the sorted pair keys, and
every word merges its pairs of lowest rank. Ids of a batch are then gathered from the flat pool.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.runtime import spread

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed by the rank file's publisher, except that white space is spelled out: the regex library
#: counts the four separators U+001C..U+001F as white space, Unicode does not.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: A blank that does not end a run of white space: the texts that hold one are cut by CUT.
ODD = re.compile(rf"[{_SPACE}] (?:[{_SPACE}]|$)")
CUT = re.compile(rf"(?= [^{_SPACE}])")
MOST_UNITS, MOST_IDS = 600_000, 4_000_000


class Encoder:
    """Encodes by a rank file's bytes; keeps what it has encoded within bounds."""

    def __init__(self, ranks: bytes):
        rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.single = np.array([rank[bytes([i])] for i in range(256)], np.int64)
        keys, values = [], []
        for word, number in rank.items():
            for cut in range(1, len(word)):
                left, right = rank.get(word[:cut]), rank.get(word[cut:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    values.append(number)
        order = np.argsort(np.array(keys, np.int64))
        self.pairs, self.merged = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        self.pattern = regex.compile(PATTERN)
        self.none = np.iinfo(np.int64).max
        self._forget()

    def _forget(self) -> None:
        self.units: dict[str, int] = {}  # text after a blank
        self.heads: dict[str, int] = {}  # text as it stands
        self.words: dict[str, np.ndarray] = {}
        self.pool = np.empty(1 << 16, np.int32)
        self.used = 0
        self.starts, self.counts = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)
        self.n = 0

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of words, all merged together in rounds."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_owner = [], []
        while len(ids):
            key = (ids[:-1] << 32) | ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rank = np.where((self.pairs[at] == key) & (owner[:-1] == owner[1:]), self.merged[at], self.none)
            rank = np.append(rank, self.none)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            low = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.append(first, len(ids)))
            open_ = np.repeat(low != self.none, lengths)
            if not open_.all():  # words without a further merge leave the array
                done_ids.append(ids[~open_])
                done_owner.append(owner[~open_])
                ids, owner, rank = ids[open_], owner[open_], rank[open_]
                lengths, low = lengths[low != self.none], low[low != self.none]
                if not len(ids):
                    break
            hit = rank == np.repeat(low, lengths)
            # of hits in a row, every second one: the pair before took its left symbol
            if (hit[1:] & hit[:-1]).any():
                where = np.arange(len(hit))
                begins = hit & ~np.append(False, hit[:-1])
                run = np.maximum.accumulate(np.where(begins, where, -1))
                hit &= (where - run) % 2 == 0
            ids = np.where(hit, rank, ids)
            keep = ~np.append(False, hit[:-1])
            ids, owner = ids[keep], owner[keep]
        all_ids, all_owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(all_owner, kind="stable")
        ends = np.cumsum(np.bincount(all_owner, minlength=len(words)))
        return np.split(all_ids[order].astype(np.int32), ends[:-1])

    def _add(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, max(2 * len(self.pool), self.used + len(ids)))
        if self.n == len(self.starts):
            self.starts, self.counts = np.resize(self.starts, 2 * self.n), np.resize(self.counts, 2 * self.n)
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[self.n], self.counts[self.n] = self.used, len(ids)
        self.used += len(ids)
        self.n += 1
        return self.n - 1

    def _learn(self, units: list[tuple[dict, str, str]]) -> None:
        """Encode units not met before: ``(dictionary, its key, text)``."""
        pieces = [self.pattern.findall(text) for _, _, text in units]
        fresh = list({w for p in pieces for w in p if w not in self.words})
        encoded = [w.encode("utf-8", "surrogatepass") for w in fresh]
        self.words.update(zip(fresh, self.merge_words(encoded)))
        for (target, name, _), p in zip(units, pieces):
            target[name] = self._add(np.concatenate([self.words[w] for w in p]) if len(p) != 1 else self.words[p[0]])

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all texts one after another, and how many each text has."""
        if self.n > MOST_UNITS or self.used > MOST_IDS or len(self.words) > MOST_UNITS:
            self._forget()
        split: list[tuple[list[str], bool]] = []
        new: dict[tuple[bool, str], None] = {}
        for text in texts:
            if not text:
                split.append(([], False))
                continue
            if ODD.search(text):
                parts = CUT.split(text)
                if parts[0] == "":
                    parts = parts[1:]
                new.update(((True, p), None) for p in parts if p not in self.heads)
                split.append((parts, True))
            else:
                parts = text.split(" ")
                if parts[0] == "":  # the text begins with a blank
                    parts = parts[1:]
                    new.update(((False, p), None) for p in parts if p not in self.units)
                    split.append((["", *parts], False))
                    continue
                if parts[0] not in self.heads:
                    new[True, parts[0]] = None
                new.update(((False, p), None) for p in parts[1:] if p not in self.units)
                split.append((parts, False))
        self._learn([(self.heads, p, p) if head else (self.units, p, " " + p) for head, p in new])
        units, heads = self.units.__getitem__, self.heads.__getitem__
        numbers: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, (parts, odd) in enumerate(split):
            before = len(numbers)
            if odd:
                numbers.extend(map(heads, parts))
            elif parts:
                if parts[0]:
                    numbers.append(heads(parts[0]))
                numbers.extend(map(units, parts[1:]))
            counts[i] = len(numbers) - before
        return np.array(numbers, np.int64), counts

    def sizes(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text."""
        numbers, counts = self._numbers(texts)
        sums = np.append(0, np.cumsum(self.counts[numbers]))
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat token ids, and the offsets of the texts in them."""
        numbers, counts = self._numbers(texts)
        lengths = self.counts[numbers]
        ends = np.append(0, np.cumsum(lengths))
        flat = self.pool[np.repeat(self.starts[numbers] - ends[:-1], lengths) + np.arange(ends[-1])]
        return flat, ends[np.append(0, np.cumsum(counts))]


_encoders: dict[int, Encoder] = {}


def _encoder(ranks) -> Encoder:
    """One encoder for each worker process and rank file."""
    value = ranks.value
    number = hash(value)
    if number not in _encoders:
        _encoders[number] = Encoder(value)
    return _encoders[number]


#: Rows encoded together in a worker; keeps its memory small whatever the batch.
STEP = 1000


def _share(df: DataFrame, path: str):
    with open(path, "rb") as file:  # a vocabulary file of under a megabyte, the same for any corpus
        return df.sparkSession.sparkContext.broadcast(file.read())


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``key, ids``: token ids of every text, as it is, without special tokens.

    Strings of special tokens are ordinary text. Empty and null texts both give the empty list; texts
    of any length are encoded whole; repeated rows each give a row; null keys are kept. ``ranks`` is
    the path of a rank file that the driver can read.
    """
    shared = _share(docs, ranks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                flat, offsets = _encoder(shared).encode(batch.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    rows = spread(docs.select(F.col(key), F.col(text)))
    return rows.mapInArrow(encode, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``key, n_tokens``: the size of every text in tokens; null and empty texts have none."""
    shared = _share(docs, ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                sizes = _encoder(shared).sizes(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], names=[key, "n_tokens"])

    rows = spread(docs.select(F.col(key), F.col(text)))
    return rows.mapInArrow(count, f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens bigint")
