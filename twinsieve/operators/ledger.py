"""A numbered list of small records in a folder, each added by one atomic step."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from twinsieve.runtime import filesystem, names_in, publish, read_text


class CommitConflict(RuntimeError):
    """Another writer added this number first."""


class Ledger:
    """Files ``<number>.json`` under a folder. A record is there whole or not at all, and a number is given once:
    of two writers that add the same one, the second gets :class:`CommitConflict`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:09d}.json"

    def numbers(self) -> list[int]:
        names = names_in(self.spark, self.folder)
        return [int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")]

    def read(self, number: int) -> dict:
        return json.loads(read_text(self.spark, self._path(number)))

    def records(self) -> list[tuple[int, dict]]:
        return [(n, self.read(n)) for n in self.numbers()]

    def last(self) -> tuple[int, dict | None]:
        """The highest number and its record; 0 and None where there is none."""
        known = self.numbers()
        return (known[-1], self.read(known[-1])) if known else (0, None)

    def add(self, number: int, record: dict) -> None:
        if not publish(self.spark, self._path(number), json.dumps(record)):
            raise CommitConflict(f"{self._path(number)} was added by another writer")

    def forget(self, number: int) -> None:
        """Remove a record below the last one."""
        fs, at = filesystem(self.spark, self._path(number))
        fs.delete(at, False)
