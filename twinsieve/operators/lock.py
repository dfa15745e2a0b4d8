"""One run at a time over a data folder."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import SparkSession

from twinsieve.operators.ledger import CommitConflict, Ledger


class Locked(RuntimeError):
    """Another run holds the lock."""


class LockLost(RuntimeError):
    """The lock was taken by another run, as it had not been renewed in time."""


class RunLock:
    """A lock kept as a ledger: taking, renewing and giving back each add one numbered record, which only one of
    several writers can. A lock that was not renewed for ``stale_after`` seconds can be taken.

    As a context manager it renews itself from a thread of its own; :meth:`check` raises once it was lost,
    and a run calls it before it writes.
    """

    def __init__(self, spark: SparkSession, folder: str, stale_after: float = 900.0):
        self.ledger, self.stale_after = Ledger(spark, f"{folder.rstrip('/')}/run.lock"), stale_after
        self.token = uuid.uuid4().hex
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None
        self._lost = False

    def _add(self, number: int, held: bool) -> bool:
        try:
            self.ledger.add(number, {"token": self.token, "at": time.time(), "held": held})
        except CommitConflict:
            return False
        for old in self.ledger.numbers():
            if old < number - 1:
                self.ledger.forget(old)
        return True

    def acquire(self) -> bool:
        number, last = self.ledger.last()
        if last and last["held"] and time.time() - last["at"] <= self.stale_after:
            return False
        return self._add(number + 1, True)

    def renew(self) -> None:
        number, last = self.ledger.last()
        if not last or last["token"] != self.token or not last["held"] or not self._add(number + 1, True):
            self._lost = True
            raise LockLost(self.ledger.folder)

    def check(self) -> None:
        _, last = self.ledger.last()
        if self._lost or not last or last["token"] != self.token or not last["held"]:
            raise LockLost(self.ledger.folder)

    def release(self) -> None:
        number, last = self.ledger.last()
        if last and last["token"] == self.token and last["held"]:
            self._add(number + 1, False)

    def _keep(self) -> None:
        while not self._stop.wait(self.stale_after / 3):
            try:
                self.renew()
            except LockLost:
                return
            except Exception:  # the file system may answer again; if not, the lock goes stale
                continue

    def __enter__(self) -> "RunLock":
        if not self.acquire():
            raise Locked(self.ledger.folder)
        self._stop.clear()
        self._thread = threading.Thread(target=self._keep, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        if self._thread is not None:
            self._thread.join()
        self.release()
