"""Leases: mutual exclusion between jobs with nothing but the shared folder.

A lease is a folder; each generation of it is one small file with the owner and the time it runs out. The file of the
next generation is created without overwriting, so of all jobs that try at once one wins. An open lease can be taken
only by its owner (which renews it); one that ran out or was released can be taken by anyone. An owner that lost its
lease finds a later generation and must stop.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from quayside.storage import create_exclusive, delete_path, names_in, path_exists, read_text

_RELEASED = "-released"


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class Lease:
    generation: int
    owner: str
    until: dt.datetime
    released: bool = False

    def open_at(self, now: dt.datetime) -> bool:
        return not self.released and self.until > now


class Leases:
    """Leases by name below ``folder``. The clocks of the jobs should agree to much less than a lease lasts."""

    def __init__(self, spark: SparkSession, folder: str, now: Callable[[], dt.datetime] | None = None):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._now = now or utc_now

    def _path(self, name: str, generation: int) -> str:
        return f"{self.folder}/{name}/{generation:012d}"

    def latest(self, name: str) -> Lease | None:
        """The newest generation, open or not."""
        names = [x for x in names_in(self.spark, f"{self.folder}/{name}") if not x.startswith(".") and not x.endswith(".draft")]
        files = [x for x in names if x.isdigit()]
        if not files:
            return None
        text = read_text(self.spark, f"{self.folder}/{name}/{files[-1]}")
        if "\n" not in text:
            # Created, but not written yet: held by someone, for now.
            return Lease(int(files[-1]), "", dt.datetime.max)
        owner, until = text.split("\n", 1)
        return Lease(int(files[-1]), owner, dt.datetime.fromisoformat(until), files[-1] + _RELEASED in names)

    def acquire(self, name: str, owner: str, length: dt.timedelta) -> bool:
        """Take or renew the lease; False if another owner has it or was faster."""
        seen, now = self.latest(name), self._now()
        if seen and seen.open_at(now) and seen.owner != owner:
            return False
        generation = seen.generation + 1 if seen else 1
        if not create_exclusive(self.spark, self._path(name, generation), f"{owner}\n{(now + length).isoformat()}"):
            return False
        # The generation before stays: another job may just be reading it.
        for old in names_in(self.spark, f"{self.folder}/{name}"):
            if old[:12].isdigit() and int(old[:12]) < generation - 1:
                delete_path(self.spark, f"{self.folder}/{name}/{old}")
        return True

    def holds(self, name: str, owner: str, length: dt.timedelta) -> bool:
        """Whether the owner still has the lease. One that ran out and that nobody took is renewed."""
        seen = self.latest(name)
        if seen is None or seen.owner != owner or seen.released:
            return False
        return seen.open_at(self._now()) or self.acquire(name, owner, length)

    def release(self, name: str, owner: str) -> bool:
        """Give the lease back; False if the owner does not have it (any more)."""
        seen = self.latest(name)
        if seen is None or seen.owner != owner:
            return False
        marker = self._path(name, seen.generation) + _RELEASED
        return create_exclusive(self.spark, marker, "") or path_exists(self.spark, marker)
