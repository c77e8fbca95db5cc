"""Numbered states of a folder, for tables that several writers change.

A state is a small JSON document that names the files it consists of. State n + 1 exists once
exactly one writer has put its file in place: on a local disk by a hard link, elsewhere by a rename that
fails where the name is taken (as HDFS and its kin do). Files that no kept state names may go.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Other writers were first, again and again."""


class Commits:
    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = lambda name: self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        uri = urlparse(self._fs.makeQualified(self._path("x")).toString())
        self._local = os.path.dirname(uri.path) if uri.scheme == "file" else None

    @staticmethod
    def _name(n: int) -> str:
        return f"commit-{n:012d}.json"

    def names(self, below: str = "") -> list[str]:
        at = self._path(below or ".")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def latest(self) -> tuple[int, dict]:
        """The newest state and its number; -1 and nothing if there is none."""
        found = sorted(x for x in self.names() if x.startswith("commit-") and x.endswith(".json"))
        return (int(found[-1][7:-5]), self.read(int(found[-1][7:-5]))) if found else (-1, {})

    def read(self, n: int) -> dict:
        stream = self._fs.open(self._path(self._name(n)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def offer(self, n: int, state: dict) -> bool:
        """Makes the state number n; False if another writer has made that number."""
        name, temp = self._name(n), f".tmp-{uuid.uuid4().hex}"
        data = json.dumps(state, sort_keys=True).encode()
        if self._local is not None:
            os.makedirs(self._local, exist_ok=True)
            with open(f"{self._local}/{temp}", "wb") as f:
                f.write(data)
            try:
                os.link(f"{self._local}/{temp}", f"{self._local}/{name}")
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{self._local}/{temp}")
        out = self._fs.create(self._path(temp), False)
        out.write(data)
        out.close()
        won = not self._fs.exists(self._path(name)) and self._fs.rename(self._path(temp), self._path(name))
        if not won:
            self._fs.delete(self._path(temp), False)
        return won

    def change(self, make: Callable[[dict], dict | None], tries: int = 20) -> int:
        """Commits what `make` does to the newest state, anew as often as another writer is first; the number, or that of the newest
        state where `make` returns None."""
        for _ in range(tries):
            n, state = self.latest()
            new = make(state)
            if new is None:
                return n
            if self.offer(n + 1, new):
                return n + 1
        raise Conflict(f"{self.folder}: {tries} commits were each overtaken")

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def expire(self, keep: int, below: str, named: Callable[[dict], set[str]]) -> list[str]:
        """Removes all but the last states, and what lies in the sub-folder and no kept state names. No writer may be at work,
        since what it hasn't committed yet isn't named."""
        numbers = sorted(int(x[7:-5]) for x in self.names() if x.startswith("commit-"))
        used = set().union(*(named(self.read(n)) for n in numbers[-keep:])) if numbers else set()
        for n in numbers[:-keep]:
            self.remove(self._name(n))
        gone = [x for x in self.names(below) if x not in used]
        for x in gone:
            self.remove(f"{below}/{x}")
        return gone
