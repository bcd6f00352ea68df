"""A tree's changes as a streaming source.

    spark.dataSource.register(TreeChanges)
    events = spark.readStream.format("quarry_tree").option("root", root).load()

gives (path, op, ts): create, write and remove of files, by comparing the tree's listing with the one
before at every trigger. What changed before a start isn't known, so the first row of a run, and
of one that begins again after a failure, has op error: whoever follows compares the whole tree.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from quarry.sources.tree import listing


def changes(before: dict[str, tuple[int, int]], now: dict[str, tuple[int, int]]) -> list[tuple[str, str]]:
    """(path, op) between two listings, by path."""
    out = [(p, "create" if p not in before else "write") for p, seen in now.items() if before.get(p) != seen]
    return sorted(out + [(p, "remove") for p in before if p not in now])


class TreeReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root, self.known = root, None

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _rows(self, some: list[tuple[str, str]]) -> Iterator[tuple]:
        at = datetime.datetime.now(datetime.timezone.utc)
        return iter([(path, op, at) for path, op in some])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = listing(self.root)
        some = [("", "error")] if self.known is None else changes(self.known, now)
        self.known = now
        return self._rows(some), {"n": start["n"] + len(some)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows([("", "error")] if start != end else [])


class TreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_tree"

    def schema(self) -> str:
        return "path string, op string, ts timestamp"

    def simpleStreamReader(self, schema) -> TreeReader:
        return TreeReader(self.options["root"])
