"""Trees of files as relations."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.patterns import SKIPPED_DIRS
from quarry.operators.ignore import Pattern, in_skipped_dir, kept_paths, parse

#: Directories that the driver lists before tasks walk those below.
FRONT = 256
#: The longest ignore file that is read, in bytes, and most of them in a tree: the driver holds their patterns.
MAX_RULES, MAX_FILES = 1 << 20, 10_000
FILES = "path string, mtime_ns long, size long"


def _entries(base: str, folder: str) -> tuple[list[tuple[str, int, int]], list[str]]:
    """Files (path, mtime_ns, size) of a folder, and its folders that may be entered; links to folders aren't followed."""
    files, folders = [], []
    with os.scandir(os.path.join(base, folder)) as found:
        for e in sorted(found, key=lambda e: e.name):
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_dir(follow_symlinks=False):
                if e.name not in SKIPPED_DIRS:
                    folders.append(path)
            elif e.is_file():
                try:
                    s = e.stat()
                except FileNotFoundError:  # it has gone meanwhile
                    continue
                files.append((path, s.st_mtime_ns, s.st_size))
    return files, folders


def listing(root: str) -> dict[str, tuple[int, int]]:
    """(mtime_ns, size) of all files below root but those in default directories; read by one machine."""
    base, out, todo = os.path.realpath(root), {}, [""]
    while todo:
        try:
            files, below = _entries(base, todo.pop())
        except FileNotFoundError:  # it has gone meanwhile
            continue
        out |= {p: (m, s) for p, m, s in files}
        todo += below
    return out


def walked(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime_ns, size) of all files below root but those in default directories, hidden files too.

    The tree must be at this place on every machine. The driver lists the first levels, tasks
    walk what is below. (Spark's own file listing leaves out names with '.' or '_' in front.)
    """
    base = os.path.realpath(root)
    files, todo = [], [""]
    while todo and len(todo) < FRONT:
        level = [_entries(base, d) for d in todo]
        files += [f for own, _ in level for f in own]
        todo = [d for _, below in level for d in below]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rest = list(b.folder)
            while rest:
                own, below = _entries(base, rest.pop())
                rest += below
                yield pd.DataFrame(own, columns=["path", "mtime_ns", "size"])

    near = spark.createDataFrame(files, FILES)
    if not todo:
        return near
    far = spark.createDataFrame([(d,) for d in todo], "folder string").repartition(min(len(todo), 4 * FRONT)).mapInPandas(walk, FILES)
    return near.unionByName(far)


def ignore_rules(spark: SparkSession, root: str, files: DataFrame | None = None) -> list[Pattern]:
    """The tree's ignore patterns: .git/info/exclude first, then every .gitignore from the root down.

    A .gitignore's patterns hold for what is below its directory. Those in directories that are
    never entered don't count.
    """
    files = walked(spark, root) if files is None else files
    own = files.where((F.col("path") == ".gitignore") | F.endswith("path", F.lit("/.gitignore"))).where((F.col("size") <= MAX_RULES) & ~in_skipped_dir(F.col("path")))
    paths = [r.path for r in own.select("path").limit(MAX_FILES + 1).collect()]
    if len(paths) > MAX_FILES:
        raise ValueError(f"over {MAX_FILES} ignore files")
    out: list[Pattern] = []
    for path in [".git/info/exclude", *sorted(paths, key=lambda p: (p.count("/"), p))]:
        if os.path.isfile(os.path.join(root, path)):
            with open(os.path.join(root, path), encoding="utf-8", errors="replace", newline="") as f:
                out += parse(f.read(), "" if path.startswith(".git/") else os.path.dirname(path), len(out))
    return out


def crawl(spark: SparkSession, root: str, patterns: list[Pattern] | None = None) -> DataFrame:
    """(path, mtime_ns, size) of the files that the rules keep, by default the tree's own, ordered by path."""
    files = walked(spark, root)
    rules = ignore_rules(spark, root, files) if patterns is None else patterns
    return kept_paths(files, list(rules)).orderBy("path")


def with_text(files: DataFrame, root: str) -> DataFrame:
    """files (path, ...) with their text, bytes that aren't UTF-8 replaced; a file that has gone is left out."""
    base, names = os.path.realpath(root), files.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, path in enumerate(b.column("path").to_pylist()):  # a file at a time: they may be large
                try:
                    with open(os.path.join(base, path), "rb") as f:
                        text = f.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    continue
                row = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([text], pa.string())], names=[*names, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(read, f"{kinds}, text string")


def stat(root: str, paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, mtime_ns, size) of those of some files that are there."""
    out = []
    for p in paths:
        try:
            s = os.stat(os.path.join(root, p))
        except OSError:
            continue
        out.append((p, s.st_mtime_ns, s.st_size))
    return out


def find_root(start: str, flag: str | None = None) -> str:
    """The given root, else the nearest folder above with .git, else start; links resolved."""
    if flag:
        return os.path.realpath(flag)
    here = os.path.realpath(os.environ.get("QUARRY_PROJECT_DIR") or start)
    at = here
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return at
        up = os.path.dirname(at)
        if up == at:
            return here
        at = up


class OutsideRoot(ValueError):
    """A path that leads out of the tree."""


def safe_path(root: str, path: str) -> str:
    """The real path of a file under root. A leading slash or dots stay below it; links are followed.

    FileNotFoundError if there is none, IsADirectoryError for a folder, OutsideRoot if a link leads out.
    """
    base = os.path.realpath(root)
    inside = os.path.join(base, os.path.normpath("/" + path).lstrip("/"))
    if not os.path.lexists(inside):
        raise FileNotFoundError(path)
    full = os.path.realpath(inside)
    if os.path.commonpath([base, full]) != base:
        raise OutsideRoot(f"{path!r} is outside the root")
    if not os.path.exists(full):
        raise FileNotFoundError(path)
    if os.path.isdir(full):
        raise IsADirectoryError(path)
    return full
