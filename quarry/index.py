"""CodeIndex: the engine's front. Queries return DataFrames over the version that was current when they began."""

from __future__ import annotations

import datetime
import os
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.patterns import EXTENSIONS
from quarry.functions.strings import parse_symbol_id
from quarry.operators import extract, lines, relate, search, syntax
from quarry.operators.ignore import kept_paths
from quarry.operators.search import BadQuery
from quarry.operators.store import Snapshots
from quarry.sources import tree


class UnknownSymbol(LookupError):
    """No symbol has this id: it is invalid, or its file has changed since."""


class NoCallers(LookupError):
    """Nothing calls this name; the indexed one may differ, a search finds it."""


class CodeIndex:
    """An index at a path that Spark can reach, of the tree at root or of texts that are handed in."""

    def __init__(self, spark: SparkSession, path: str, root: str | None = None, buckets: int = 16, indexer: str = "regex"):
        if indexer not in ("regex", "grammar"):
            raise BadQuery("the indexer must be regex or grammar")
        self.spark, self.root, self.indexer = spark, root, indexer
        self.store = Snapshots(spark, path, buckets)
        self._lock, self._refresh = threading.Lock(), threading.Lock()
        self._running: threading.Thread | None = None
        self.refresh_error: Exception | None = None
        self.reconcile_needed = False

    # building

    def extracted(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(symbols, call sites) of files (file_path, text).

        By lines alone; or with the indexer grammar: bounds, bytes and calls from the sources'
        grammar or tokens, so that symbols may nest and declarations are no calls.
        """
        every = lines.lines(files)
        if self.indexer == "regex":
            return self._by_lines(extract.held_lines(every))
        symbols = syntax.refined(extract.symbols_with_ends(every), syntax.definitions(files))
        return symbols, relate.enclose(syntax.calls(files), symbols)

    def _by_lines(self, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        unset = {c: F.lit(None).cast("long") for c in ("start_byte", "end_byte")}
        return extract.symbols_of(held).withColumns(unset), extract.calls_of(held)

    def _meta(self, **more: str) -> dict[str, str]:
        now = datetime.datetime.now(datetime.timezone.utc)
        return {"indexer": self.indexer, "last_sync_at": now.strftime("%Y-%m-%dT%H:%M:%SZ")} | more

    def apply(self, files: DataFrame, gone: DataFrame | None = None, **meta: str) -> int:
        """Index files (path, mtime_ns, size, text) and remove gone (path), as one version.

        A file without symbols counts too. The files are read once, so that all tables agree
        even if the tree changes meanwhile, and by lines their lines are told apart once.
        """
        held = files.where(extract.supported(F.col("path"))).persist()
        source, kept = held.select(F.col("path").alias("file_path"), "text"), None
        try:
            if self.indexer == "regex":
                kept = extract.held_lines(lines.lines(source)).persist()
                symbols, calls = self._by_lines(kept)
            else:
                symbols, calls = self.extracted(source)
            return self.store.apply(held.select("path", "mtime_ns", "size"), symbols, calls, gone, unlike=True, **self._meta(**meta))
        finally:
            held.unpersist()
            if kept is not None:
                kept.unpersist()

    sync = apply

    def sync_paths(self, paths: list[str], gone: list[str] = ()) -> dict[str, int]:
        """Index some files of the tree again; those that have gone, or that its rules leave out, are removed."""
        with self._lock:
            there = self.spark.createDataFrame(tree.stat(self.root, sorted(set(paths))), tree.FILES)
            kept = kept_paths(there, tree.ignore_rules(self.spark, self.root)).where(extract.supported(F.col("path")))
            rows = [tuple(r) for r in kept.collect()]  # of the paths asked for
            left = sorted((set(paths) | set(gone)) - {r[0] for r in rows})
            files = tree.with_text(self.spark.createDataFrame(rows, tree.FILES), self.root)
            self.apply(files, self.spark.createDataFrame([(p,) for p in left], "path string"))
            return {"synced": len(rows), "removed": len(left)}

    def _reconciled(self, **meta: str) -> dict[str, int]:
        found = tree.crawl(self.spark, self.root).where(extract.supported(F.col("path")))
        indexed = self.store.read("files") if self.store.exists() else found.limit(0)
        state = relate.diff(found, indexed.select("path", "mtime_ns", "size")).persist()
        try:
            counts = {r["state"]: r["count"] for r in state.groupBy("state").count().collect()}
            if set(counts) - {"unchanged"} or not self.store.exists():
                changed = found.join(state.where("state in ('new', 'stale')"), "path").select("path", "mtime_ns", "size")
                self.apply(tree.with_text(changed, self.root), state.where("state = 'deleted'").select("path"), **meta)
            self.reconcile_needed = False
            return counts
        finally:
            state.unpersist()

    def reconcile(self) -> dict[str, int]:
        """Compare the whole tree with the index and apply the difference as one version; one at a time."""
        with self._lock:
            return self._reconciled()

    def hydrate(self) -> int:
        """Bring the index up to date at start, building it if there is none; milliseconds that took."""
        begun = time.monotonic()
        with self._lock:
            self._reconciled()
            took = int((time.monotonic() - begun) * 1000)
            self.store.set_meta(**self._meta(last_hydration_ms=str(took)))
        return took

    def stale(self) -> DataFrame:
        """(path, state) of indexed files that have changed or gone; new files are not looked for."""
        root = os.path.realpath(self.root)

        def checked(batches):
            for b in batches:
                now = {p: (m, s) for p, m, s in tree.stat(root, list(b.path))}
                b["state"] = ["deleted" if p not in now else "unchanged" if now[p] == (m, s) else "stale" for p, m, s in zip(b.path, b.mtime_ns, b["size"])]
                yield b[["path", "state"]]

        files = self.store.read("files").select("path", "mtime_ns", "size")
        return files.mapInPandas(checked, "path string, state string").where("state <> 'unchanged'")

    def _refreshed(self) -> None:
        try:
            if self.reconcile_needed:
                self.reconcile()
            else:
                some = self.stale().persist()
                self.sync_paths([r.path for r in some.where("state = 'stale'").collect()], [r.path for r in some.where("state = 'deleted'").collect()])
                some.unpersist()
            self.refresh_error = None
        except Exception as e:  # a query goes on with the version there is
            self.refresh_error = e
        finally:
            self._refresh.release()

    def ensure_fresh(self) -> bool:
        """Start a refresh beside the queries if one is due and none runs; whether one was started.

        With reconcile_needed the whole tree is compared, else the indexed files only.
        """
        if self.root is None or not self.store.exists() or not self._refresh.acquire(blocking=False):
            return False
        if not self.reconcile_needed and self.stale().isEmpty():
            self._refresh.release()
            return False
        self._running = threading.Thread(target=self._refreshed, daemon=True)
        self._running.start()
        return True

    def close(self) -> None:
        """Wait for a refresh that runs."""
        if self._running is not None:
            self._running.join()

    # queries

    @property
    def symbols(self) -> DataFrame:
        return self.store.read("symbols")

    @property
    def call_sites(self) -> DataFrame:
        return self.store.read("call_sites")

    def search(self, query: str, limit: int = 10, mode: str = "and", name_match: str | None = None) -> DataFrame:
        """Hits in order; an empty query has none."""
        if name_match is not None:
            search.name_mode(name_match)
        self.ensure_fresh()
        return search.search_stored(self.store, query, limit, mode, name_match)

    def outline(self, file_path: str) -> DataFrame:
        path = search.needed(file_path, "a file")
        self.ensure_fresh()
        return search.outline(self.store.read("symbols", keys=[path]), path)

    def _parsed(self, symbol_id: str):
        parts = self.spark.range(1).select(parse_symbol_id(F.lit(search.needed(symbol_id, "a symbol id"))).alias("p")).first()["p"]
        if parts is None:
            raise UnknownSymbol(f"{symbol_id!r} is no symbol id")
        return parts

    def _symbol_rows(self, symbol_id: str) -> DataFrame:
        parts = self._parsed(symbol_id)
        own = self.store.read("symbols", keys=[parts.file_path])
        return own.where((F.col("file_path") == parts.file_path) & (F.col("kind") == parts.kind) & (F.col("name") == parts.name) & (F.col("start_line") == parts.start_line)).limit(1)

    def symbol(self, symbol_id: str):
        hit = self._symbol_rows(symbol_id).first()
        if hit is None:
            raise UnknownSymbol(f"{symbol_id!r} is not in the index; its file may have changed, search again")
        return hit

    def _file(self, file_path: str) -> DataFrame:
        """(file_path, text) of one file of the tree."""
        path = search.needed(file_path, "a file")
        full = tree.safe_path(self.root, path)
        row = self.spark.createDataFrame([(os.path.relpath(full, os.path.realpath(self.root)),)], "path string")
        return tree.with_text(row, self.root).select(F.lit(path).alias("file_path"), "text")

    def read_lines(self, file_path: str, start: int, end: int) -> str:
        """Numbered lines start..end of a file, as many as there are."""
        return lines.read_lines(self._file(file_path), start, end).first()["content"]

    def read_bytes(self, file_path: str, start: int, end: int) -> str:
        """The bytes [start, end) of a file as numbered lines."""
        return lines.read_bytes(self._file(file_path), start, end).first()["content"]

    def read_symbol(self, symbol_id: str) -> str:
        """A symbol's source as numbered lines: its bytes if known and not empty, else its lines."""
        hit = self.symbol(symbol_id)
        return lines.read_symbols(self._symbol_rows(symbol_id), self._file(hit.file_path)).first()["content"]

    def find_callers(self, callee: str = "", directory: str = "", limit: int = 20, symbol_id: str = "") -> DataFrame:
        """Calls of a name, or of the name in a symbol id; NoCallers if there are none."""
        name = callee.strip() or (self._parsed(symbol_id).name if symbol_id else "")
        if not name:
            raise BadQuery("a name or a symbol id is needed")
        self.ensure_fresh()
        version = self.store.manifest()["version"]
        rows = search.find_callers(self.store.read("call_sites", version), name, directory, limit).collect()  # at most limit
        if not rows:
            raise NoCallers(f"no callers of {name!r}: names must be equal; a search may find the one indexed")
        paths = sorted({r.file_path for r in rows})
        calls = self.spark.createDataFrame([tuple(r) for r in rows], self.call_sites.schema)
        own = self.store.read("symbols", version, paths).where(F.col("file_path").isin(paths))
        return relate.enclosing_ids(calls, own).orderBy("file_path", "line", "col")

    def map_directory(self, directory: str, max_definitions: int = 50, max_outgoing: int = 50) -> DataFrame:
        self.ensure_fresh()
        version = self.store.manifest()["version"]
        return search.map_directory(self.store.read("symbols", version), self.store.read("call_sites", version), directory, max_definitions, max_outgoing)

    def check_file(self, file_path: str) -> DataFrame:
        """One row (file_path, ok, errors) for a file of the tree in one of the languages read."""
        own = self._file(file_path)
        if extension_of(file_path) not in EXTENSIONS:
            raise syntax.Unsupported(f"{file_path!r} is in no language that is checked")
        found = syntax.check(own).groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("line", "col", "message"))).alias("errors"))
        errors = F.coalesce("errors", F.array().cast("array<struct<line:int,col:int,message:string>>"))
        return own.select("file_path").join(found, "file_path", "left").select("file_path", (F.size(errors) == 0).alias("ok"), errors.alias("errors"))

    def status(self) -> DataFrame:
        """One row of counts, the version, its bytes and times, and whether a reconcile is due."""
        return self.store.status().withColumn("reconcile_needed", F.lit(self.reconcile_needed))


def extension_of(path: str) -> str:
    """From the last dot of the name on, in lower case."""
    return os.path.splitext("x" + os.path.basename(path.strip()))[1].lower()


def as_json(df: DataFrame) -> str:
    """All rows of a query's few as a JSON array, in order; [] if there are none."""
    return "[" + ",".join(r[0] for r in df.select(F.to_json(F.struct("*"))).collect()) + "]"


def to_json(df: DataFrame, order: list[str]) -> DataFrame:
    """One row: json, the rows as an array in this order, [] and never null if there are none."""
    rows = F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"k{k}") for k, c in enumerate(order)], F.struct(*df.columns).alias("row"))))
    listed = df.agg(F.transform(rows, lambda r: F.to_json(r["row"])).alias("rows"))
    return listed.select(F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]")).alias("json"))
