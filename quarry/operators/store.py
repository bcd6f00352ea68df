"""Versioned snapshots of the index: tables in buckets first, then the manifest that makes them current.

Rows are dealt to buckets by their file, postings by their token. A commit writes the buckets that
change and a manifest that names a folder for every bucket, so unchanged buckets are not written
again. The manifest's file is created only if there is none of its number: of two writers that
began from one version, the later one gets a Conflict and nothing of its becomes visible.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import schema as S
from quarry.operators import search
from quarry.operators.relate import remove_files, replace_files

SCHEMAS = {"files": S.FILES, "symbols": S.SYMBOLS, "call_sites": S.CALL_SITES, "postings": S.POSTINGS}
#: What rows are dealt and sorted by.
KEYS = {"files": "path", "symbols": "file_path", "call_sites": "file_path", "postings": "token"}


class Conflict(RuntimeError):
    """Another writer has made this version; read again and repeat."""


class NoIndex(LookupError):
    """There is no index of this schema here; build one."""


class Snapshots:
    """An index in a folder that Spark can reach; readers keep the version that they began with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._place = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._place("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = lambda stream: jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")

    # manifests

    def _numbers(self) -> list[int]:
        folder = self._place("manifest")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """The current manifest, or that of a version; None if there is none of this schema.

        A file that a writer left unfinished is passed over.
        """
        for n in [version] if version else reversed(self._numbers()):
            stream = self._fs.open(self._place(f"manifest/{n}.json"))
            try:
                out = json.loads(self._text(stream))
            except ValueError:
                continue
            finally:
                stream.close()
            return out if out["schema"] == S.VERSION else None
        return None

    def exists(self) -> bool:
        return self.manifest() is not None

    def destroy(self) -> None:
        """Remove the index with all its versions."""
        self._fs.delete(self._place(""), True)

    def _publish(self, manifest: dict) -> int:
        taken = self._numbers()
        version = manifest["base"] + 1
        if taken and taken[-1] >= version:
            left = [n for n in taken if n >= version and self.manifest(n) is not None]
            if left:
                raise Conflict(f"version {version} is there already")
            version = taken[-1] + 1  # what an unfinished writer left
        manifest = manifest | {"version": version, "schema": S.VERSION, "buckets": self.buckets}
        try:
            stream = self._fs.create(self._place(f"manifest/{version}.json"), False)
        except Exception as e:
            raise Conflict(f"version {version} is there already") from e
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        return version

    # tables

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, keys: Iterable[str]) -> set[int]:
        """The buckets of some keys, a query's words or a file."""
        frame = self.spark.createDataFrame([(k,) for k in keys], "k string")
        return {r[0] for r in frame.select(self.bucket(F.col("k"))).collect()}

    def read(self, table: str, version: int | None = None, keys: Iterable[str] | None = None) -> DataFrame:
        """A table; with keys only the buckets that may hold them."""
        manifest = self.manifest(version)
        if manifest is None:
            raise NoIndex(self.path)
        return self._read(manifest, table, None if keys is None else self._buckets_of(keys))

    def _read(self, manifest: dict, table: str, some: set[int] | None = None) -> DataFrame:
        parts = [f"{self.path}/{table}/{folder}/bucket={b}" for b, folders in sorted(manifest["tables"].get(table, {}).items()) for folder in folders if some is None or int(b) in some]
        reader = self.spark.read.schema(SCHEMAS[table])
        return reader.parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMAS[table])

    def _write(self, table: str, df: DataFrame) -> dict[str, list[str]]:
        """The folders of the buckets that df has rows in."""
        folder = uuid.uuid4().hex[:12]
        wide = df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[table]]).withColumn("bucket", self.bucket(F.col(KEYS[table])))
        target = f"{self.path}/{table}/{folder}"
        wide.repartition("bucket").sortWithinPartitions("bucket", KEYS[table]).write.partitionBy("bucket").parquet(target)
        names = [f.getPath().getName() for f in self._fs.listStatus(self._place(f"{table}/{folder}"))]
        return {n[7:]: [folder] for n in names if n.startswith("bucket=")}

    def commit(self, tables: dict[str, DataFrame], base: dict | None = None, touched: set[int] | None = None, written: dict[str, dict[str, list[str]]] | None = None, **meta: str) -> int:
        """The tables as the next version; with touched buckets, base has the other ones and earlier postings.

        written: the folders of tables that are there already.
        """
        old = base["tables"] if base and touched is not None else {}
        named = {}
        for table in ("files", "symbols", "call_sites"):
            kept = {b: f for b, f in old.get(table, {}).items() if int(b) not in touched} if touched is not None else {}
            named[table] = kept | (written[table] if written and table in written else self._write(table, tables[table]))
        named["postings"] = {b: list(f) for b, f in old.get("postings", {}).items()}
        for b, folders in self._write("postings", tables["postings"]).items():
            named["postings"].setdefault(b, []).extend(folders)
        files = self._read({"tables": named}, "files")
        total = files.agg(F.count("*"), F.coalesce(F.sum("n_symbols"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_calls"), F.lit(0))).first()
        stats = dict(zip(("n_files", "n_symbols", "n_tokens", "n_calls"), total))
        return self._publish({"base": base["version"] if base else 0, "tables": named, "stats": stats, "meta": (base["meta"] if base else {}) | meta})

    def apply(self, files: DataFrame, symbols: DataFrame, calls: DataFrame, gone: DataFrame | None = None, unlike: bool = False, **meta: str) -> int:
        """One new version: the changed files' rows take the place of those they had, gone (path) ones go.

        files: (path, mtime_ns, size). Postings of the changed files are added; those that they
        had before stay in their buckets, and are not theirs any more (see live_postings). unlike:
        the symbols all differ in search.KEY. A first version's symbols and calls are written first
        and read again for what follows from them, so that they are made once.
        """
        base = self.manifest()
        if base is not None:
            self.buckets = base["buckets"]
        generation = uuid.uuid4().hex[:12]
        written = {}
        if base is None:
            written = {"symbols": self._write("symbols", symbols), "call_sites": self._write("call_sites", calls)}
            symbols, calls = (self._read({"tables": written}, t) for t in ("symbols", "call_sites"))
        posted = (search.postings_of_unlike if unlike else search.postings)(symbols)
        per_file = symbols.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n_symbols"), F.sum(search.length()).alias("n_tokens"))
        n_calls = calls.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n_calls"))
        fresh = files.select("path", "mtime_ns", "size").join(per_file, "path", "left").join(n_calls, "path", "left").na.fill(0).withColumn("generation", F.lit(generation))
        tables = {"files": fresh, "symbols": symbols, "call_sites": calls, "postings": posted.withColumn("generation", F.lit(generation))}
        if base is None:
            return self.commit(tables, None, None, written, **meta)
        changed = files.select("path").unionByName(gone.select("path")) if gone is not None else files.select("path")
        changed = changed.distinct().persist()
        touched = {r[0] for r in changed.select(self.bucket(F.col("path"))).distinct().collect()}  # numbers of buckets
        by_file = changed.withColumnRenamed("path", "file_path")
        mine = {"files": remove_files(self._read(base, "files", touched), changed, "path").unionByName(fresh)}
        for table in ("symbols", "call_sites"):
            mine[table] = replace_files(self._read(base, table, touched), tables[table].select(SCHEMAS[table].names), by_file)
        try:
            return self.commit(mine | {"postings": tables["postings"]}, base, touched, **meta)
        finally:
            changed.unpersist()

    def compact(self) -> int:
        """Write the postings anew without those of files that have changed since."""
        base = self.manifest()
        tables = {t: f for t, f in base["tables"].items() if t != "postings"}
        tables["postings"] = self._write("postings", self.live_postings())
        return self._publish({"base": base["version"], "tables": tables, "stats": base["stats"], "meta": base["meta"]})

    def live_postings(self, tokens: Iterable[str] | None = None, manifest: dict | None = None) -> DataFrame:
        """Postings, of some tokens only, that belong to the current content of their files."""
        manifest = manifest or self.manifest()
        if manifest is None:
            raise NoIndex(self.path)
        if tokens is None:
            own = self._read(manifest, "postings")
        else:
            tokens = sorted(set(tokens))
            own = self._read(manifest, "postings", self._buckets_of(tokens)).where(F.col("token").isin(tokens))
        files = self._read(manifest, "files").select(F.col("path").alias("file_path"), "generation")
        return own.join(files, ["file_path", "generation"], "left_semi").select(S.POSTINGS.names)

    # what else is known of the index

    def get_meta(self, key: str) -> str | None:
        manifest = self.manifest()
        return None if manifest is None else manifest["meta"].get(key)

    def set_meta(self, **meta: str) -> int:
        """New values in a version of their own; no table is written."""
        base = self.manifest()
        if base is None:
            raise NoIndex(self.path)
        same = {k: base[k] for k in ("tables", "stats")}
        return self._publish(same | {"base": base["version"], "meta": base["meta"] | meta})

    def size_bytes(self) -> int:
        """Bytes of the current version's tables."""
        tables = self.manifest()["tables"]
        return sum(self._fs.getContentSummary(self._place(f"{t}/{f}/bucket={b}")).getLength() for t, own in tables.items() for b, folders in own.items() for f in folders)

    def status(self) -> DataFrame:
        """One row: numbers of files, symbols and call sites, version, bytes, and what meta says."""
        m = self.manifest()
        if m is None:
            raise NoIndex(self.path)
        row = (m["stats"]["n_files"], m["stats"]["n_symbols"], m["stats"]["n_calls"], m["version"], self.size_bytes(), m["meta"].get("indexer"), m["meta"].get("last_sync_at"), m["meta"].get("last_hydration_ms"))
        return self.spark.createDataFrame([row], T.StructType([*[T.StructField(c, T.LongType()) for c in ("n_files", "n_symbols", "n_call_sites", "version", "bytes")], *[T.StructField(c, T.StringType()) for c in ("indexer", "last_sync_at", "last_hydration_ms")]]))
