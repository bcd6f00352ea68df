"""Helpers shared by the operators: lineage cuts, heavy keys, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside operators; it sorts last.
NO_ID = (1 << 63) - 1
#: Rows up to which a table is broadcast or kept in one partition; beyond, joins are salted.
FEW, SALTS = 10_000, 64
#: Bits of Spark's estimate of a table's size in bytes, beyond which it tells nothing.
ESTIMATE_BITS = 62


def cut(df: DataFrame) -> DataFrame:
    """Materialise df with a reliable checkpoint in the cluster's shared folder.

    The folder is the session's spark.checkpoint.dir; only where that is unset and one machine
    does all the work (tests) a temporary one is made. A checkpoint keeps Spark's estimate of the
    size, and a join's is the product of both sides: in a loop its digits double with each round,
    until the driver is busy with them alone. One that passes any real size is dropped.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint(eager=True)
    plan = out._jdf.queryExecution().logical()
    if plan.stats().sizeInBytes().bit_length() <= ESTIMATE_BITS:
        return out
    bare = spark._jsparkSession.internalCreateDataFrame(plan.rdd(), out._jdf.schema(), False)
    return DataFrame(bare, spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or on one machine a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return named or tempfile.mkdtemp(prefix="quarry-")


def own_names(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before them where a column of df has them already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner delete the shuffle files of plans that were cut."""
    for _ in range(2):  # what the first round releases the second one finds
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives freed memory back to the system.

    Workers stay for later tasks; what they keep adds to the executor's memory while others work.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim is not None:
            trim(0)

    return tidied


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, body): id with NO_ID for null, a hash of the text, the UTF-8 bytes (null: none).

    (id, th) tells rows apart even where ids repeat; rows equal in both are equal rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("th"),
        text.cast("binary").alias("body"),
    )


def shown_id(name: str = "id"):
    """The id as the caller knows it: null again where it was null."""
    return F.when(F.col(name) != F.lit(NO_ID), F.col(name))


def beside(rows: DataFrame, table: DataFrame, key: str, by: Column) -> DataFrame:
    """rows joined with the one row of table that has their key; hot keys don't meet in one task."""
    if table.count() <= FEW:
        return rows.join(F.broadcast(table), key)
    spread = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(by, F.lit(SALTS)).cast("int")).join(spread, [key, "__salt"]).drop("__salt")


def heavy_keys(counts: DataFrame, share: float) -> np.ndarray:
    """Keys holding at least `share` of all counted rows, at most 8 / (3 share) of them.

    counts: rows (key long, n long, total long) of the tasks' Frequent. A task reports a key with
    share / 2 of its own rows or more, short of share / 8 of them at most, so of a key of `share`
    overall at least 3/8 are reported. Both lists are bounded.
    """
    total = counts.where("key is null").agg(F.sum("total")).first()[0] or 0
    rows = counts.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2.0, total * share * 3 / 8)).select("key").collect()
    return np.array(sorted(r[0] for r in rows), dtype=np.int64)


HEAVY_SCHEMA = "key long, n long, total long"


class Frequent:
    """Counts of the frequent keys of a stream, in bounded memory.

    Holds at most 8 / share keys: beyond these the least count held goes off all counts (the
    summary of Misra and Gries), so a count is too low by share / 8 of the rows at most.
    """

    def __init__(self, share: float):
        self.share, self.most = share, int(8 / share)
        self.keys, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.total = self.lost = 0

    def add(self, keys: np.ndarray) -> None:
        self.total += len(keys)
        values, n = np.unique(keys, return_counts=True)
        self.keys, at = np.unique(np.append(self.keys, values), return_inverse=True)
        both = np.append(self.n, n)
        self.n = np.bincount(at, both, minlength=len(self.keys)).astype(np.int64)
        if len(self.keys) > self.most:
            off = int(np.partition(self.n, len(self.n) - self.most - 1)[len(self.n) - self.most - 1])
            self.lost += off
            self.keys, self.n = self.keys[self.n > off], self.n[self.n > off] - off

    def batch(self) -> pa.RecordBatch:
        """What heavy_keys() sums: one row with the total, then the frequent keys."""
        often = self.n + self.lost >= max(2.0, self.total * self.share / 2)
        keys, n = self.keys[often], self.n[often]
        return pa.RecordBatch.from_arrays(
            [pa.array([None, *keys.tolist()], pa.int64()), pa.array([0, *n.tolist()], pa.int64()), pa.array([self.total] + [0] * len(keys), pa.int64())],
            names=["key", "n", "total"],
        )


def forest(pairs: np.ndarray) -> np.ndarray:
    """(child, root) rows spanning the components of the pairs; a root is its least member."""
    if not len(pairs):
        return np.empty((0, 2), np.int64)
    nodes, ends = np.unique(pairs, return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, jump := new[new]):
            new = jump
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return np.column_stack([nodes[child], nodes[label[child]]])


def follow(df: DataFrame, col: str, table: DataFrame, salts: int = 64) -> DataFrame:
    """df with `col` replaced by table's `up` where table has it as `node`; other rows stay.

    A value of col with more than 1/500 of the rows is dealt over `salts` tasks: its one row of
    table is repeated that often. There are at most 500 such values.
    """
    total = df.count()
    often = [r[0] for r in df.groupBy(col).count().where(F.col("count") > max(1000, total / 500)).select(col).collect()]
    rest = [c for c in df.columns if c != col]
    hot = F.col(col).isin(often) if often else F.lit(False)
    left = df.withColumn("salt", F.when(hot, F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int")).otherwise(-1)) if often else df.withColumn("salt", F.lit(-1))
    few = F.when(F.col("node").isin(often), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1))) if often else F.array(F.lit(-1))
    right = table.select(F.col("node").alias("__node"), F.col("up").alias("__up"), F.explode(few).alias("__salt"))
    joined = left.join(right, (F.col(col) == F.col("__node")) & (F.col("salt") == F.col("__salt")), "left")
    return joined.select(F.coalesce("__up", col).alias(col), *rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node that has an edge, with the least node it is connected to.

    edges: (a long, b long), any order, repeats allowed. Each round hooks every node to its
    least neighbour and relabels the edges, so the nodes left at least halve; first each
    partition replaces its edges by a spanning forest. Nodes with very many edges are salted.
    """

    def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
        tree = forest(np.concatenate(got)) if got else np.empty((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(tree[:, 0]), pa.array(tree[:, 1])], names=["a", "b"])

    def reduced(df: DataFrame) -> DataFrame:
        slim = df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return cut(slim.mapInArrow(spanning, "a long, b long").distinct())

    now, layers = reduced(edges), []
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        layers.append(cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))))
        now = reduced(follow(follow(now, "a", layers[-1]), "b", layers[-1]))
    if not layers:
        return edges.sparkSession.createDataFrame([], "node long, up long").select("node", F.col("up").alias("root"))
    labels = layers[-1]
    for lower in reversed(layers[:-1]):
        labels = follow(lower, "up", labels)
    return cut(labels.select("node", F.col("up").alias("root")))
