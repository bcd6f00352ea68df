"""Joins between calls, symbols and definitions, and between tree and index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.strings import symbol_id


def enclose(calls: DataFrame, symbols: DataFrame, key: tuple[str, ...] = ("file_path", "callee_name", "line", "col"), order: str = "start_line") -> DataFrame:
    """calls with enclosing_name, _kind, _scope of the innermost symbol around the line; '' if none.

    Of equally long symbols the first by `order` counts. Both sides meet by file, and the
    smallest is kept by an aggregate that combines before the shuffle.
    """
    s = symbols.select(F.col("file_path").alias("s_path"), F.struct((F.col("end_line") - F.col("start_line")).alias("span"), F.col(order).alias("ord"), F.col("name").alias("n"), F.col("kind").alias("k"), F.col("scope").alias("sc")).alias("s"), "start_line", "end_line")
    both = calls.join(s, (F.col("file_path") == F.col("s_path")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left")
    best = both.groupBy(*key).agg(F.min("s").alias("s"))
    part = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit(""))
    return best.select(*key, part("n").alias("enclosing_name"), part("k").alias("enclosing_kind"), part("sc").alias("enclosing_scope"))


def enclosing_ids(calls: DataFrame, symbols: DataFrame, key: tuple[str, ...] = ("file_path", "callee_name", "line", "col")) -> DataFrame:
    """calls with enclosing_id: the smallest symbol of that name, kind and scope around the line, or ''."""
    s = symbols.select(F.col("file_path").alias("s_path"), "name", "kind", F.coalesce("scope", F.lit("")).alias("scope"), "start_line", "end_line")
    on = (
        (F.col("file_path") == F.col("s_path")) & (F.col("enclosing_name") == F.col("name")) & (F.col("enclosing_kind") == F.col("kind"))
        & (F.col("enclosing_scope") == F.col("scope")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    )
    names = ("enclosing_name", "enclosing_kind", "enclosing_scope")
    best = calls.join(s, on, "left").groupBy(*key, *names).agg(F.min(F.when(F.col("start_line").isNotNull(), F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "start_line"))).alias("s"))
    return best.withColumn("enclosing_id", F.when(F.col("s").isNull(), "").otherwise(symbol_id(F.col("file_path"), F.col("enclosing_kind"), F.col("enclosing_name"), F.col("s.start_line")))).drop("s")


def nearest_definition(symbols: DataFrame, candidates: DataFrame) -> DataFrame:
    """symbols with match_line of the candidate of the same file and name at most a line off, nearest first."""
    c = candidates.select(F.col("file_path").alias("c_path"), F.col("name").alias("c_name"), "match_line", "ord")
    near = symbols.join(c, (F.col("file_path") == F.col("c_path")) & (F.col("name") == F.col("c_name")) & (F.abs(F.col("match_line") - F.col("start_line")) <= 1))
    best = F.min(F.struct(F.abs(F.col("match_line") - F.col("start_line")).alias("d"), "ord", "match_line"))
    return near.groupBy("file_path", "name", "start_line").agg(best.alias("m")).select("file_path", "name", "start_line", F.col("m.match_line").alias("match_line"))


def diff(tree: DataFrame, index: DataFrame) -> DataFrame:
    """(path, state): new, stale, unchanged or deleted, by mtime and size."""
    t, i = tree.select("path", F.struct("mtime_ns", "size").alias("t")), index.select("path", F.struct("mtime_ns", "size").alias("i"))
    state = F.when(F.col("i").isNull(), "new").when(F.col("t").isNull(), "deleted").when(F.col("t") == F.col("i"), "unchanged").otherwise("stale")
    return t.join(i, "path", "full_outer").select("path", state.alias("state"))


def replace_files(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """old without the rows of changed file_paths, with new's."""
    return remove_files(old, changed).unionByName(new)


def remove_files(old: DataFrame, gone: DataFrame, key: str = "file_path") -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")
