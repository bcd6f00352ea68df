"""Symbols and call sites from lines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import patterns as P
from quarry.functions.strings import extension


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x{85}\x{A0}]+|[\s\x{85}\x{A0}]+$", "")


def _literals(pattern: str) -> list[str]:
    """Words that a line must hold to match the pattern; looking for them costs less than matching."""
    return re.findall(r"[a-z]{3,}", re.sub(r"\(\?:[^)]*\)\?", "", pattern))


def _definition(text: Column, ext: Column) -> Column:
    """(kind, name) of the first pattern of the language that matches."""
    out = None
    for pack, some in P.BY_EXTENSION:
        for kind, pattern in pack:
            held = reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in _literals(pattern)])
            hit = ext.isin(*some) & held & text.rlike(pattern)
            value = F.struct(F.lit(kind).alias("kind"), F.regexp_extract(text, pattern, 1).alias("name"))
            out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def supported(path: Column) -> Column:
    return extension(path).isin(*P.EXTENSIONS)


def marked_lines(lines: DataFrame) -> DataFrame:
    """lines with comment (text after //, else null) and def (kind, name, else null)."""
    bare = _trimmed(F.col("text"))
    note = F.when(F.contains("text", F.lit("//")), F.when(F.startswith(bare, F.lit("//")), _trimmed(F.substring(bare, F.lit(3), F.length(bare)))))
    return lines.where(supported(F.col("file_path"))).withColumn("comment", note).withColumn("def", F.when(F.col("comment").isNull(), _definition(F.col("text"), extension(F.col("file_path")))))


def annotated(lines: DataFrame) -> DataFrame:
    """Lines of supported files with def and scope where they define something, own, and n_lines.

    scope is the last // comment since the previous symbol of the file, or ''. own is the symbol
    (name, kind, scope, start_line) that the line belongs to: the last one defined up to it, as
    symbols found by lines never nest. All windows share one partitioning and one order.
    """
    by_line = Window.partitionBy("file_path").orderBy("line")
    before, upto = by_line.rowsBetween(Window.unboundedPreceding, -1), by_line.rowsBetween(Window.unboundedPreceding, 0)
    note = F.last(F.when(F.col("comment").isNotNull(), F.struct("line", "comment")), ignorenulls=True).over(before)
    previous = F.last(F.when(F.col("def").isNotNull(), F.col("line")), ignorenulls=True).over(before)
    wide = marked_lines(lines).withColumns({"note": note, "previous": previous, "n_lines": F.max("line").over(Window.partitionBy("file_path"))})
    scope = F.when(F.col("note.line") > F.coalesce("previous", F.lit(0)), F.col("note.comment")).otherwise("")
    wide = wide.withColumn("scope", scope).drop("note", "previous", "comment")
    symbol = F.when(F.col("def").isNotNull(), F.struct(F.col("def.name").alias("name"), F.col("def.kind").alias("kind"), "scope", F.col("line").alias("start_line")))
    return wide.withColumn("own", F.last(symbol, ignorenulls=True).over(upto))


def symbols(lines: DataFrame) -> DataFrame:
    """(file_path, name, kind, scope, start_line): one for each line that defines something."""
    return annotated(lines).where("def is not null").select("file_path", "own.name", "own.kind", "own.scope", "own.start_line")


def _ended(found: DataFrame) -> DataFrame:
    after = F.lead("start_line").over(Window.partitionBy("file_path").orderBy("start_line"))
    return found.withColumn("end_line", F.greatest("start_line", F.coalesce(after - 1, "n_lines"))).drop("n_lines")


def symbols_with_ends(lines: DataFrame) -> DataFrame:
    """symbols() with end_line, up to the next symbol or the file's end."""
    return _ended(annotated(lines).where("def is not null").select("file_path", "own.name", "own.kind", "own.scope", "own.start_line", "n_lines"))


def _own_part(c: str) -> Column:
    return F.coalesce(F.col(f"own.{c}"), F.lit("")).alias(f"enclosing_{c}")


def enclosed_calls(lines: DataFrame) -> DataFrame:
    """call_sites() with the name, kind and scope of the symbol around each, or ''; no join."""
    own = annotated(lines).select("file_path", "line", "text", *map(_own_part, ("name", "kind", "scope")))
    return call_sites(own, keep=("enclosing_name", "enclosing_kind", "enclosing_scope"))


def held_lines(lines: DataFrame) -> DataFrame:
    """annotated(), once for what both symbols_of() and calls_of() take: the lines that define or may call."""
    some = annotated(lines).where(F.col("def").isNotNull() | F.contains("text", F.lit("(")))
    return some.select("file_path", "line", F.when(F.contains("text", F.lit("(")), F.col("text")).alias("text"), F.col("def").isNotNull().alias("defines"), "own", "n_lines")


def symbols_of(held: DataFrame) -> DataFrame:
    """symbols_with_ends() from held_lines()."""
    return _ended(held.where("defines").select("file_path", "own.name", "own.kind", "own.scope", "own.start_line", "n_lines"))


def calls_of(held: DataFrame) -> DataFrame:
    """enclosed_calls() from held_lines()."""
    own = held.where("text is not null").select("file_path", "line", "text", *map(_own_part, ("name", "kind", "scope")))
    return call_sites(own, every_file=True, keep=("enclosing_name", "enclosing_kind", "enclosing_scope"))


def end_lines(symbols_df: DataFrame, counts: DataFrame) -> DataFrame:
    """symbols with end_line: kept if at least start_line, else up to the next symbol or the file's end."""
    known = F.col("end_line") if "end_line" in symbols_df.columns else F.lit(None).cast("int")
    after = F.lead("start_line").over(Window.partitionBy("file_path").orderBy("start_line", "name"))
    derived = F.greatest("start_line", F.coalesce(after - 1, F.when(F.col("n_lines") > 0, F.col("n_lines")), "start_line"))
    both = symbols_df.join(counts, "file_path", "left")
    return both.withColumn("end_line", F.when(known >= F.col("start_line"), known).otherwise(derived)).drop("n_lines")


def call_sites(lines: DataFrame, every_file: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(file_path, callee_name, line, col, any to keep): names before an opening bracket; col is the byte from 1."""
    source = lines if every_file else lines.where(supported(F.col("file_path")))
    some = source.where(F.contains("text", F.lit("(")))
    found = some.select("file_path", "line", *keep, F.split("text", P.CALL, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(P.CALL), 0).alias("calls"))
    gap = F.transform("gaps", lambda x: F.octet_length(x))
    size = F.transform("calls", lambda x: F.octet_length(x))
    each = found.withColumns({"gap": gap, "size": size}).where(F.size("calls") > 0).select("file_path", "line", *keep, "gap", "size", F.posexplode("calls").alias("k", "call"))
    total = lambda array, n: F.aggregate(F.slice(array, 1, n), F.lit(0), lambda a, x: a + x)
    col = 1 + total("gap", F.col("k") + 1) + total("size", F.col("k"))
    return each.select("file_path", F.regexp_extract("call", P.CALL_NAME, 0).alias("callee_name"), "line", col.alias("col"), *keep)


def below(path: Column, root: str) -> Column:
    """The path without the root before it, whatever characters that has."""
    start = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(start)), F.substring(path, F.lit(len(start) + 1), F.length(path))).otherwise(path)


def ctags(json_lines: DataFrame, root: str) -> DataFrame:
    """Symbols from tag lines in a column value: names, paths under root and positive lines only."""
    get = lambda key: F.get_json_object("value", f"$.{key}")
    text = lambda *keys: reduce(lambda a, k: F.coalesce(a, F.nullif(get(k), F.lit(""))), keys[1:], F.nullif(get(keys[0]), F.lit("")))
    number = lambda *keys: F.coalesce(*[F.when(get(k).try_cast("int") > 0, get(k).try_cast("int")) for k in keys])
    path = below(get("path"), root)
    rows = json_lines.where(F.coalesce(get("_type"), F.lit("")) != "ptag").select(
        text("name").alias("name"), path.alias("file_path"), F.coalesce(text("kind", "K"), F.lit("")).alias("kind"),
        F.coalesce(text("scope", "S"), F.lit("")).alias("scope"), number("line", "n").alias("start_line"), F.coalesce(number("end", "e"), F.lit(0)).alias("end_line"),
    )
    return rows.where("name is not null and file_path <> '' and start_line is not null").where(~F.col("file_path").rlike(r"^(\.\.|/)"))
