"""Sources read beyond single lines: definitions with their bounds, calls and syntax errors.

Python is read by its grammar, Go and TypeScript by their tokens (see braces).
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import braces
from quarry.operators.extract import supported

PYTHON = (".py", ".pyw")


class Unsupported(ValueError):
    """A file of a language that can't be checked."""


MESSAGE_BYTES = 80


def _short(message: str) -> str:
    raw = message.encode()
    return message if len(raw) <= MESSAGE_BYTES else raw[:MESSAGE_BYTES].decode("utf-8", "ignore") + "..."


def _python(path: str) -> bool:
    return path.lower().endswith(PYTHON)


def errors_of(path: str, source: str) -> list[tuple[int, int, str]]:
    """(line, byte column, message): Python's first error; unmatched brackets and open strings elsewhere."""
    if not _python(path):
        read = braces.Source(source, braces.language(path))
        return [(read.line(at), read.column(at), _short(message)) for at, message in sorted(read.errors)]
    try:
        ast.parse(source)
    except SyntaxError as e:
        return [(e.lineno or 1, e.offset or 1, _short(e.msg or "syntax error"))]
    except ValueError:
        return [(1, 1, "syntax error")]
    return []


def _python_definitions(source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    raw = source.encode()
    starts = [0]
    for line in raw.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first, at = node.lineno, starts[node.lineno - 1] + node.col_offset
            if node.decorator_list:  # decorators belong to a definition
                d = node.decorator_list[0]
                first, at = d.lineno, raw.rfind(b"@", 0, starts[d.lineno - 1] + d.col_offset + 1)
            out.append((node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, first, node.end_lineno, at, starts[node.end_lineno - 1] + node.end_col_offset))
    return sorted(out, key=lambda d: (d[2], d[0]))


def definitions_of(path: str, source: str) -> list[tuple[str, str, int, int, int, int, int]]:
    """(name, kind, match_line, start_line, end_line, start_byte, end_byte) in document order."""
    return _python_definitions(source) if _python(path) else braces.Source(source, braces.language(path)).definitions()


def _python_calls(source: str) -> list[tuple[str, int, int]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                out.append((f.id, f.lineno, f.col_offset + 1))
            elif isinstance(f, ast.Attribute):
                out.append((f.attr, f.end_lineno, f.end_col_offset - len(f.attr.encode()) + 1))
    return sorted(out, key=lambda c: c[1:])


def calls_of(path: str, source: str) -> list[tuple[str, int, int]]:
    """(callee, line, byte column from 1) of calls of names and members."""
    return _python_calls(source) if _python(path) else braces.Source(source, braces.language(path)).calls()


def _each(files: DataFrame, read, columns: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, k, *r) for p, t in zip(b.file_path, b.text) for k, r in enumerate(read(p, t or ""))]
            yield pd.DataFrame(rows, columns=["file_path", "ord", *columns])

    return files.where(supported(F.col("file_path"))).select("file_path", "text").mapInPandas(run, f"file_path string, ord int, {schema}")


def check(files: DataFrame) -> DataFrame:
    """(file_path, line, col, message) of what is wrong; files of other languages have no rows."""
    return _each(files, errors_of, ["line", "col", "message"], "line int, col int, message string").drop("ord")


def definitions(files: DataFrame) -> DataFrame:
    columns = ["name", "kind", "match_line", "start_line", "end_line", "start_byte", "end_byte"]
    return _each(files, definitions_of, columns, "name string, kind string, match_line int, start_line int, end_line int, start_byte long, end_byte long")


def calls(files: DataFrame) -> DataFrame:
    return _each(files, calls_of, ["callee_name", "line", "col"], "callee_name string, line int, col int").drop("ord")


def refined(symbols: DataFrame, found: DataFrame) -> DataFrame:
    """symbols (file_path, name, kind, scope, start_line, end_line) with the bounds of their definitions.

    found: definitions(). Of those of the same file and name, at most a line off, the nearest
    counts, the first of several; a symbol without one stays as it is, without bytes.
    """
    near = F.abs(F.col("match_line") - F.col("s_line"))
    bounds = F.struct(near.alias("d"), "ord", *[F.col(c).alias(f"at_{c}") for c in ("start_line", "end_line", "start_byte", "end_byte")])
    key = symbols.select("file_path", "name", F.col("start_line").alias("s_line")).distinct()
    best = found.join(key, ["file_path", "name"]).where(near <= 1).groupBy("file_path", "name", "s_line").agg(F.min(bounds).alias("b"))
    both = symbols.withColumnRenamed("start_line", "s_line").join(best, ["file_path", "name", "s_line"], "left")
    lines = [F.coalesce("b.at_start_line", "s_line").alias("start_line"), F.coalesce("b.at_end_line", "end_line").alias("end_line")]
    return both.select("file_path", "name", "kind", "scope", *lines, F.col("b.at_start_byte").alias("start_byte"), F.col("b.at_end_byte").alias("end_byte"))
