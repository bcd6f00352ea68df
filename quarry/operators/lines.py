"""Lines of texts, and bounded reads by line or byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.strings import symbol_id

MAX_LINES, MAX_BYTES, MAX_LINE = 500, 512 * 1024, 1024 * 1024


class ReadError(ValueError):
    """A read outside what a single call may return."""


class InvalidRange(ReadError):
    pass


class SpanTooLarge(ReadError):
    pass


class ResponseTooLarge(ReadError):
    pass


#: What a read of many files raises in its tasks, for the first file that is over a limit.
TOO_LARGE, TOO_MANY, TOO_LONG = "response too large", "span too large", "line too long"


def _refused(value: Column, *limits: tuple[Column, str]) -> Column:
    """The value; an error of the task, with the file's path, where a limit is passed."""
    for over, what in limits:
        value = F.when(over, F.raise_error(F.concat(F.lit(f"{what}: "), F.col("file_path"))).cast("string")).otherwise(value)
    return value


def line_array(text: Column) -> Column:
    """Lines split at newlines; no phantom last line, a trailing carriage return is dropped."""
    parts = F.split(text, "\n")
    whole = F.when(F.endswith(text, F.lit("\n")) | (text == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(whole, lambda x: F.regexp_replace(x, r"\r\z", ""))


def lines(files: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """(file_path, line, text), lines from 1."""
    return files.select(F.col(path).alias("file_path"), F.posexplode(line_array(F.col(text))).alias("p", "text")).select("file_path", (F.col("p") + 1).alias("line"), "text")


def line_counts(files: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    return files.select(F.col(path).alias("file_path"), F.size(line_array(F.col(text))).alias("n_lines"))


def too_long(lines_df: DataFrame) -> DataFrame:
    """Lines that a scan refuses."""
    return lines_df.where(F.octet_length("text") >= MAX_LINE)


def _numbered(some: Column, first: Column) -> Column:
    """Lines with their numbers and a tab before them, as one text."""
    return F.array_join(F.transform(some, lambda x, i: F.concat((i + first).cast("string"), F.lit("\t"), x)), "\n")


def _line_range(text: Column, start: Column, n: Column) -> Column:
    """Numbered lines from start on, refused if one up to there is too long or the answer too large."""
    every = line_array(text)
    upto = F.slice(every, F.lit(1), F.greatest(start + n - 1, F.lit(0)))
    content = _numbered(F.slice(every, start, F.greatest(n, F.lit(0))), start)
    return _refused(content, (F.octet_length(content) > MAX_BYTES, TOO_LARGE), (F.exists(upto, lambda x: F.octet_length(x) >= MAX_LINE), TOO_LONG))


def read_lines(files: DataFrame, start: int, end: int) -> DataFrame:
    """(file_path, content): numbered lines start..end of each file, as many as there are."""
    if start < 1 or end < start:
        raise InvalidRange("a range of lines from 1 on is needed")
    if end - start + 1 > MAX_LINES:
        raise SpanTooLarge(f"at most {MAX_LINES} lines in a read")
    return files.select("file_path", _line_range(F.col("text"), F.lit(start), F.lit(end - start + 1)).alias("content"))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Half-open bytes [start, end); an end past the file is cut, a start past it gives none."""
    return F.substring(text.cast("binary"), start.cast("int") + 1, F.greatest(F.least(end, F.octet_length(text)) - start, F.lit(0)).cast("int"))


def _byte_range(text: Column, start: Column, end: Column) -> Column:
    """Numbered lines of a byte range, the first one from its first byte on; refused beyond the limits."""
    raw = F.decode(byte_slice(text, start, end), "ISO-8859-1")  # a letter for each byte: a range may cut UTF-8 letters
    parts = F.split(raw, "\n")
    whole = F.when(F.endswith(raw, F.lit("\n")), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    content = F.when(raw == "", "").otherwise(_numbered(whole, line_at_byte(text, start)))
    refused = _refused(content, (F.length(content) > MAX_BYTES, TOO_LARGE), (F.size(parts) > MAX_LINES, TOO_MANY))
    return F.encode(refused, "ISO-8859-1").cast("string")


def read_bytes(files: DataFrame, start: int, end: int) -> DataFrame:
    """(file_path, content): the bytes [start, end) of each file as numbered lines."""
    if start < 0 or end <= start:
        raise InvalidRange("a range of bytes from 0 on is needed")
    if end - start > MAX_BYTES:
        raise ResponseTooLarge(f"at most {MAX_BYTES} bytes in a read")
    return files.select("file_path", _byte_range(F.col("text"), F.lit(start), F.lit(end)).alias("content"))


def line_at_byte(text: Column, at: Column) -> Column:
    """Line number of a byte offset: newlines before it, plus one."""
    before = F.substring(text.cast("binary"), F.lit(1), at.cast("int")).cast("string")
    return F.length(F.regexp_replace(before, r"[^\n]", "")) + 1


def read_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, content): a symbol's bytes if they are known and not empty, else its lines, numbered.

    A symbol over the limits of a read is an error of the task.
    """
    both = symbols.join(files.select("file_path", "text"), "file_path")
    known = F.coalesce((F.col("start_byte") >= 0) & (F.col("end_byte") > F.col("start_byte")), F.lit(False))
    size = F.when(known, F.col("end_byte") - F.col("start_byte")).otherwise(0)
    raw = F.when(known, _byte_range(F.col("text"), F.col("start_byte"), F.col("end_byte"))).otherwise("")
    span = F.col("end_line") - F.col("start_line") + 1
    some = _refused(_line_range(F.col("text"), F.col("start_line"), F.least(span, F.lit(MAX_LINES))), (span > MAX_LINES, TOO_MANY))
    content = _refused(F.when(raw != "", raw).otherwise(some), (size > MAX_BYTES, TOO_LARGE))
    return both.select(symbol_id(*map(F.col, ("file_path", "kind", "name", "start_line"))).alias("symbol_id"), content.alias("content"))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4).cast("long")


def grep(lines_df: DataFrame, tokens: list[str]) -> DataFrame:
    """Lines that hold all tokens, as path:line:text."""
    hit = F.lit(True)
    for t in tokens:
        hit = hit & F.contains("text", F.lit(t))
    return lines_df.where(hit).select(F.concat_ws(":", "file_path", F.col("line").cast("string"), "text").alias("hit"))
