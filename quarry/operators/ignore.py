"""Ignore rules over paths: default directories, extensions, and ignore files with scopes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import patterns as P
from quarry.functions.strings import extension


def in_skipped_dir(path: Column) -> Column:
    """Whether a segment of the path, or the path's directory, is never entered."""
    return F.exists(F.split(path, "/"), lambda s: s.isin(*P.SKIPPED_DIRS))


def readable(path: Column) -> Column:
    ext = extension(path)
    return ext.isin(*P.ALLOWED) & ~ext.isin(*P.DENIED)


@dataclass(frozen=True)
class Pattern:
    ord: int
    scope: str
    negated: bool
    dir_only: bool
    anchored: bool
    regex: str


def glob_regex(glob: str) -> str | None:
    """A shell glob as a regular expression; * and ? stop at '/'. None if it is malformed."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] != "^" else i + 3)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            out += "[" + ("^" + re.escape(body[1:]).replace(r"\-", "-") if body.startswith("^") else re.escape(body).replace(r"\-", "-")) + "]"
            i = end
        elif c == "\\":
            if i + 1 == len(glob):
                return None
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def parse(content: str, scope: str = "", first: int = 0) -> list[Pattern]:
    """The patterns of an ignore file that lies in directory `scope`."""
    out = []
    for line in content.split("\n"):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        line = line[1:] if line.startswith("\\#") else line
        negated = line.startswith("!")
        line = line[1:] if negated else line
        dir_only = line.endswith("/")
        line = line[:-1] if dir_only else line
        anchored = line.startswith("/")
        regex = glob_regex(line.lstrip("/") if anchored else line) if line else None
        if regex and regex != "^$":
            out.append(Pattern(first + len(out), scope, negated, dir_only, anchored, regex))
    return out


def _tails(path: Column) -> Column:
    """The path, and what is left of it after each slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def _hits(path: Column, is_dir: Column, p: Pattern) -> Column:
    hit = path.rlike(p.regex) if p.anchored else F.exists(_tails(path), lambda t: t.rlike(p.regex))
    if p.dir_only:
        hit = hit & is_dir
    return hit & F.startswith(path, F.lit(p.scope + "/")) if p.scope else hit


def _verdict(path: Column, is_dir: Column, patterns: list[Pattern]) -> Column:
    """The last pattern that matches decides."""
    out = F.lit(False)
    for p in patterns:  # later ones override
        out = F.when(_hits(path, is_dir, p), F.lit(not p.negated)).otherwise(out)
    return out


def kept_paths(paths: DataFrame, patterns: list[Pattern], column: str = "path") -> DataFrame:
    """Paths that a crawl keeps: no skipped or ignored directory above, not ignored, readable."""
    parts = F.split(column, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    blocked = F.exists(above, lambda d: _verdict(d, F.lit(True), patterns))
    return paths.where(~in_skipped_dir(F.array_join(above, "/")) & readable(F.col(column)) & ~blocked & ~_verdict(F.col(column), F.lit(False), patterns))
