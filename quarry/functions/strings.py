"""String expressions whose results must not depend on locale or dialect."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Latin letters with a mark and their base letters, from their decompositions.
_PAIRS = [(chr(c), d[0]) for c in range(0xC0, 0x180) if len(d := unicodedata.normalize("NFD", chr(c))) > 1]
MARKED, BARE = ("".join(x) for x in zip(*_PAIRS))


def ascii_fold(c: Column) -> Column:
    """Lower-cases A-Z only, as SQL LIKE compares."""
    return F.translate(c, UPPER, LOWER)


def contains_folded(c: Column, needle: str) -> Column:
    return F.contains(ascii_fold(c), F.lit(needle.translate(str.maketrans(UPPER, LOWER))))


def under_dir(path: Column, directory: str) -> Column:
    """The directory itself (exactly), or below it (A-Z folded); an empty one holds all."""
    d = directory.strip().strip("/")
    if not d:
        return F.lit(True)
    folded = d.translate(str.maketrans(UPPER, LOWER))
    return (path == d) | F.startswith(ascii_fold(path), F.lit(folded + "/"))


def extension(path: Column) -> Column:
    """From the last dot of the last segment on, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def symbol_id(path: Column, kind: Column, name: Column, line: Column) -> Column:
    return F.concat_ws("#", path, kind, name, line.cast("string"))


_ID = r"(?s)^(.+)#([^#]+)#([^#]+)#([+-]?[0-9]+)$"


def parse_symbol_id(c: Column) -> Column:
    """(file_path, kind, name, start_line), null if invalid; read from the right, so paths may hold '#'."""
    part = lambda k: F.regexp_extract(c, _ID, k)
    line = part(4).try_cast("int")
    return F.when(c.rlike(_ID) & line.isNotNull(), F.struct(part(1).alias("file_path"), part(2).alias("kind"), part(3).alias("name"), line.alias("start_line")))


def fts_tokens(c: Column) -> Column:
    """Runs of letters, digits and private-use characters, without Latin marks, in lower case."""
    return F.regexp_extract_all(F.lower(F.translate(c, MARKED, BARE)), F.lit(r"[\p{L}\p{N}\p{Co}]+"), 0)


def fts_tokens_of(text: str) -> list[str]:
    """The same on the driver, for queries."""
    bare = text.translate(str.maketrans(MARKED, BARE)).lower()
    out, now = [], ""
    for ch in bare:
        if unicodedata.category(ch)[0] in "LN" or unicodedata.category(ch) == "Co":
            now += ch
        elif now:
            out.append(now)
            now = ""
    return [*out, now] if now else out
