"""Column expressions over whole texts. Words are runs of anything but [\\x20\\x09-\\x0D]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "\t\n\u000b\u000c\r"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def word_chars(text: Column) -> Column:
    return F.length(F.replace(F.translate(text, BLANKS, " " * len(BLANKS)), F.lit(" "), F.lit(""))).cast("long")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
