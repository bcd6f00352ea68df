"""Explicit schemas of the index relations."""

from pyspark.sql import types as T

FILES = T.StructType(
    [T.StructField("path", T.StringType(), False)]
    + [T.StructField(c, T.LongType(), False) for c in ("mtime_ns", "size", "n_symbols", "n_tokens", "n_calls")]
    + [T.StructField("generation", T.StringType(), False)]
)
SYMBOLS = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in ("name", "file_path", "kind", "scope")]
    + [T.StructField(c, T.IntegerType(), False) for c in ("start_line", "end_line")]
    + [T.StructField(c, T.LongType(), True) for c in ("start_byte", "end_byte")]
)
CALL_SITES = T.StructType(
    [T.StructField("callee_name", T.StringType(), False), T.StructField("file_path", T.StringType(), False), T.StructField("line", T.IntegerType(), False), T.StructField("col", T.IntegerType(), False)]
    + [T.StructField(c, T.StringType(), False) for c in ("enclosing_name", "enclosing_kind", "enclosing_scope")]
)
#: Where a token is in a column of a symbol; dl is the number of tokens in all of the symbol's columns.
POSTINGS = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in ("token", "file_path", "kind", "name")]
    + [T.StructField("start_line", T.IntegerType(), False), T.StructField("col", T.StringType(), False)]
    + [T.StructField("positions", T.ArrayType(T.IntegerType()), False), T.StructField("dl", T.IntegerType(), False), T.StructField("generation", T.StringType(), False)]
)
VERSION = 2
