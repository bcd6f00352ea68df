"""Lookups and full-text search over symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.strings import contains_folded, fts_tokens, fts_tokens_of, symbol_id, under_dir

COLUMNS = ("name", "file_path", "kind", "scope")
#: What tells symbols apart.
KEY = ("file_path", "kind", "name", "start_line")
K1, B = 1.2, 0.75


class BadQuery(ValueError):
    """A query without what it needs."""


def match_mode(mode: str) -> str:
    return "or" if mode.strip().lower() == "or" else "and"


def name_mode(mode: str) -> str:
    if mode not in ("exact", "contains"):
        raise BadQuery(f"name_match must be exact or contains, not {mode!r}")
    return mode


def by_name(symbols: DataFrame, name: str, mode: str = "exact") -> DataFrame:
    q = name.strip()
    return symbols.where(F.col("name") == q if name_mode(mode) == "exact" else contains_folded(F.col("name"), q))


def like_search(symbols: DataFrame, query: str, mode: str = "and") -> DataFrame:
    """Each word of the query in name or path (mode and), or any (mode or)."""
    tests = [contains_folded(F.col("name"), t) | contains_folded(F.col("file_path"), t) for t in query.split()]
    if not tests:
        return symbols.where(F.lit(False))
    return symbols.where(reduce((lambda a, b: a | b) if match_mode(mode) == "or" else (lambda a, b: a & b), tests))


def quoted_query(query: str, mode: str = "and") -> str:
    """The query as a match string of quoted words."""
    words = ['"' + w.replace('"', '""') + '"' for w in query.split()]
    return (" OR " if match_mode(mode) == "or" else " ").join(words) or '""'


def phrases_of(query: str) -> list[list[str]]:
    """Each word of a query is a phrase of tokens."""
    return [t for w in query.split() if (t := fts_tokens_of(w))]


def _hits(tokens: str, phrase: list[str]) -> Column:
    """How often the phrase is in the tokens, in a row."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    want, n = F.array(*map(F.lit, phrase)), len(phrase)
    starts = F.sequence(F.lit(1), F.size(tokens) - n + 1)
    return F.when(F.size(tokens) < n, 0).otherwise(F.size(F.filter(starts, lambda i: F.slice(tokens, i, n) == want)))


def tokenised(symbols: DataFrame) -> DataFrame:
    """symbols with t_<column> token arrays and dl, their number."""
    wide = symbols.withColumns({f"t_{c}": fts_tokens(F.coalesce(F.col(c), F.lit(""))) for c in COLUMNS})
    return wide.withColumn("dl", reduce(lambda a, b: a + b, [F.size(f"t_{c}") for c in COLUMNS]))


def length() -> Column:
    """Tokens in all columns of a symbol."""
    return reduce(lambda a, b: a + b, [F.size(fts_tokens(F.coalesce(F.col(c), F.lit("")))) for c in COLUMNS])


def postings(symbols: DataFrame) -> DataFrame:
    """(token, file_path, kind, name, start_line, col, positions, dl): the inverted index, from one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"t_{c}").alias("tokens")) for c in COLUMNS]))
    columns = tokenised(symbols).select(*KEY, "dl", each.alias("c"))
    words = columns.select(*KEY, "dl", F.col("c.col").alias("col"), F.posexplode("c.tokens").alias("pos", "token"))
    found = words.groupBy("token", *KEY, "col", "dl").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return found.select("token", *KEY, "col", "positions", "dl")


#: Tokens up to which a column's are gathered within its row; more cost the square of their number.
FEW_TOKENS = 64


def postings_of_unlike(symbols: DataFrame) -> DataFrame:
    """postings() of symbols that all differ in KEY: those of short columns need no shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"t_{c}").alias("tokens")) for c in COLUMNS]))
    columns = tokenised(symbols).select(*KEY, "dl", each.alias("c")).select(*KEY, "dl", "c.col", "c.tokens")
    found = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("token"), F.filter(F.transform("tokens", lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull()).alias("positions")))
    short = columns.where(F.size("tokens") <= FEW_TOKENS).select(*KEY, "dl", "col", F.explode(found).alias("p")).select("p.token", *KEY, "col", "p.positions", "dl")
    words = columns.where(F.size("tokens") > FEW_TOKENS).select(*KEY, "dl", "col", F.posexplode("tokens").alias("pos", "token"))
    long = words.groupBy("token", *KEY, "col", "dl").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return short.unionByName(long.select("token", *KEY, "col", "positions", "dl"))


def document_frequency(symbols: DataFrame) -> DataFrame:
    """(token, df, tf): rows that hold a token, and how often it occurs; both counted before the shuffle."""
    every = tokenised(symbols).select(F.flatten(F.array(*[f"t_{c}" for c in COLUMNS])).alias("all"))
    one = lambda df, tf: lambda t: F.struct(t.alias("token"), F.lit(df).alias("df"), F.lit(tf).alias("tf"))
    marks = F.concat(F.transform("all", one(0, 1)), F.transform(F.array_distinct("all"), one(1, 0)))
    return every.select(F.explode(marks).alias("m")).groupBy("m.token").agg(F.sum("m.df").alias("df"), F.sum("m.tf").alias("tf"))


def _total(counts: DataFrame, phrases: list[list[str]], mode: str) -> DataFrame:
    """The rows of counts (..., dl, f0, f1, ..., n_rows, avgdl, n0, ...) that match, with score."""
    total, found = F.lit(0.0), [F.col(f"f{k}") > 0 for k in range(len(phrases))]
    for k in range(len(phrases)):
        raw = F.log((F.col("n_rows") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
        f = F.col(f"f{k}")
        total = total + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    keep = reduce((lambda a, b: a | b) if match_mode(mode) == "or" else (lambda a, b: a & b), found)
    return counts.where(keep).withColumn("score", -total)


def _holding(phrases: list[list[str]]) -> list[Column]:
    return [F.sum((F.col(f"f{k}") > 0).cast("long")).alias(f"n{k}") for k in range(len(phrases))]


def bm25(symbols: DataFrame, query: str, mode: str = "and") -> DataFrame:
    """symbols that match, with score: BM25 over four columns, smaller is better. Reads all symbols.

    The corpus statistics of the query's phrases are one row, computed in one aggregate.
    """
    phrases = phrases_of(query)
    if not phrases:
        return symbols.where(F.lit(False)).withColumn("score", F.lit(0.0))
    wide = tokenised(symbols)
    for k, phrase in enumerate(phrases):
        wide = wide.withColumn(f"f{k}", reduce(lambda a, b: a + b, [_hits(f"t_{c}", phrase) for c in COLUMNS]))
    slim = wide.select(*symbols.columns, "dl", *[f"f{k}" for k in range(len(phrases))])
    stats = slim.agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avgdl"), *_holding(phrases))
    return _total(slim.join(F.broadcast(stats)), phrases, mode).select(*symbols.columns, "score")  # stats is one row


def _less(n: int):
    return lambda x: x - n


def bm25_stored(own: DataFrame, query: str, mode: str, n_rows: int, n_tokens: int) -> DataFrame:
    """(file_path, kind, name, start_line, score) from the postings of the query's tokens alone.

    own: postings of these tokens; n_rows and n_tokens are of all symbols. A phrase is where its
    tokens' positions, each moved back by its place in the phrase, agree within a column.
    """
    phrases = phrases_of(query)
    tokens = sorted({t for p in phrases for t in p})
    if not tokens:
        return own.select(*KEY, F.lit(0.0).alias("score")).where(F.lit(False))
    at = [F.max(F.when(F.col("token") == t, F.col("positions"))).alias(f"p{j}") for j, t in enumerate(tokens)]
    columns = own.groupBy(*KEY, "col", "dl").agg(*at)

    def hits(phrase: list[str]) -> Column:
        starts = [F.transform(f"p{tokens.index(t)}", _less(n)) for n, t in enumerate(phrase)]
        return F.coalesce(F.when(reduce(lambda a, b: a & b, [x.isNotNull() for x in starts]), F.size(reduce(F.array_intersect, starts))), F.lit(0))

    counts = columns.groupBy(*KEY, "dl").agg(*[F.sum(hits(p)).alias(f"f{k}") for k, p in enumerate(phrases)])
    wide = counts.join(F.broadcast(counts.agg(*_holding(phrases))))  # one row
    wide = wide.withColumns({"n_rows": F.lit(n_rows), "avgdl": F.lit(n_tokens / max(1, n_rows))})
    return _total(wide, phrases, mode).select(*KEY, "score")


def matched_in(query: str) -> Column:
    """The first of symbol, path, kind, scope that holds any word of the query; symbol by default."""
    out = None
    for c, label in zip(COLUMNS, ("symbol", "path", "kind", "scope")):
        hit = reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(t.lower())) for t in query.split()], F.lit(False))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("symbol")


def _shaped(df: DataFrame, query: str) -> DataFrame:
    return df.select(symbol_id(*map(F.col, KEY)).alias("symbol_id"), "name", "kind", "file_path", "start_line", matched_in(query).alias("matched_in"))


def search(symbols: DataFrame, query: str, limit: int = 10, mode: str = "and", name_match: str | None = None) -> DataFrame:
    """Ranked hits without an index: by name if name_match is given, else full text, else (no hit) words in name or path."""
    limit = limit if limit > 0 else 10
    if name_match is not None:
        return _shaped(by_name(symbols, query, name_match), query).orderBy("file_path", "start_line", "name").limit(limit)
    full = bm25(symbols, query, mode)
    none = full.limit(1).agg((F.count("*") == 0).alias("none"))
    other = like_search(symbols, query, mode).join(F.broadcast(none)).where("none").drop("none").withColumn("score", F.lit(0.0))
    both = full.unionByName(other)  # one of them is empty
    return _shaped(both.orderBy("score", "file_path", "start_line", "name").limit(limit), query)


def ranked(store, query: str, limit: int, mode: str, version: int | None = None) -> DataFrame:
    """The best hits of the stored index, as symbols with score; reads the postings of the query's tokens."""
    manifest = store.manifest(version)
    tokens = {t for p in phrases_of(query) for t in p}
    stats = manifest["stats"]
    scored = bm25_stored(store.live_postings(tokens, manifest), query, mode, stats["n_symbols"], stats["n_tokens"])
    return scored.orderBy("score", "file_path", "start_line", "name").limit(limit)


def search_stored(store, query: str, limit: int = 10, mode: str = "and", name_match: str | None = None) -> DataFrame:
    """search() over a stored index, of one version. Runs the ranking: its few hits pick the files whose symbols are read."""
    limit = limit if limit > 0 else 10
    version = store.manifest()["version"]
    hits = [] if name_match is not None else ranked(store, query, limit, mode, version).collect()
    if not hits:
        symbols = store.read("symbols", version)
        found = by_name(symbols, query, name_match) if name_match is not None else like_search(symbols, query, mode)
        return _shaped(found.orderBy("file_path", "start_line", "name").limit(limit), query)
    paths = sorted({r.file_path for r in hits})
    symbols = store.read("symbols", version, paths).where(F.col("file_path").isin(paths))
    top = store.spark.createDataFrame([tuple(r) for r in hits], "file_path string, kind string, name string, start_line int, score double")
    return _shaped(symbols.join(F.broadcast(top), list(KEY)).orderBy("score", "file_path", "start_line", "name"), query)  # at most limit rows


def needed(value: str, what: str) -> str:
    """The value without blanks around it; BadQuery if nothing is left."""
    if not value.strip():
        raise BadQuery(f"{what} is needed")
    return value.strip()


def outline(symbols: DataFrame, file_path: str) -> DataFrame:
    out = symbols.where(F.col("file_path") == needed(file_path, "a file"))
    return out.select(symbol_id(*map(F.col, ("file_path", "kind", "name", "start_line"))).alias("symbol_id"), "name", "kind", "scope", "start_line", "end_line").orderBy("start_line", "name")


def find_callers(calls: DataFrame, callee: str, directory: str = "", limit: int = 20) -> DataFrame:
    hits = calls.where((F.col("callee_name") == needed(callee, "a callee")) & under_dir(F.col("file_path"), directory))
    return hits.orderBy("file_path", "line", "col").limit(limit if limit > 0 else 20)


def outgoing(calls: DataFrame, directory: str) -> DataFrame:
    """Distinct (callee, file, line) under a directory, with the least column and least enclosing parts."""
    some = calls.where(under_dir(F.col("file_path"), directory))
    return some.groupBy("callee_name", "file_path", "line").agg(*[F.min(c).alias(c) for c in ("col", "enclosing_name", "enclosing_kind", "enclosing_scope")])


def map_directory(symbols: DataFrame, calls: DataFrame, directory: str, max_definitions: int = 50, max_outgoing: int = 50) -> DataFrame:
    """One row: counts before limits, definitions and outgoing calls as arrays."""
    if not directory.strip().strip("/"):
        raise BadQuery("a directory is needed")
    own = symbols.where(under_dir(F.col("file_path"), directory))
    out = outgoing(calls, directory)
    definitions = own.orderBy("file_path", "start_line", "name").limit(max_definitions if max_definitions > 0 else 50)
    defs = definitions.agg(F.sort_array(F.collect_list(F.struct("file_path", "start_line", "name", "kind", "scope", "end_line"))).alias("definitions"))
    some = out.orderBy("file_path", "line", "callee_name").limit(max_outgoing if max_outgoing > 0 else 50)
    calls_out = some.agg(F.sort_array(F.collect_list(F.struct("file_path", "line", "callee_name", "col", "enclosing_name"))).alias("outgoing"))
    counts = own.agg(F.count("*").alias("n_definitions")).join(F.broadcast(out.agg(F.count("*").alias("n_outgoing"))))  # single rows
    return counts.join(F.broadcast(defs)).join(F.broadcast(calls_out)).select(F.lit(directory).alias("dir"), "*")
