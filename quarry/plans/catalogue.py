"""The registered queries over the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import strings as S
from quarry.index import CodeIndex, to_json
from quarry.operators import extract, ignore, lines, relate, search, syntax
from quarry.operators.store import Snapshots
from quarry.session import work_folder
from quarry.sources import corpus as C
from quarry.sources import tree
from quarry.streaming import feed

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _src(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, symbols, calls with their enclosing symbols) of the synthetic tree."""
    every = C.source_lines(spark, d)
    return every, extract.symbols_with_ends(every), extract.enclosed_calls(every)


_STORED: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, d: str, name: str, build: Callable[[Snapshots], object]) -> Snapshots:
    """An index in the shared folder, built by the first query of the session that asks for it."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STORED:
        path = work_folder(spark, name)
        build(Snapshots(spark, path))
        _STORED[key] = path
    return Snapshots(spark, _STORED[key])


def _text_symbols(spark: SparkSession, d: str) -> DataFrame:
    unset = {c: F.lit(None).cast("long") for c in ("start_byte", "end_byte")}
    return C.texts(spark, d).drop("doc_id").withColumns({"end_line": F.lit(1)} | unset)


def _no_calls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "callee_name string, file_path string, line int, col int, enclosing_name string, enclosing_kind string, enclosing_scope string")


def _meta_of(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.col("file_path").alias("path"), F.lit(0).alias("mtime_ns"), F.octet_length(F.coalesce("scope", F.lit(""))).alias("size"))


def _texts_index(spark: SparkSession, d: str) -> Snapshots:
    """The documents as a stored index with postings."""
    symbols = _text_symbols(spark, d)
    return _stored(spark, d, "texts", lambda store: store.apply(_meta_of(symbols), symbols, _no_calls(spark), indexer="text"))


def _tree_files(spark: SparkSession, d: str) -> DataFrame:
    """The synthetic source tree as files (path, mtime_ns, size, text)."""
    whole = C.source_files(spark, d).withColumnRenamed("file_path", "path")
    return whole.select("path", F.lit(0).cast("long").alias("mtime_ns"), F.octet_length("text").cast("long").alias("size"), "text")


def _source_index(spark: SparkSession, d: str, name: str = "source") -> Snapshots:
    """The synthetic source tree as a stored index."""
    return _stored(spark, d, name, lambda store: CodeIndex(spark, store.path).apply(_tree_files(spark, d)))


IGNORED = ignore.parse("# generated\n*.test.js\n!f7*.test.js\n/docs/\nlib/*/\n", "") + ignore.parse("f1?.go\n", "src", 10)
ROUND = 9

# --- sources


@query("S2_skipped_dirs", f"WITH {C.TREE_PATHS} SELECT path FROM paths WHERE NOT regexp_matches(path, '(^|/)(\\.git|node_modules|vendor|dist|build|target|__pycache__|\\.next|out|coverage|\\.cache)/')")
def s2(spark, d):
    return C.tree_paths(spark, d).where(~ignore.in_skipped_dir(F.regexp_replace("path", "[^/]*$", "")))


@query("S3_ext_filter", f"WITH {C.TREE_PATHS} SELECT path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM paths WHERE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.go', '.py', '.ts', '.js')")
def s3(spark, d):
    return C.tree_paths(spark, d).where(ignore.readable(F.col("path"))).select("path", S.extension(F.col("path")).alias("ext"))


@query(
    "S5_ignore",
    f"""WITH {C.TREE_PATHS}, v AS (SELECT path, regexp_extract(path, '[^/]*$') AS base FROM paths)
SELECT path FROM v WHERE NOT regexp_matches(path, '(^|/)(node_modules|vendor)/') AND lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.go', '.py', '.ts', '.js')
AND NOT (path LIKE 'docs/%') AND NOT regexp_matches(path, '^lib/[^/]*/')
AND NOT (base LIKE '%.test.js' AND base NOT LIKE 'f7%') AND NOT (path LIKE 'src/%' AND regexp_matches(base, '^f1.\\.go$'))""",
)
def s5(spark, d):
    return ignore.kept_paths(C.tree_paths(spark, d), IGNORED)


@query("S7_supported", f"WITH {C.TREE_PATHS} SELECT path FROM paths WHERE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.go', '.py', '.ts', '.js')")
def s7(spark, d):
    return C.tree_paths(spark, d).where(extract.supported(F.col("path")))


LINES = "ln AS (SELECT file_path, unnest(string_split(t, chr(10))) AS text, CAST(generate_subscripts(string_split(t, chr(10)), 1) AS INT) AS line FROM (SELECT file_path, CASE WHEN scope LIKE '%'||chr(10) THEN substr(scope, 1, length(scope) - 1) ELSE scope END AS t FROM txt WHERE scope <> ''))"


@query("S8_lines", f"WITH {C.TEXTS}, {LINES} SELECT file_path, line, regexp_replace(text, chr(13)||'$', '') AS text FROM ln")
def s8(spark, d):
    return lines.lines(C.files(spark, d))


@query("S9_line_count", f"WITH {C.TEXTS} SELECT file_path, CAST(CASE WHEN scope = '' THEN 0 ELSE len(string_split(scope, chr(10))) - CASE WHEN scope LIKE '%'||chr(10) THEN 1 ELSE 0 END END AS INT) AS n_lines FROM txt")
def s9(spark, d):
    return lines.line_counts(C.files(spark, d))


@query(
    "S10_ctags_json",
    "SELECT p_name AS name, 'src/'||p_partkey||'.go' AS file_path, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS kind, p_brand AS scope, CAST(p_size AS INT) AS start_line, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size + 3 ELSE 0 END AS INT) AS end_line FROM part WHERE p_partkey % 11 <> 0 AND p_size > 0 AND p_partkey % 13 <> 0",
)
def s10(spark, d):
    p = C.table(spark, d, "part")
    path = F.when(F.col("p_partkey") % 13 == 0, F.lit("../x.go")).otherwise(F.concat(F.lit("/repo/src/"), "p_partkey", F.lit(".go")))
    even = F.col("p_partkey") % 2 == 0
    tag = F.struct(
        F.when(F.col("p_partkey") % 11 == 0, "ptag").otherwise("tag").alias("_type"), F.col("p_name").alias("name"), path.alias("path"), F.when(even, F.col("p_size")).alias("line"), F.when(~even, F.col("p_size")).alias("n"),
        F.when(F.col("p_partkey") % 3 == 1, F.col("p_type")).alias("kind"), F.when(F.col("p_partkey") % 3 == 2, F.col("p_type")).alias("K"), F.col("p_brand").alias("S"), F.when(even, F.col("p_size") + 3).alias("e"),
    )
    return extract.ctags(p.select(F.to_json(tag).alias("value")), "/repo")


@query(
    "S11_tolerant_getters",
    "SELECT p_name AS name, 'a/'||p_partkey||'.go' AS file_path, CASE WHEN p_partkey % 4 = 0 THEN 'K'||p_size ELSE '' END AS kind, '' AS scope, CAST(p_size AS INT) AS start_line, CAST(CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE 0 END AS INT) AS end_line FROM part WHERE p_partkey % 7 <> 0 AND p_size > 0",
)
def s11(spark, d):
    """Numbers as strings, empty strings and words where numbers should be."""
    p, n = C.table(spark, d, "part"), F.col("p_partkey")
    tag = F.struct(
        F.col("p_name").alias("name"), F.concat(F.lit("/r+(x)/a/"), "p_partkey", F.lit(".go")).alias("path"), F.when(n % 7 == 0, "none").otherwise(F.col("p_size").cast("string")).alias("line"),
        F.when(n % 2 == 0, "").alias("kind"), F.when(n % 4 == 0, F.concat(F.lit("K"), "p_size")).alias("K"), F.when(n % 5 == 0, (F.col("p_size") + 1).cast("string")).otherwise("end").alias("end"),
    )
    return extract.ctags(p.select(F.to_json(tag).alias("value")), "/r+(x)")


@query("S12_paths", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'x/'||p_partkey WHEN 1 THEN '/other/'||p_partkey ELSE 'rel/'||p_partkey END AS path FROM part")
def s12(spark, d):
    p, n = C.table(spark, d, "part"), F.col("p_partkey")
    path = F.concat(F.when(n % 3 == 0, "/a[b]+c/x/").when(n % 3 == 1, "/other/").otherwise("rel/"), "p_partkey")
    return p.select("p_partkey", extract.below(path, "/a[b]+c/").alias("path"))


@query(
    "S4_ignore_parse",
    "SELECT * FROM (VALUES (0, '', false, false, false, 'a'), (1, '', true, false, false, 'b*'), (2, '', false, true, false, 'dir'), (3, '', false, false, true, '/top'), (4, '', false, false, false, '#x')) v(ord, scope, negated, dir_only, anchored, line)",
)
def s4(spark, d):
    found = ignore.parse("# note\n\n  a  \n!b*\ndir/\n/top\n\\#x\n!\n")
    shown = {"^a$": "a", "^b[^/]*$": "b*", "^dir$": "dir", "^top$": "/top", "^\\#x$": "#x"}
    return spark.createDataFrame([(p.ord, p.scope, p.negated, p.dir_only, p.anchored, shown[p.regex]) for p in found], "ord int, scope string, negated boolean, dir_only boolean, anchored boolean, line string")


#: Ignore files of the written tree: the root's, a nested one, and .git/info/exclude.
RULES = {".gitignore": "# generated\n*.test.js\n!f7*.test.js\nlib/*/\n", "src/.gitignore": "f1?.go\n", "docs/.gitignore": "*.go\n!f*3.go\n", ".git/info/exclude": "/docs/f2*\n"}


def _written_tree(spark: SparkSession, d: str) -> str:
    """The paths of part as files on disk, each of as many bytes as its path has letters."""
    key = (spark.sparkContext.applicationId, d, "tree")
    if key not in _STORED:
        root = work_folder(spark, "tree").removeprefix("file:")
        for path, text in [*((r.path, r.path) for r in C.tree_paths(spark, d).collect()), *RULES.items()]:  # a file system's worth
            os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
            with open(os.path.join(root, path), "w") as f:
                f.write(text)
        _STORED[key] = root
    return _STORED[key]


@query(
    "S1_crawl",
    f"""WITH {C.TREE_PATHS}, v AS (SELECT path, regexp_extract(path, '[^/]*$') AS base FROM paths)
SELECT path, CAST(length(path) AS BIGINT) AS size FROM v WHERE NOT regexp_matches(path, '(^|/)(node_modules|vendor)/') AND lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.go', '.py', '.ts', '.js')
AND NOT regexp_matches(path, '^lib/[^/]*/') AND NOT (base LIKE '%.test.js' AND base NOT LIKE 'f7%') AND NOT (path LIKE 'src/%' AND regexp_matches(base, '^f1.\\.go$'))
AND NOT (path LIKE 'docs/%' AND base LIKE '%.go' AND NOT regexp_matches(base, '^f.*3\\.go$')) AND NOT (path LIKE 'docs/f2%' AND NOT regexp_matches(base, '^f.*3\\.go$'))""",
)
def s1(spark, d):
    return tree.crawl(spark, _written_tree(spark, d)).select("path", "size")


@query("S14_symbols_by_file", f"WITH {C.SOURCE_SYMBOLS}, f AS (SELECT max(file_path) AS p FROM symbols) SELECT name, kind, scope, start_line, end_line FROM symbols, f WHERE file_path = p")
def s14(spark, d):
    store = _source_index(spark, d)
    last = store.read("files").where("n_symbols > 0").agg(F.max("path")).first()[0]
    return store.read("symbols", keys=[last]).where(F.col("file_path") == last).orderBy("start_line").select("name", "kind", "scope", "start_line", "end_line")


# --- ids, tokens


@query("X1_symbol_id", f"WITH {C.TEXTS} SELECT doc_id, file_path||'#'||kind||'#'||name||'#'||start_line AS symbol_id FROM txt")
def x1(spark, d):
    return C.texts(spark, d).select("doc_id", S.symbol_id(*map(F.col, ("file_path", "kind", "name", "start_line"))).alias("symbol_id"))


@query("X2_parse_id", "SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN 'a#b/'||p_brand END AS file_path, CASE WHEN p_partkey % 4 > 0 THEN p_type END AS kind, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS name, CASE WHEN p_partkey % 4 > 0 THEN p_size END AS start_line FROM part")
def x2(spark, d):
    p = C.table(spark, d, "part")
    key = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("broken#"), "p_name")).otherwise(F.concat_ws("#", F.lit("a"), F.concat(F.lit("b/"), "p_brand"), "p_type", "p_name", F.col("p_size").cast("string")))
    return p.select("p_partkey", S.parse_symbol_id(key).alias("s")).select("p_partkey", "s.*")


TOKENS = f"WITH {C.TEXTS}, tok AS (SELECT *, regexp_extract_all(lower(strip_accents(name)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS t1, regexp_extract_all(lower(strip_accents(file_path)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS t2, regexp_extract_all(lower(strip_accents(kind)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS t3, regexp_extract_all(lower(strip_accents(scope)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS t4 FROM txt)"


@query("X3_tokens", TOKENS + " SELECT doc_id, array_to_string(t4, ' ') AS tokens, CAST(len(t1) + len(t2) + len(t3) + len(t4) AS INT) AS dl FROM tok")
def x3(spark, d):
    return search.tokenised(C.texts(spark, d)).select("doc_id", F.array_join("t_scope", " ").alias("tokens"), "dl")


@query("A5_document_frequency", TOKENS + ", w AS (SELECT doc_id, unnest(list_concat(list_concat(t1, t2), list_concat(t3, t4))) AS token FROM tok) SELECT token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM w GROUP BY token")
def a5(spark, d):
    return search.document_frequency(C.texts(spark, d))


@query("X5_postings", TOKENS + ", w AS (SELECT doc_id, 'kind' AS col, unnest(t3) AS token, generate_subscripts(t3, 1) - 1 AS pos FROM tok UNION ALL SELECT doc_id, 'name', unnest(t1), generate_subscripts(t1, 1) - 1 FROM tok UNION ALL SELECT doc_id, 'file_path', unnest(t2), generate_subscripts(t2, 1) - 1 FROM tok UNION ALL SELECT doc_id, 'scope', unnest(t4), generate_subscripts(t4, 1) - 1 FROM tok) SELECT token, doc_id, col, array_to_string(list_sort(list(pos)), ',') AS positions FROM w GROUP BY ALL")
def x5p(spark, d):
    found = search.postings(C.texts(spark, d))
    return found.select("token", F.substring("name", 4, 20).cast("long").alias("doc_id"), "col", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def _bm25_sql(phrases: list[list[str]], glue: str, tail: str = "") -> str:
    hits = lambda p: " + ".join(f"len(list_filter(range(1, len(t{k}) - {len(p)} + 2), lambda i: t{k}[i:i + {len(p) - 1}] = {p!r}))" for k in range(1, 5))
    f = ", ".join(f"{hits(p)} AS f{k}" for k, p in enumerate(phrases))
    n = ", ".join(f"sum(CASE WHEN f{k} > 0 THEN 1 ELSE 0 END) AS n{k}" for k in range(len(phrases)))
    term = " + ".join(f"CASE WHEN ln((nr - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((nr - n{k} + 0.5) / (n{k} + 0.5)) END * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in range(len(phrases)))
    return TOKENS + f", hit AS (SELECT *, len(t1) + len(t2) + len(t3) + len(t4) AS dl, {f} FROM tok), st AS (SELECT count(*) AS nr, avg(dl) AS avgdl, {n} FROM hit), scored AS (SELECT doc_id, file_path, name, kind, scope, start_line, -({term}) AS score FROM hit, st WHERE {glue.join(f'f{k} > 0' for k in range(len(phrases)))})" + (tail or f" SELECT doc_id, round(score, {ROUND}) AS score FROM scored")


def _scored(spark, d, text, mode, limit=None):
    """Scores from the stored index: only the postings of the query's tokens are read."""
    store = _texts_index(spark, d)
    stats, tokens = store.manifest()["stats"], {t for p in search.phrases_of(text) for t in p}
    own = search.ranked(store, text, limit, mode) if limit else search.bm25_stored(store.live_postings(tokens), text, mode, stats["n_symbols"], stats["n_tokens"])
    return own.select(F.substring("name", 4, 20).cast("long").alias("doc_id"), F.round("score", ROUND).alias("score"))


@query("X6_bm25_and", _bm25_sql([["the"], ["idiot"]], " AND "))
def x6a(spark, d):
    return _scored(spark, d, "the idiot", "and")


@query("X6_bm25_or", _bm25_sql([["clown"], ["scum"], ["src3"]], " OR "))
def x6o(spark, d):
    return _scored(spark, d, "clown scum src3", "or")


@query("X5_phrase", _bm25_sql([["en", "src4"]], " AND "))
def x5(spark, d):
    return _scored(spark, d, "en/src4", "and")


@query("T1_ranked_top", _bm25_sql([["loser"], ["trash"]], " OR ", f" SELECT doc_id, round(score, {ROUND}) AS score FROM scored ORDER BY score.score, file_path, start_line LIMIT 10".replace("score.score", "scored.score")))
def t1(spark, d):
    return _scored(spark, d, "loser trash", "or", 10)


@query("X6_bm25_unindexed", _bm25_sql([["the"], ["idiot"]], " AND "))
def x6u(spark, d):
    return search.bm25(C.texts(spark, d), "the idiot", "and").select("doc_id", F.round("score", ROUND).alias("score"))


@query("J1_postings_to_symbols", _bm25_sql([["pathetic"]], " AND ", " SELECT name, kind, file_path, length(scope) AS n FROM scored ORDER BY score, file_path, start_line, name LIMIT 15"))
def j1(spark, d):
    """The ranked postings' symbols, whole rows."""
    store = _texts_index(spark, d)
    top = search.ranked(store, "pathetic", 15, "and")
    return store.read("symbols").join(F.broadcast(top), list(search.KEY)).select("name", "kind", "file_path", F.length("scope").cast("long").alias("n"))  # 15 rows


@query("X4_match_string", """SELECT * FROM (VALUES (0, '"a""b" "c"'), (1, '"x" OR "y"'), (2, '""')) v(k, text)""")
def x4(spark, d):
    return spark.createDataFrame([(k, search.quoted_query(q, m)) for k, (q, m) in enumerate((('a"b  c', "and"), (" x y", "OR"), ("  ", "or")))], "k int, text string")


MATCHED = "CASE WHEN contains(lower(name), 'doc1') OR contains(lower(name), 'src2') THEN 'symbol' WHEN contains(lower(file_path), 'doc1') OR contains(lower(file_path), 'src2') THEN 'path' WHEN contains(lower(kind), 'doc1') OR contains(lower(kind), 'src2') THEN 'kind' WHEN contains(lower(scope), 'doc1') OR contains(lower(scope), 'src2') THEN 'scope' ELSE 'symbol' END"


@query("X8_matched_in", f"WITH {C.TEXTS} SELECT doc_id, {MATCHED} AS matched_in FROM txt")
def x8(spark, d):
    return C.texts(spark, d).select("doc_id", search.matched_in("doc1 SRC2").alias("matched_in"))


@query("X9_search_fallback", f"WITH {C.TEXTS} SELECT file_path||'#'||kind||'#'||name||'#1' AS symbol_id, name, kind, file_path, start_line, 'symbol' AS matched_in FROM txt WHERE contains(name, 'oc12') ORDER BY file_path, start_line, name LIMIT 10")
def x9(spark, d):
    return search.search_stored(_texts_index(spark, d), "oc12")


@query("X9_search_ranked", _bm25_sql([["moron"], ["pathetic"]], " OR ", " SELECT file_path||'#'||kind||'#'||name||'#1' AS symbol_id, name, kind, file_path, start_line, 'scope' AS matched_in FROM scored ORDER BY score, file_path, start_line, name LIMIT 10"))
def x9r(spark, d):
    return search.search_stored(_texts_index(spark, d), "moron pathetic", mode="or")


# --- extraction


@query("X10_regex_symbols", f"WITH {C.SOURCE_SYMBOLS} SELECT file_path, name, kind, start_line FROM symbols")
def x10(spark, d):
    return extract.symbols(C.source_lines(spark, d)).drop("scope")


@query("W2_sticky_scope", f"WITH {C.SOURCE_SYMBOLS} SELECT file_path, name, scope, start_line FROM symbols")
def w2(spark, d):
    return extract.symbols(C.source_lines(spark, d)).drop("kind")


@query("W1_end_lines", f"WITH {C.SOURCE_SYMBOLS} SELECT file_path, name, kind, scope, start_line, end_line FROM symbols")
def w1(spark, d):
    return _src(spark, d)[1]


PAGE_CALLS = "WITH p AS (SELECT 'page/'||page_id||'.html' AS file_path, unnest(string_split(html, chr(10))) AS text, generate_subscripts(string_split(html, chr(10)), 1) AS line FROM pages), g AS (SELECT file_path, CAST(line AS INT) AS line, string_split_regex(text, '\\b[A-Za-z_]\\w*[\\t\\n\\f\\r ]*\\(') AS gaps, regexp_extract_all(text, '\\b[A-Za-z_]\\w*[\\t\\n\\f\\r ]*\\(') AS calls FROM p), e AS (SELECT *, unnest(range(1, len(calls) + 1)) AS k FROM g), sites AS (SELECT file_path, regexp_extract(calls[k], '^\\w+') AS callee_name, line, CAST(1 + list_sum(list_transform(gaps[1:k], lambda x: strlen(x))) + coalesce(list_sum(list_transform(calls[1:k - 1], lambda x: strlen(x))), 0) AS INT) AS col FROM e)"


@query("X11_call_sites_pages", PAGE_CALLS + " SELECT file_path, callee_name, line, col FROM sites")
def x11p(spark, d):
    return extract.call_sites(lines.lines(C.pages(spark, d)), every_file=True)


@query("X11_call_sites_src", f"WITH {C.SOURCE_SYMBOLS} SELECT file_path, callee_name, line, col FROM sites")
def x11s(spark, d):
    return extract.call_sites(C.source_lines(spark, d))


@query("T3_find_callers", PAGE_CALLS + " SELECT file_path, callee_name, line, col FROM sites WHERE callee_name = 'track' ORDER BY file_path, line, col LIMIT 20")
def t3(spark, d):
    return search.find_callers(extract.call_sites(lines.lines(C.pages(spark, d)), every_file=True), "track")


# --- joins

ENCLOSED = "SELECT c.file_path, callee_name, line, col, coalesce(arg_min(name, (end_line - start_line, start_line, name, kind, scope)), '') AS enclosing_name, coalesce(arg_min(kind, (end_line - start_line, start_line, name, kind, scope)), '') AS enclosing_kind, coalesce(arg_min(scope, (end_line - start_line, start_line, name, kind, scope)), '') AS enclosing_scope FROM icall c LEFT JOIN isym s ON c.file_path = s.file_path AND line BETWEEN start_line AND end_line GROUP BY ALL"


@query("J2_innermost", f"WITH {C.INTERVALS} {ENCLOSED}")
def j2(spark, d):
    symbols, calls = C.intervals(spark, d)
    return relate.enclose(calls, symbols)


@query("J2_innermost_src", f"WITH {C.SOURCE_SYMBOLS} SELECT * FROM calls")
def j2s(spark, d):
    return _src(spark, d)[2]


@query("J3_enclosing_id", f"WITH {C.SOURCE_SYMBOLS}, m AS (SELECT c.file_path, callee_name, line, col, enclosing_name, enclosing_kind, enclosing_scope, min(start_line) AS first_line FROM calls c LEFT JOIN symbols s ON c.file_path = s.file_path AND enclosing_name = name AND enclosing_kind = kind AND enclosing_scope = scope AND line BETWEEN start_line AND end_line GROUP BY ALL) SELECT * EXCLUDE (first_line), coalesce(file_path||'#'||enclosing_kind||'#'||enclosing_name||'#'||first_line, '') AS enclosing_id FROM m")
def j3(spark, d):
    _, symbols, calls = _src(spark, d)
    return relate.enclosing_ids(calls, symbols)


DIFF = "CASE WHEN i.path IS NULL THEN 'new' WHEN t.path IS NULL THEN 'deleted' WHEN t.mtime_ns = i.mtime_ns AND t.size = i.size THEN 'unchanged' ELSE 'stale' END"


@query("J4_diff", f"WITH {C.SNAPSHOTS} SELECT coalesce(t.path, i.path) AS path, {DIFF} AS state FROM tree t FULL JOIN idx i ON t.path = i.path")
def j4(spark, d):
    return relate.diff(*C.snapshots(spark, d))


@query("J5_deleted", f"WITH {C.SNAPSHOTS} SELECT path FROM idx WHERE path NOT IN (SELECT path FROM tree)")
def j5(spark, d):
    tree, index = C.snapshots(spark, d)
    return index.join(tree, "path", "left_anti").select("path")


@query("F9_stale", f"WITH {C.SNAPSHOTS} SELECT t.path FROM tree t LEFT JOIN idx i ON t.path = i.path WHERE {DIFF} IN ('new', 'stale')")
def f9(spark, d):
    return relate.diff(*C.snapshots(spark, d)).where("state in ('new', 'stale')").select("path")


@query("J6_nearest_def", f"WITH {C.SOURCE_SYMBOLS}, cand AS (SELECT file_path, name, CAST(start_line + start_line % 4 - 2 AS INT) AS match_line, CAST(start_line AS INT) AS ord FROM symbols) SELECT s.file_path, s.name, start_line, arg_min(match_line, (abs(match_line - start_line), ord, match_line)) AS match_line FROM symbols s JOIN cand c ON s.file_path = c.file_path AND s.name = c.name AND abs(match_line - start_line) <= 1 GROUP BY ALL")
def j6(spark, d):
    symbols = _src(spark, d)[1]
    return relate.nearest_definition(symbols, symbols.select("file_path", "name", (F.col("start_line") + F.col("start_line") % 4 - 2).alias("match_line"), F.col("start_line").alias("ord")))


# --- lookups


@query("F1_name_exact", f"WITH {C.SOURCE_SYMBOLS} SELECT file_path, name, start_line, end_line FROM symbols WHERE name = 'Item7'")
def f1(spark, d):
    return search.by_name(_src(spark, d)[1], " Item7 ").select("file_path", "name", "start_line", "end_line")


@query("F2_name_contains", f"WITH {C.SOURCE_SYMBOLS} SELECT file_path, name, start_line FROM symbols WHERE name ILIKE '%tem77%'")
def f2(spark, d):
    return search.by_name(_src(spark, d)[1], "TEM77", "contains").select("file_path", "name", "start_line")


@query("F4_dir_prefix", f"WITH {C.SOURCE_SYMBOLS} SELECT file_path, name, start_line FROM symbols WHERE file_path LIKE 'src/n3/%'")
def f4(spark, d):
    return _src(spark, d)[1].where(S.under_dir(F.col("file_path"), " /SRC/n3/")).select("file_path", "name", "start_line")


@query("F6_callers_dir", f"WITH {C.SOURCE_SYMBOLS} SELECT file_path, callee_name, line, col, enclosing_name FROM calls WHERE callee_name = 'Price1' AND file_path LIKE 'src/n5/%' ORDER BY file_path, line, col LIMIT 20")
def f6(spark, d):
    return search.find_callers(_src(spark, d)[2], "Price1", "src/n5").select("file_path", "callee_name", "line", "col", "enclosing_name")


@query("F7_by_id", f"WITH {C.TEXTS} SELECT name, file_path, kind FROM txt WHERE doc_id = 17")
def f7(spark, d):
    t = C.texts(spark, d)
    key = t.where("doc_id = 17").select(S.parse_symbol_id(S.symbol_id(*map(F.col, ("file_path", "kind", "name", "start_line")))).alias("p")).select("p.*")
    return t.join(key, ["file_path", "kind", "name", "start_line"], "left_semi").select("name", "file_path", "kind")


@query("F8_outline", f"WITH {C.SOURCE_SYMBOLS}, f AS (SELECT min(file_path) AS p FROM symbols) SELECT file_path||'#'||kind||'#'||name||'#'||start_line AS symbol_id, name, kind, scope, start_line, end_line FROM symbols, f WHERE file_path = p")
def f8(spark, d):
    every = C.source_lines(spark, d)
    first = extract.marked_lines(every).where("def is not null").agg(F.min("file_path").alias("p"))
    own = every.join(F.broadcast(first), F.col("file_path") == F.col("p"), "left_semi")  # a single row; only its lines are extracted
    symbols = extract.symbols_with_ends(own)
    return symbols.select(S.symbol_id(*map(F.col, search.KEY)).alias("symbol_id"), "name", "kind", "scope", "start_line", "end_line")


@query("F3_like_literals", f"WITH {C.TEXTS} SELECT doc_id FROM txt WHERE scope LIKE '%\\_%' ESCAPE '\\' OR scope LIKE '%\\%%' ESCAPE '\\'")
def f3(spark, d):
    return C.texts(spark, d).where(S.contains_folded(F.col("scope"), "_") | S.contains_folded(F.col("scope"), "%")).select("doc_id")


@query("F5_dir_trimmed", f"WITH {C.SOURCE_SYMBOLS} SELECT file_path, name, start_line FROM symbols WHERE file_path LIKE 'src/n3/%' OR file_path LIKE 'src/n7/%'")
def f5(spark, d):
    return _src(spark, d)[1].where(S.under_dir(F.col("file_path"), "  //src/n3/ ") | S.under_dir(F.col("file_path"), "Src/N7//")).select("file_path", "name", "start_line")


@query("F11_projection", f"WITH {C.SOURCE_SYMBOLS} SELECT file_path||'#'||kind||'#'||name||'#'||start_line AS symbol_id, name, kind, file_path, start_line, 'path' AS matched_in FROM symbols WHERE name = 'Item9' ORDER BY file_path, start_line LIMIT 7")
def f11(spark, d):
    found = search.search(_src(spark, d)[1], "Item9", 7, name_match="exact")
    return found.withColumn("matched_in", F.when(F.col("matched_in") == "symbol", "path").otherwise("?"))


@query("T2_by_name_top", f"WITH {C.SOURCE_SYMBOLS} SELECT file_path, name, start_line FROM symbols WHERE name ILIKE '%item1%' ORDER BY file_path, start_line, name LIMIT 25")
def t2(spark, d):
    return search.search_stored(_source_index(spark, d), " item1 ", 25, name_match="contains").select("file_path", "name", "start_line")


@query("F10_like_and", f"WITH {C.TEXTS} SELECT doc_id FROM txt WHERE (name ILIKE '%oc1%' OR file_path ILIKE '%oc1%') AND (name ILIKE '%src3%' OR file_path ILIKE '%src3%')")
def f10a(spark, d):
    return search.like_search(C.texts(spark, d), "OC1 src3").select("doc_id")


@query("F10_like_or", f"WITH {C.TEXTS} SELECT doc_id FROM txt WHERE name ILIKE '%oc12%' OR file_path ILIKE '%oc12%' OR name ILIKE '%src3/%' OR file_path ILIKE '%src3/%'")
def f10o(spark, d):
    return search.like_search(C.texts(spark, d), "oc12 src3/", "or").select("doc_id")


# --- aggregates


@query("A1_counts", f"WITH {C.SOURCE_SYMBOLS} SELECT (SELECT count(DISTINCT file_path) FROM src_lines) AS n_files, (SELECT count(*) FROM symbols) AS n_symbols, (SELECT count(*) FROM sites) AS n_call_sites")
def a1(spark, d):
    every = C.source_lines(spark, d)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [every.agg(F.countDistinct("file_path").alias("n_files")), one(extract.symbols(every), "n_symbols"), one(extract.call_sites(every), "n_call_sites")]
    return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))  # single rows


@query("A2_definitions_under", f"WITH {C.SOURCE_SYMBOLS} SELECT count(*) AS n FROM symbols WHERE file_path LIKE 'src/n4/%'")
def a2(spark, d):
    return _src(spark, d)[1].where(S.under_dir(F.col("file_path"), "src/n4")).agg(F.count("*").alias("n"))


@query("A3_distinct_outgoing", f"WITH {C.SOURCE_SYMBOLS} SELECT count(*) AS n FROM (SELECT DISTINCT callee_name, file_path, line FROM calls WHERE file_path LIKE 'src/n4/%')")
def a3(spark, d):
    return search.outgoing(_src(spark, d)[2], "src/n4").agg(F.count("*").alias("n"))


@query("A4_outgoing", f"WITH {C.SOURCE_SYMBOLS} SELECT callee_name, file_path, line, min(col) AS col, min(enclosing_name) AS enclosing_name, min(enclosing_kind) AS enclosing_kind, min(enclosing_scope) AS enclosing_scope FROM calls WHERE file_path LIKE 'src/n4/%' GROUP BY 1, 2, 3")
def a4(spark, d):
    return search.outgoing(_src(spark, d)[2], "src/n4")


@query(
    "A7_map_directory",
    f"""WITH {C.SOURCE_SYMBOLS}, own AS (SELECT * FROM symbols WHERE file_path LIKE 'src/n4/%'), outg AS (SELECT callee_name, file_path, line, min(col) AS col FROM calls WHERE file_path LIKE 'src/n4/%' GROUP BY 1, 2, 3),
d AS (SELECT * FROM own ORDER BY file_path, start_line, name LIMIT 50), o AS (SELECT * FROM outg ORDER BY file_path, line, callee_name LIMIT 50)
SELECT 'src/n4' AS dir, (SELECT count(*) FROM own) AS n_definitions, (SELECT count(*) FROM outg) AS n_outgoing,
(SELECT string_agg(file_path||':'||start_line||':'||name, ',' ORDER BY file_path, start_line, name) FROM d) AS definitions, (SELECT string_agg(file_path||':'||line||':'||callee_name||':'||col, ',' ORDER BY file_path, line, callee_name) FROM o) AS outgoing""",
)
def a7(spark, d):
    _, symbols, calls = _src(spark, d)
    told = lambda c, *parts: F.array_join(F.transform(c, lambda s: F.concat_ws(":", *[s[p].cast("string") for p in parts])), ",").alias(c)
    return search.map_directory(symbols, calls, "src/n4").select("dir", "n_definitions", "n_outgoing", told("definitions", "file_path", "start_line", "name"), told("outgoing", "file_path", "line", "callee_name", "col"))


@query("A6_status", f"WITH {C.SOURCE_SYMBOLS} SELECT (SELECT count(DISTINCT file_path) FROM src_lines) AS n_files, (SELECT count(*) FROM symbols) AS n_symbols, (SELECT count(*) FROM sites) AS n_call_sites, 'regex' AS indexer")
def a6(spark, d):
    return _source_index(spark, d).status().select("n_files", "n_symbols", "n_call_sites", "indexer")


@query("J7_file_meta", f"WITH {C.SOURCE_SYMBOLS} SELECT l.file_path AS path, CAST(l.size AS BIGINT) AS size, s.n AS n_symbols, c.n AS n_calls FROM (SELECT file_path, sum(strlen(text) + 1) - 1 AS size FROM src_lines GROUP BY 1) l JOIN (SELECT file_path, count(*) AS n FROM symbols GROUP BY 1) s USING (file_path) JOIN (SELECT file_path, count(*) AS n FROM sites GROUP BY 1) c USING (file_path)")
def j7(spark, d):
    return _source_index(spark, d).read("files").select("path", "size", "n_symbols", "n_calls")


@query("A8_token_estimate", f"WITH {C.TEXTS} SELECT doc_id, CAST(ceil(strlen(scope) / 4.0) AS BIGINT) AS tokens FROM txt")
def a8(spark, d):
    return C.texts(spark, d).select("doc_id", lines.token_estimate(F.col("scope")).alias("tokens"))


@query("A9_metrics", f"WITH {C.SOURCE_SYMBOLS} SELECT (SELECT CAST(sum(strlen(text) + 1) AS BIGINT) FROM src_lines) AS source_bytes, (SELECT round(count(*) / count(DISTINCT file_path), 6) FROM symbols) AS symbols_per_file")
def a9(spark, d):
    every, symbols, _ = _src(spark, d)
    size = every.agg(F.sum(F.octet_length("text") + 1).cast("long").alias("source_bytes"))
    return size.join(F.broadcast(symbols.agg(F.round(F.count("*") / F.countDistinct("file_path"), 6).alias("symbols_per_file"))))  # single rows


# --- maintenance and output


CHANGED = "(SELECT min(file_path) FROM src_lines)"


@query("K1_replace", f"WITH {C.SOURCE_SYMBOLS}, o AS (SELECT * FROM symbols WHERE file_path <> {CHANGED}) SELECT file_path, name, scope, start_line, end_line FROM o UNION ALL SELECT {CHANGED}, 'Again', 'anew', 2, 4")
def k1(spark, d):
    """One file indexed again, calls and postings with it; its bucket alone is written."""
    own = _source_index(spark, d, "replaced")
    path = own.read("files").agg(F.min("path")).first()[0]
    text = "// anew\nfunc Again(q int) {\n\tcall(q)\n}\n"
    CodeIndex(spark, own.path).apply(spark.createDataFrame([(path, 1, len(text), text)], "path string, mtime_ns long, size long, text string"))
    return own.read("symbols").select("file_path", "name", "scope", "start_line", "end_line")


@query("K2_remove", f"WITH {C.SOURCE_SYMBOLS} SELECT file_path, name, start_line FROM symbols WHERE file_path NOT LIKE 'src/n1/%'")
def k2(spark, d):
    old = _src(spark, d)[1].select("file_path", "name", "start_line")
    return relate.remove_files(old, old.where("file_path like 'src/n1/%'"))


@query("K6_group_symbols", f"WITH {C.SOURCE_SYMBOLS} SELECT file_path, count(*) AS n, string_agg(name, ',' ORDER BY start_line) AS names FROM symbols GROUP BY 1")
def k6(spark, d):
    per = _src(spark, d)[1].groupBy("file_path").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("start_line", "name"))).alias("s"))
    return per.select("file_path", "n", F.array_join("s.name", ",").alias("names"))


@query("K9_tsv", f"WITH {C.TEXTS} SELECT file_path||chr(9)||start_line||chr(9)||kind||chr(9)||name AS line FROM txt")
def k9(spark, d):
    return C.texts(spark, d).select(F.concat_ws("\t", "file_path", F.col("start_line").cast("string"), "kind", "name").alias("line"))


REPLACED = f"WITH {C.TEXTS}, now AS (SELECT name, file_path, kind, CASE WHEN doc_id % 400 = 17 THEN 'zebra zebra quagga' ELSE scope END AS scope FROM txt WHERE doc_id % 400 <> 19), tok AS (SELECT name, list_concat(list_concat(regexp_extract_all(lower(strip_accents(name)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+'), regexp_extract_all(lower(strip_accents(file_path)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')), list_concat(regexp_extract_all(lower(strip_accents(kind)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+'), regexp_extract_all(lower(strip_accents(scope)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+'))) AS t FROM now), w AS (SELECT name, unnest(t) AS token FROM tok)"


@query("K4_postings_kept", REPLACED + " SELECT token, count(DISTINCT name) AS df, count(*) AS tf FROM w GROUP BY 1")
def k4(spark, d):
    """Postings after some documents were replaced and some removed: what the live ones count."""
    symbols = _text_symbols(spark, d)
    store = _stored(spark, d, "postings", lambda s: s.apply(_meta_of(symbols), symbols, _no_calls(spark)))
    number = F.substring("name", 4, 20).cast("long") % 400
    new = symbols.where(number == 17).withColumn("scope", F.lit("zebra zebra quagga"))
    store.apply(_meta_of(new), new, _no_calls(spark), symbols.where(number == 19).select(F.col("file_path").alias("path")))
    return store.live_postings().groupBy("token").agg(F.countDistinct("name").alias("df"), F.sum(F.size("positions")).cast("long").alias("tf"))


@query("K3_meta", "SELECT * FROM (VALUES ('a', '1'), ('b', '3'), ('c', NULL)) v(key, value)")
def k3(spark, d):
    store = Snapshots(spark, work_folder(spark, "meta"))
    none = _text_symbols(spark, d).limit(0)
    store.apply(_meta_of(none), none, _no_calls(spark), a="1", b="2")
    store.set_meta(b="3")
    return spark.createDataFrame([(k, store.get_meta(k)) for k in "abc"], "key string, value string")


@query("K5_lifecycle", "SELECT false AS before, true AS made, false AS after")
def k5(spark, d):
    store, none = Snapshots(spark, work_folder(spark, "life")), _text_symbols(spark, d).limit(0)
    before = store.exists()
    store.apply(_meta_of(none), none, _no_calls(spark))
    made = store.exists()
    store.destroy()
    return spark.createDataFrame([(before, made, store.exists())], "before boolean, made boolean, after boolean")


@query("K7_size", "SELECT true AS holds_bytes, true AS less_than_three_texts FROM (SELECT 1)")
def k7(spark, d):
    """The index's bytes: some, and under three times those of its texts."""
    size = _texts_index(spark, d).size_bytes()
    total = C.texts(spark, d).agg(F.sum(F.octet_length("scope")).alias("n"))
    return total.select(F.lit(size > 0).alias("holds_bytes"), (F.lit(size) < 3 * F.col("n")).alias("less_than_three_texts"))


@query("K8_json", "SELECT CAST(to_json(list({'n_nationkey': n_nationkey, 'n_name': n_name} ORDER BY n_nationkey)) AS VARCHAR) AS json FROM nation UNION ALL SELECT '[]'")
def k8(spark, d):
    nation = C.table(spark, d, "nation").select("n_nationkey", "n_name")
    return to_json(nation, ["n_nationkey"]).unionByName(to_json(nation.limit(0), ["n_nationkey"]))


# --- change feed


@query("R1_classify", f"WITH {C.FEED} SELECT path, op, ts, action FROM acts")
def r1(spark, d):
    return feed.classified(C.feed(spark, d))


SESSIONS = ", e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM acts), s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)"


@query("R2_debounce", f"WITH {C.FEED}{SESSIONS} SELECT path, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events, arg_max(action, (ts, action)) AS action FROM s GROUP BY path, g")
def r2(spark, d):
    return feed.debounced(feed.classified(C.feed(spark, d)), "6 hours")


@query(
    "R3_apply",
    f"""WITH {C.FEED}, last AS (SELECT path, arg_max(action, (ts, action)) AS action FROM acts GROUP BY path), users AS (SELECT DISTINCT 'u'||user_id AS path FROM events)
SELECT u.path||'.go' AS file_path, CASE WHEN action = 'sync' THEN 'New' ELSE 'Old' END||substr(u.path, 2) AS name FROM users u LEFT JOIN last USING (path) WHERE coalesce(action, '') <> 'remove'""",
)
def r3a(spark, d):
    """An index of a file for each user, to which one batch of the feed's last actions is applied."""
    events = C.feed(spark, d)
    file = lambda df, name: df.select(F.concat("path", F.lit(".go")).alias("path"), F.lit(0).cast("long").alias("mtime_ns"), F.lit(1).cast("long").alias("size"), F.concat(F.lit(f"func {name}"), F.substring("path", 2, 20), F.lit("() {}")).alias("text"))
    index = CodeIndex(spark, work_folder(spark, "applied"))
    index.apply(file(events.select("path").distinct(), "Old"))
    last = feed.final_state(feed.classified(events))
    index.apply(file(last.where("action = 'sync'"), "New"), last.where("action = 'remove'").select(F.concat("path", F.lit(".go")).alias("path")))
    return index.symbols.select("file_path", "name")


@query("R3_final_state", f"WITH {C.FEED} SELECT path, arg_max(action, (ts, action)) AS action FROM acts GROUP BY path")
def r3(spark, d):
    return feed.final_state(feed.classified(C.feed(spark, d)))


@query("R4_reconcile_flag", f"WITH {C.FEED} SELECT count(*) > 0 AS reconcile_needed, CAST(coalesce(sum(CASE WHEN action = 'reconcile' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_errors FROM acts WHERE action = 'reconcile'")
def r4(spark, d):
    errors = feed.classified(C.feed(spark, d)).where("action = 'reconcile'")
    return errors.agg((F.count("*") > 0).alias("reconcile_needed"), F.count("*").alias("n_errors"))


# --- readers


@query("X12_read_lines", f"WITH {C.TEXTS}, {LINES} SELECT file_path, string_agg(line||chr(9)||text, chr(10) ORDER BY line) AS content FROM ln WHERE line BETWEEN 2 AND 4 GROUP BY 1 UNION ALL SELECT file_path, '' FROM ln GROUP BY 1 HAVING max(line) < 2")
def x12(spark, d):
    return lines.read_lines(C.files(spark, d), 2, 4)


HEX = "hx AS (SELECT doc_id, file_path, regexp_extract_all(to_hex(encode(scope)), '..') AS h FROM txt)"


def _bytes_sql(start: int, end: int) -> str:
    """Hex of the numbered lines of a byte range; h are the text's bytes."""
    part = f"string_split(array_to_string(list_transform(h[{start + 1}:{end}], lambda x: CASE WHEN x = '0A' THEN '|' ELSE x END), ''), '|')"
    kept = f"(CASE WHEN h[least({end}, len(h))] = '0A' THEN list_slice({part}, 1, len({part}) - 1) ELSE {part} END)"
    first = f"(1 + len(list_filter(h[1:{start}], lambda x: x = '0A')))"
    return f"CASE WHEN len(h) <= {start} THEN '' ELSE array_to_string(list_transform({kept}, lambda x, i: to_hex(encode(CAST({first} + i - 1 AS VARCHAR)||chr(9)))||x), '0A') END"


@query("X13_read_bytes", f"WITH {C.TEXTS}, {HEX} SELECT file_path, md5({_bytes_sql(10, 900)}) AS digest FROM hx")
def x13(spark, d):
    return lines.read_bytes(C.files(spark, d), 10, 900).select("file_path", F.md5(F.hex(F.col("content").cast("binary")).cast("binary")).alias("digest"))


@query("X16_line_at_byte", f"WITH {C.TEXTS} SELECT file_path, CAST(len(list_filter(list_slice(regexp_extract_all(to_hex(encode(scope)), '..'), 1, 300), lambda x: x = '0A')) + 1 AS INT) AS line FROM txt")
def x16(spark, d):
    return C.files(spark, d).select("file_path", lines.line_at_byte(F.col("text"), F.lit(300)).alias("line"))


@query("X14_read_symbol", f"WITH {C.SOURCE_SYMBOLS} SELECT s.file_path||'#'||kind||'#'||name||'#'||start_line AS symbol_id, string_agg(line||chr(9)||text, chr(10) ORDER BY line) AS content FROM symbols s JOIN src_lines l ON s.file_path = l.file_path AND line BETWEEN start_line AND end_line GROUP BY 1, s.file_path, start_line, kind, name")
def x14(spark, d):
    unset = {c: F.lit(None).cast("long") for c in ("start_byte", "end_byte")}
    return lines.read_symbols(_src(spark, d)[1].withColumns(unset), _tree_files(spark, d).withColumnRenamed("path", "file_path"))


@query("X14_read_symbol_bytes", f"WITH {C.TEXTS}, {HEX}, {LINES}, byline AS (SELECT file_path, string_agg(line||chr(9)||text, chr(10) ORDER BY line) AS content FROM ln WHERE line BETWEEN 1 AND 3 GROUP BY 1) SELECT file_path||'#k#n#1' AS symbol_id, CASE WHEN doc_id % 2 = 0 AND len(h) > 20 THEN md5({_bytes_sql(20, 300)}) ELSE md5(to_hex(encode(coalesce(content, '')))) END AS digest FROM hx LEFT JOIN byline USING (file_path)")
def x14b(spark, d):
    """Symbols with bytes, with bytes past the end of their file, and without."""
    even = F.col("doc_id") % 2 == 0
    symbols = C.texts(spark, d).select("file_path", F.lit("k").alias("kind"), F.lit("n").alias("name"), F.lit(1).alias("start_line"), F.lit(3).alias("end_line"), F.when(even, F.lit(20).cast("long")).alias("start_byte"), F.when(even, F.lit(300).cast("long")).otherwise(-1).alias("end_byte"))
    return lines.read_symbols(symbols, C.files(spark, d)).select("symbol_id", F.md5(F.hex(F.col("content").cast("binary")).cast("binary")).alias("digest"))


@query("X22_grep", f"WITH {C.TEXTS}, {LINES} SELECT file_path||':'||line||':'||text AS hit FROM ln WHERE contains(text, 'the') AND contains(text, 'idiot')")
def x22(spark, d):
    return lines.grep(lines.lines(C.files(spark, d)), ["the", "idiot"])


# --- sources read by grammar or tokens; the SQL says what the made-up files hold


def _grammar_files(spark, d):
    """A Python, a Go and a TypeScript file for each part; some of them broken."""
    n = F.col("p_partkey")
    p, broken = C.table(spark, d, "part"), n % 9 == 0
    put = lambda *parts: F.concat(*[F.lit(x) if x[:2] != "p_" else F.col(x).cast("string") for x in parts])
    py = F.concat(put("@wrap\ndef item", "p_partkey", "(q):\n    return obj.ship", "p_size", "(price(q))\n"), F.when(broken, "def broken(:\n").otherwise(""))
    go = F.concat(put("package x\n\nfunc (s *S) Item", "p_partkey", "(q int) {\n\tif (q > 0) {\n\t\ts.ship", "p_size", "(price(q), \"no(\")\n\t}\n\ttype inner struct {\n\t}\n}\n"), F.when(broken, "func Open() {\n").otherwise(""))
    ts = F.concat(put("export class Item", "p_partkey", " {\n  run(q: number): void {\n    this.ship", "p_size", "(`${price(q)} no(`);\n  }\n}\n"), F.when(broken, "f(]\n").otherwise(""))
    each = F.explode(F.array(*[F.struct(F.concat(F.lit("lib/p"), n, F.lit(end)).alias("file_path"), text.alias("text")) for end, text in ((".py", py), (".go", go), (".ts", ts))]))
    return p.select(each.alias("f")).select("f.*")


@query(
    "X17_check",
    """SELECT 'lib/p'||p_partkey||'.py' AS file_path, CAST(4 AS INT) AS line, CAST(12 AS INT) AS col, 'invalid syntax' AS message FROM part WHERE p_partkey % 9 = 0
UNION ALL SELECT 'lib/p'||p_partkey||'.go', 11, 1, 'missing }' FROM part WHERE p_partkey % 9 = 0
UNION ALL SELECT 'lib/p'||p_partkey||'.ts', 6, 3, ']' FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT 'lib/p'||p_partkey||'.ts', 7, 1, 'missing )' FROM part WHERE p_partkey % 9 = 0""",
)
def x17(spark, d):
    return syntax.check(_grammar_files(spark, d))


@query(
    "X18_definitions",
    """SELECT 'lib/p'||p_partkey||'.py' AS file_path, 'item'||p_partkey AS name, 'function' AS kind, CAST(2 AS INT) AS match_line, CAST(1 AS INT) AS start_line, CAST(3 AS INT) AS end_line, CAST(0 AS BIGINT) AS start_byte, CAST(strlen('@wrap'||chr(10)||'def item'||p_partkey||'(q):'||chr(10)||'    return obj.ship'||p_size||'(price(q))') AS BIGINT) AS end_byte FROM part WHERE p_partkey % 9 <> 0
UNION ALL SELECT 'lib/p'||p_partkey||'.go', 'Item'||p_partkey, 'function', 3, 3, 9, 11, 11 + strlen('func (s *S) Item'||p_partkey||'(q int) {|_if (q > 0) {|__s.ship'||p_size||'(price(q), "no(")|_}|_type inner struct {|_}|}') FROM part
UNION ALL SELECT 'lib/p'||p_partkey||'.go', 'inner', 'type', 7, 7, 8, 11 + strlen('func (s *S) Item'||p_partkey||'(q int) {|_if (q > 0) {|__s.ship'||p_size||'(price(q), "no(")|_}|_type '), 11 + strlen('func (s *S) Item'||p_partkey||'(q int) {|_if (q > 0) {|__s.ship'||p_size||'(price(q), "no(")|_}|_type inner struct {|_}') FROM part
UNION ALL SELECT 'lib/p'||p_partkey||'.go', 'Open', 'function', 10, 10, 10, 11 + strlen('func (s *S) Item'||p_partkey||'(q int) {|_if (q > 0) {|__s.ship'||p_size||'(price(q), "no(")|_}|_type inner struct {|_}|}|'), 11 + strlen('func (s *S) Item'||p_partkey||'(q int) {|_if (q > 0) {|__s.ship'||p_size||'(price(q), "no(")|_}|_type inner struct {|_}|}|func Open() {') FROM part WHERE p_partkey % 9 = 0
UNION ALL SELECT 'lib/p'||p_partkey||'.ts', 'Item'||p_partkey, 'class', 1, 1, 5, 7, strlen('export class Item'||p_partkey||' {|  run(q: number): void {|    this.ship'||p_size||'(`${price(q)} no(`);|  }|}') FROM part""",
)
def x18(spark, d):
    return syntax.definitions(_grammar_files(spark, d)).drop("ord")


@query(
    "X19_calls",
    """SELECT 'lib/p'||p_partkey||'.py' AS file_path, 'ship'||p_size AS callee_name, CAST(3 AS INT) AS line, CAST(16 AS INT) AS col FROM part WHERE p_partkey % 9 <> 0 UNION ALL SELECT 'lib/p'||p_partkey||'.py', 'price', 3, CAST(21 + strlen(CAST(p_size AS VARCHAR)) AS INT) FROM part WHERE p_partkey % 9 <> 0
UNION ALL SELECT 'lib/p'||p_partkey||'.go', 'ship'||p_size, 5, 5 FROM part UNION ALL SELECT 'lib/p'||p_partkey||'.go', 'price', 5, CAST(10 + strlen(CAST(p_size AS VARCHAR)) AS INT) FROM part
UNION ALL SELECT 'lib/p'||p_partkey||'.ts', 'ship'||p_size, 3, 10 FROM part UNION ALL SELECT 'lib/p'||p_partkey||'.ts', 'price', 3, CAST(18 + strlen(CAST(p_size AS VARCHAR)) AS INT) FROM part UNION ALL SELECT 'lib/p'||p_partkey||'.ts', 'f', 6, 1 FROM part WHERE p_partkey % 9 = 0""",
)
def x19(spark, d):
    return syntax.calls(_grammar_files(spark, d))


@query(
    "X18_refined_symbols",
    "SELECT 'lib/p'||p_partkey||'.go' AS file_path, CASE k WHEN 0 THEN 'Item'||p_partkey WHEN 1 THEN 'inner' ELSE 'Open' END AS name, CAST([3, 7, 10][k + 1] AS INT) AS start_line, CAST([9, 8, 10][k + 1] AS INT) AS end_line FROM part, (VALUES (0), (1), (2)) v(k) WHERE k < 2 OR p_partkey % 9 = 0",
)
def x18r(spark, d):
    """Symbols by lines with the bounds of their definitions: a nested type ends before its function does."""
    files = _grammar_files(spark, d).where("file_path like '%.go'")
    symbols = extract.symbols_with_ends(lines.lines(files))
    return syntax.refined(symbols, syntax.definitions(files)).select("file_path", "name", "start_line", "end_line")
