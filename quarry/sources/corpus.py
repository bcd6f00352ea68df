"""Adapters that turn the driver's tables into files, lines, symbols and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source_items(spark: SparkSession, d: str) -> DataFrame:
    """(file_path, rn, four): a synthetic Go tree, a file for each order and four lines for its rn-th item."""
    t = lambda n: table(spark, d, n)
    rows = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    n = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    path = F.concat(F.lit("src/n"), "c_nationkey", F.lit("/o"), "o_orderkey", F.lit(".go"))
    note = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("var q"), "rn")).otherwise(F.concat(F.lit("// "), "p_name", F.lit(" "), "p_type"))
    four = F.array(
        note, F.concat(F.lit("func Item"), "l_partkey", F.lit("(q int) {")),
        F.concat(F.lit("\tShip"), "l_suppkey", F.lit("(Price"), "l_linenumber", F.lit("(q))")), F.lit("}"),
    )
    return rows.select(path.alias("file_path"), n.alias("rn"), "l_partkey", "l_suppkey", "l_linenumber", "p_name", "p_type").select("file_path", "rn", four.alias("four"))


def source_lines(spark: SparkSession, d: str) -> DataFrame:
    """(file_path, line, text) of the synthetic tree."""
    each = _source_items(spark, d).select("file_path", "rn", F.posexplode("four").alias("k", "text"))
    return each.select("file_path", ((F.col("rn") - 1) * 4 + F.col("k") + 1).alias("line"), "text")


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """(file_path, text) of the synthetic tree, from its items: the lines needn't be dealt one by one."""
    items = F.sort_array(F.collect_list(F.struct("rn", F.array_join("four", "\n").alias("text"))))
    return _source_items(spark, d).groupBy("file_path").agg(F.array_join(F.transform(items, lambda s: s["text"]), "\n").alias("text"))


SOURCE_LINES = """
src_rows AS (SELECT 'src/n'||c_nationkey||'/o'||o_orderkey||'.go' AS file_path,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn, l_partkey, l_suppkey, l_linenumber, p_name, p_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
src_lines AS (SELECT file_path, CAST((rn - 1) * 4 + k AS INT) AS line, CASE k
  WHEN 1 THEN CASE WHEN l_partkey % 5 = 0 THEN 'var q'||rn ELSE '// '||p_name||' '||p_type END
  WHEN 2 THEN 'func Item'||l_partkey||'(q int) {'
  WHEN 3 THEN chr(9)||'Ship'||l_suppkey||'(Price'||l_linenumber||'(q))' ELSE '}' END AS text
  FROM src_rows, (VALUES (1), (2), (3), (4)) v(k))"""

#: The same tree's symbols and calls, by the extraction rules spelled out in SQL.
SOURCE_SYMBOLS = (
    SOURCE_LINES
    + """,
src_marked AS (SELECT *, CASE WHEN trim(text) LIKE '//%' THEN trim(substr(trim(text), 3)) END AS note,
  CASE WHEN trim(text) NOT LIKE '//%' THEN nullif(regexp_extract(text, '^[\\t\\n\\f\\r ]*func[\\t\\n\\f\\r ]+(?:\\([^)]*\\)[\\t\\n\\f\\r ]*)?([0-9A-Za-z_]+)', 1), '') END AS name FROM src_lines),
src_groups AS (SELECT *, coalesce(sum(CASE WHEN name IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM src_marked),
src_scoped AS (SELECT *, coalesce(last_value(note IGNORE NULLS) OVER (PARTITION BY file_path, g ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS scope FROM src_groups),
src_counts AS (SELECT file_path, CAST(count(*) AS INT) AS n_lines FROM src_lines GROUP BY 1),
symbols AS (SELECT file_path, name, 'function' AS kind, scope, line AS start_line,
  CAST(greatest(line, coalesce(lead(line) OVER (PARTITION BY file_path ORDER BY line, name) - 1, n_lines)) AS INT) AS end_line
  FROM src_scoped JOIN src_counts USING (file_path) WHERE name IS NOT NULL),
raw_calls AS (SELECT file_path, line, unnest(regexp_extract_all(text, '([A-Za-z_][0-9A-Za-z_]*)[\\t\\n\\f\\r ]*\\(', 1)) AS callee_name, text FROM src_lines),
sites AS (SELECT file_path, callee_name, line, CAST(instr(text, callee_name||'(') AS INT) AS col FROM raw_calls),
calls AS (SELECT s.file_path, callee_name, line, col, coalesce(arg_min(name, (end_line - start_line, start_line)), '') AS enclosing_name,
  coalesce(arg_min(kind, (end_line - start_line, start_line)), '') AS enclosing_kind, coalesce(arg_min(scope, (end_line - start_line, start_line)), '') AS enclosing_scope
  FROM sites s LEFT JOIN symbols y ON s.file_path = y.file_path AND line BETWEEN start_line AND end_line GROUP BY ALL)"""
)


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as symbols: name, path, kind and their text as scope."""
    doc = table(spark, d, "documents")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt"))
    return doc.select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("name"), path.alias("file_path"), F.col("lang").alias("kind"), F.col("text").alias("scope"), F.lit(1).alias("start_line"))


TEXTS = "txt AS (SELECT doc_id, 'doc'||doc_id AS name, lang||'/'||source||'/'||doc_id||'.txt' AS file_path, lang AS kind, text AS scope, CAST(1 AS INT) AS start_line FROM documents)"


def files(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("file_path", F.col("scope").alias("text"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.concat(F.lit("page/"), "page_id", F.lit(".html")).alias("file_path"), F.col("html").alias("text"))


def intervals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Overlapping symbols and calls in them: from lineitem, a file for each order."""
    rows = table(spark, d, "lineitem").select(
        F.concat(F.lit("o"), "l_orderkey").alias("file_path"), F.concat_ws("_", F.lit("s"), "l_linenumber", "l_partkey", "l_suppkey").alias("name"), F.col("l_returnflag").alias("kind"),
        F.col("l_linestatus").alias("scope"), (F.col("l_linenumber") * 10).alias("start_line"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("end_line"),
    )
    return rows, rows.select("file_path", F.col("name").alias("callee_name"), (F.col("start_line") + 5).alias("line"), F.lit(1).alias("col"))


INTERVALS = """
isym AS (SELECT 'o'||l_orderkey AS file_path, 's_'||l_linenumber||'_'||l_partkey||'_'||l_suppkey AS name, l_returnflag AS kind, l_linestatus AS scope,
  l_linenumber * 10 AS start_line, CAST(l_linenumber * 10 + trunc(l_quantity) AS INT) AS end_line FROM lineitem),
icall AS (SELECT file_path, name AS callee_name, CAST(start_line + 5 AS INT) AS line, CAST(1 AS INT) AS col FROM isym)"""


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(tree, index) of files from orders: some new, some deleted, some resized."""
    o = table(spark, d, "orders")
    row = lambda extra: o.select(F.concat(F.lit("f"), "o_orderkey").alias("path"), (F.col("o_custkey") * 1000).alias("mtime_ns"), (F.floor("o_totalprice") + extra).alias("size"), "o_orderkey")
    tree = row(F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).where("o_orderkey % 7 <> 0").drop("o_orderkey")
    return tree, row(F.lit(0)).where("o_orderkey % 10 <> 0").drop("o_orderkey")


SNAPSHOTS = """
idx AS (SELECT 'f'||o_orderkey AS path, o_custkey * 1000 AS mtime_ns, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders WHERE o_orderkey % 10 <> 0),
tree AS (SELECT 'f'||o_orderkey AS path, o_custkey * 1000 AS mtime_ns, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS size FROM orders WHERE o_orderkey % 7 <> 0)"""


def feed(spark: SparkSession, d: str) -> DataFrame:
    """Events as a change feed (path, op, ts)."""
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type").isin("click", "view"), "write").when(F.col("event_type") == "purchase", "remove").when(F.col("event_type") == "error", "error").otherwise("chmod")
    return table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), op.alias("op"), "ts")


FEED = """
feed AS (SELECT 'u'||user_id AS path, CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type IN ('click', 'view') THEN 'write' WHEN event_type = 'purchase' THEN 'remove' WHEN event_type = 'error' THEN 'error' ELSE 'chmod' END AS op, ts FROM events),
acts AS (SELECT path, op, ts, CASE WHEN op = 'remove' THEN 'remove' WHEN op IN ('write', 'create') THEN 'sync' ELSE 'reconcile' END AS action FROM feed WHERE op <> 'chmod')"""


def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths with folders and endings of many kinds, from part."""
    p = table(spark, d, "part")
    folder = F.element_at(F.array(*map(F.lit, ("src/", "vendor/", "web/node_modules/x/", "lib/gen/", "docs/", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, (".go", ".PY", ".png", ".ts", "", ".md", ".test.js"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return p.select(F.concat(folder, F.lit("f"), "p_partkey", ending).alias("path"))


TREE_PATHS = """paths AS (SELECT (['src/','vendor/','web/node_modules/x/','lib/gen/','docs/',''])[CAST(p_partkey % 6 + 1 AS INT)]||'f'||p_partkey||(['.go','.PY','.png','.ts','','.md','.test.js'])[CAST(p_partkey % 7 + 1 AS INT)] AS path FROM part)"""
