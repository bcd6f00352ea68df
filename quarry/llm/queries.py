"""The registered queries of the operators, over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import embedding_dedup, mixing, packing, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup, token_counts, toxicity

#: The file of the public tokenizer; every machine has it at this place.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_substring_dedup, op2_embedding_near_dedup, op3_quality_classifier, op4_simhash_near_dedup, op5_token_counts, op6_suffix_array_dedup, op7_best_fit_packing, op8_quality_rules, op9_toxicity, op10_source_mixing)
    return {f.__name__: f for f in own}


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM w)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT win.doc_id, i, unnest(range(0, 13)) AS j FROM win JOIN least USING (k) WHERE win.doc_id > m)),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.pos) AS text FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos WHERE g.pos IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id"""

OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS far FROM v UNION SELECT node, b FROM reach JOIN links ON far = a),
low AS (SELECT node, min(far) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN low ON vec_id = node LEFT JOIN n ON vec_id = a"""


def _op8_sql() -> str:
    """The measures, the base rule and the certified cutoffs, these from the rules' own table."""
    cutoffs = ", ".join(f"('{name}', {k}, CAST({c} AS DOUBLE))" for name, _, own in quality_rules.RULES for k, c in enumerate(own))
    ratios = " UNION ALL ".join(f"SELECT doc_id, stratum, '{name}' AS rule, {ratio} AS ratio FROM d" for name, ratio, _ in quality_rules.RULES)
    strata = ", ".join(f"'{x}'" for x in quality_rules.STRATA)
    risk, delta = 0.02 / len(quality_rules.RULES), 0.05 / (len(quality_rules.RULES) * (len(quality_rules.STRATA) + 2))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({strata}) THEN lang ELSE 'other' END AS stratum FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w)),
often AS (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(0, 3)) AS j FROM g JOIN often USING (doc_id, g)) GROUP BY 1),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
d AS (SELECT l.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
CAST(len(l) AS BIGINT) AS n_lines, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM l JOIN w ON l.doc_id = w.doc_id LEFT JOIN rep ON l.doc_id = rep.doc_id),
r AS ({ratios}),
marks AS (SELECT doc_id, quality = 1 AS good FROM labels WHERE quality IN (0, 1)),
known AS (SELECT doc_id, stratum, good FROM d JOIN marks USING (doc_id) WHERE NOT base_failed),
size AS (SELECT stratum, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS m FROM known GROUP BY 1),
c (rule, step, cutoff) AS (VALUES {cutoffs}),
hits AS (SELECT known.stratum, rule, step, cutoff, count(*) FILTER (good AND ratio > cutoff) AS k, count(*) FILTER (NOT good AND ratio > cutoff) AS b FROM known JOIN r USING (doc_id) JOIN c USING (rule) GROUP BY ALL),
own AS (SELECT hits.*, n, m FROM hits JOIN size USING (stratum)),
pool AS (SELECT 'pool' AS stratum, rule, step, cutoff, sum(k) AS k, sum(b) AS b, sum(n) AS n, sum(m) AS m FROM own GROUP BY rule, step, cutoff),
tail AS (SELECT *, CASE WHEN k >= n * {risk} THEN 1.0 ELSE list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk})))) END AS p,
b / greatest(m, 1) - 10 * k / greatest(n, 1) AS gain FROM (SELECT * FROM own UNION ALL SELECT * FROM pool)),
seq AS (SELECT *, bool_and(p <= {delta}) OVER (PARTITION BY stratum, rule ORDER BY step) AS passed FROM tail),
mine AS (SELECT *, bool_or(passed) OVER (PARTITION BY stratum, rule) AS certifies FROM seq WHERE stratum <> 'pool'),
useful AS (SELECT stratum, rule, step, cutoff, CASE WHEN certifies THEN gain ELSE pool_gain END AS gain FROM mine JOIN (SELECT rule, step, passed AS pooled, gain AS pool_gain FROM seq WHERE stratum = 'pool') s USING (rule, step)
WHERE CASE WHEN certifies THEN passed ELSE pooled AND n > 0 AND k <= {risk} * n END),
cut AS (SELECT stratum, rule, arg_max(cutoff, (gain, -step)) AS cutoff FROM useful WHERE gain > 0 GROUP BY 1, 2),
bad AS (SELECT DISTINCT doc_id FROM r JOIN cut USING (stratum, rule) WHERE ratio > cut.cutoff)
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept FROM d LEFT JOIN bad ON d.doc_id = bad.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others have none: their hashes, tokens, models or byte windows are not in SQL's reach, or too slow in it."""
    return {"op1_substring_dedup": OP1_SQL, "op2_embedding_near_dedup": OP2_SQL, "op8_quality_rules": _op8_sql()}
