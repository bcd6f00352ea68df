"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, packing, quality_rules, simhash, suffix_dedup
from quarry.llm.common import column, own_names, shared_folder
from quarry.llm.queries import BYTE_BPE
from quarry.session import small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with all their columns.

    Null or empty texts have no words, so they go. Rows with equal ids, null ids too, are judged
    by their own text and language. Without labels the base rule alone decides.
    """
    verdicts = quality_rules.quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    h, i, t = own_names(docs, "own_hash", "kept_id", "kept_hash")
    kept = verdicts.where("kept").select(F.col("doc_id").alias(i), F.col("th").alias(t)).distinct()
    rows = docs.withColumn(h, F.xxhash64("text", "lang"))
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(t)), "left_semi").drop(h)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the first by id; null ids come last.

    Null and empty texts are copies of each other. Of equal rows one stays.
    """
    small_batches(spark)
    return simhash.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur elsewhere; bytes of a letter cut in two go too.

    Every row stays; null texts become empty, n_chars follows the text.
    """
    small_batches(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    done = suffix_dedup.remove_repeated_bytes(docs, carry=others, whole_letters=True)
    out = {"text": F.col("kept").cast("string"), "doc_id": F.col("doc_id")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length(out["text"]).cast("long")
    return done.select(*[out[c].alias(c) if c in out else column(f"carried_{others.index(c)}").alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as it takes them, the last time perhaps a part of the words.

    Documents without words go. A null source is a source; equal rows are different documents.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's place in a sequence of 1024 tokens; a null text counts as empty, ids may be null or repeat."""
    small_batches(spark)
    return packing.pack(docs, BYTE_BPE)


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("suffix-array dedup", repeats), ("source mixing", mix), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again in the shared folder.

    What a stage has read is deleted once its own result is written.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            old = place(f"{folder}/{k - 1}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return docs
