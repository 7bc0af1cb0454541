"""Corpus pipeline: five operators in a row, from documents to packed batches.

A row's fate depends on its own id and text, so null and clashing ids need no care; columns other than doc_id, text, source
and n_chars pass through all stages but the last unchanged. Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import small, stage, table
from weftline.llm.decontaminate import decontaminated
from weftline.llm.jaccard_join import jaccard_components
from weftline.llm.line_quality import clean_documents
from weftline.llm.packing import pack
from weftline.llm.quality_fm import keep_quality

#: Rows up to which a table of keys is broadcast.
MAX_KEYS = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines above their host's limit go, and documents that the rules reject; a null text is rejected, repeated rows all stay or go."""
    return clean_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go; null and empty texts have a score too, repeated rows all stay or go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, null last. Five words, similarity 0.8 or more.

    Rows are told apart by a 64-bit hash of id and text, so several texts of one id are documents of their own; of rows
    that repeat id and text one stays. Texts without words are in no group.
    """
    key = F.xxhash64("doc_id", "text")
    rows = docs.select(key.alias("key"), "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    groups = jaccard_components(docs.select(key.alias("doc_id"), "text"), k=5, percent=80).groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("group"))
    named = stage(rows.join(groups, "key"), "named")
    # a group's rows meet only in partial aggregates, so a large one is no task's load
    stays = F.min(F.struct(F.isnull("doc_id"), "doc_id", "key"))["key"]
    heads = stage(named.groupBy("group").agg(F.count("*").alias("size"), stays.alias("stays")).where("size > 1").drop("size"), "heads")
    gone = stage(named.join(small(heads, MAX_KEYS), "group").where("key <> stays").select("key"), "copies")
    again = stage(named.where("n > 1").select("key"), "repeats")

    left = docs.alias("d").join(small(gone, MAX_KEYS).alias("g"), F.xxhash64("d.doc_id", "d.text") == F.col("g.key"), "left_anti")
    if again.isEmpty():
        return left
    repeats, same = small(again, MAX_KEYS).alias("r"), F.xxhash64("d.doc_id", "d.text") == F.col("r.key")
    once = left.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeats, same, "left_anti").unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; null and short texts stay, repeated rows all stay or go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket and batch of each document that stayed; a null text has length 0, repeated rows are packed as often as they come."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier has no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir).select(docs.columns), name)
    return STAGES[-1][1](spark, docs, sf_dir)
