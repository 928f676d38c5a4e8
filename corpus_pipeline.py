"""A cleaning pipeline over the documents table: language, lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all but the
last return the columns of the documents table. ``run`` writes every stage as Parquet in the shared folder and reads
it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import decontamination, language_crf, line_dedup, near_dedup, packing
from spanveil.llm.queries import vocabulary
from spanveil.llm.shared import as_table

#: Ids that a stage drops are broadcast up to this many rows (16 MB); beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not among ``ids``."""
    ids = as_table(ids.select("doc_id").distinct(), name)
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_anti").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts, texts without a letter, and texts in no language that the labelled rows teach."""
    return language_crf.in_learned_language(docs)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier line is alike to, and documents of which nothing is left by that."""
    kept = line_dedup.dedup_lines(docs).where("n_removed = 0 or text rlike '\\\\S'")
    length = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return kept.withColumns(length).select(*docs.columns)


def near_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates (five-word shingles, similarity 0.8)."""
    groups = near_dedup.near_duplicates(docs, words=5, num=80, den=100)
    return _without(docs, groups.where("not kept"), "repeats")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return _without(docs, decontamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "leaks")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens; one row per piece."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_repeats),
    ("near_dedup", near_repeats),
    ("decontamination", benchmark_leaks),
    ("packing", pack),
]

#: SQL cannot express the fitted language stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = as_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
