"""A corpus pipeline: quality, near duplicates, benchmark passages, mixing, token files. Each stage reads what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svlake.llm import decontaminate, mixing, near_dedup, quality, token_files
from svlake.llm.common import materialise, scratch, table, with_key
from svlake.llm.queries import tokenizer_path


def _without(rows: DataFrame, key: str, rejected: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose number isn't rejected, with the given columns. ``rejected`` is one column of numbers."""
    gone = materialise(rejected.toDF(key).distinct(), "rejected")
    return rows.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in columns])


# Each row is judged by itself: rows without doc_id, and rows that share one, are told apart by a number of their own.
# Every stage returns an empty table for an empty one, and passes columns on as they are, whatever their names.


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws. Null and empty texts go. Labels of a repeated doc_id count for all its rows."""
    rows, key = with_key(docs)
    drawn = quality.importance_resample(rows, table(spark, sf_dir, "labels"), key=key)
    return _without(rows, key, drawn.where("not kept").select(key), docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates over 5-word shingles: that with the smallest doc_id, any of those that have it; rows
    without doc_id come last. Null and empty texts are no duplicates of each other and stay."""
    rows, key = with_key(docs)
    found = near_dedup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), words=5)
    return _without(rows, key, found.where("not kept").select("doc_id"), docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item. Null and empty texts hold none and stay; without items all stay."""
    rows, key = with_key(docs)
    found = decontaminate.leaks(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(rows, key, found.select("doc_id"), docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Those without words stay once; a null source is a source of its own."""
    return mixing.mixed_documents(docs, shards=16)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the documents in the token files: doc_id, start, n_tokens, ids_crc32. Null texts hold the end id alone; rows without
    doc_id come first, equal ids by text; repeated rows are documents of their own."""
    return token_files.token_digests(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]
ORACLE_SQL: str | None = None  # resampling, near duplicates and tokens are beyond SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
