"""The corpus pipeline: stages that each apply one operator to all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrain.llm import decontaminate, linededup, minhash, packing, sitequality
from lexigrain.llm.queries import bound_batches, table, tokenizer_definition
from lexigrain.storage import StoredTable, temporary_tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are neither of low quality nor toxic by the posterior of their site and text."""
    return sitequality.SiteQuality(docs, table(spark, sf_dir, "labels")).judge(docs, keep_only=True)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines that stand earlier; documents that lose every line go."""
    bound_batches(spark)
    left = linededup.dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies."""
    bound_batches(spark)
    return minhash.keep_one_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2,048 ids: where each piece of a document stands."""
    bound_batches(spark)
    return packing.pack_documents(docs, tokenizer_definition())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", judge_quality),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("best_fit_packing", pack),
]

#: Classifier, sketches and token ids are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next stage.

    What a stage stored on its way, and the result before its own, is dropped once its own is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary_tables():
            result = StoredTable(stage(spark, docs, sf_dir), name).keep()
        if before is not None:
            before.drop()
        docs, before = result.df, result
    return docs
