"""The registered queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrain.llm import (
    decontaminate,
    hardnegatives,
    langid,
    licenses,
    linededup,
    minhash,
    packing,
    sitequality,
    spelling,
    syncmers,
    templates,
    topk,
    warc,
)


#: Rows that Spark hands to Python at once; batches of texts are then a few megabytes, not tens of them.
ROWS_PER_BATCH = 1_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's batch size if it is larger, as whole texts travel in these batches."""
    if not 0 < int(spark.conf.get(_BATCH_SETTING)) <= ROWS_PER_BATCH:
        spark.conf.set(_BATCH_SETTING, str(ROWS_PER_BATCH))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_definition() -> str:
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()


def op1_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


def op2_warc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, sf, "pages"))
    return records.select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "error"
    )


def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_found", ",").alias("base_labels"),
        F.array_join("found", ",").alias("labels"),
        "score",
    )


def op4_syncmer_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return syncmers.fingerprint_edits(table(spark, sf, "documents"))


def op5_html_templates(spark: SparkSession, sf: str) -> DataFrame:
    texts = templates.extract_main_text(table(spark, sf, "pages"))
    return texts.select(F.col("key").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), tokenizer_definition())


def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    # A document without an id has no remainder, so nothing is learned from it.
    learned_from = docs.where(~held_out)
    model = langid.learn_prototypes(learned_from, F.col("text"), F.col("lang"))
    keep = {"doc_id": F.col("doc_id"), "held_out": F.coalesce(held_out, F.lit(False))}
    return langid.predict_languages(docs, F.col("text"), keep, model)


def op6_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds."""
    return decontaminate.find_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the text that is left of it, '' if every line stands earlier."""
    docs = table(spark, sf, "documents")
    return linededup.dedup_lines(docs.select("doc_id", "text"), keep_emptied=True)


def op10_site_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its posteriors and whether it stays."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    quality = sitequality.SiteQuality(docs, table(spark, sf, "labels"))
    return quality.judge(docs, keep_only=False).select("doc_id", "low_quality", "toxic", "kept")


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf, "documents"), plant_every=97)


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine_hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_license_scan": op3_license_scan,
    "op4_syncmer_fingerprints": op4_syncmer_fingerprints,
    "op5_html_templates": op5_html_templates,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_language_id": op8_language_id,
    "op9_line_dedup": op9_line_dedup,
    "op10_site_quality": op10_site_quality,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_exact_top_k": op13_exact_top_k,
}
