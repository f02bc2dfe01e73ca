"""The cached held-out slice: JSON lines with ``text`` and the order columns, and a metadata file beside it.

The texts of a cache lie in a folder with a name of its own; the metadata file names it and is put in place in one
step, last of all. So the metadata file always points to texts that are complete: whatever step a run stops at,
a reader finds the cache before it or the cache after it. Texts that no metadata file names are left-overs and are
not read; a later run writes texts of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrain.functions.text import is_nonempty
from lexigrain.operators.slicing import (
    OrderedCorpus,
    Position,
    check_budgets,
    require_bytes,
)
from lexigrain.sources.reports import read_json_file, write_summary
from lexigrain.storage import path_exists, remove, replace_file, require_new_path

# The format tag of the cache and the names of its files; so are the metadata's field names below.
CACHE_FORMAT = "jsonl-text-v1"
TEXT_NAME = "heldout.jsonl"
META_NAME = "heldout_meta.json"
TEXT_SCHEMA = "text string"
#: Field of a line that holds its order columns.
ORDER = "order"


def text_path(folder: str) -> str:
    """Where the texts of a cache lie that does not say so itself."""
    return f"{folder}/{TEXT_NAME}"


def meta_path(folder: str) -> str:
    return f"{folder}/{META_NAME}"


def _new_text_path(folder: str) -> str:
    return f"{folder}/heldout-{uuid.uuid4().hex}.jsonl"


def _texts_of(folder: str, metadata: dict) -> str:
    """The texts that the metadata names, beside the metadata wherever the folder is now."""
    named = metadata.get("text_path")
    return f"{folder}/{named.rstrip('/').rsplit('/', 1)[-1]}" if named else text_path(folder)


def write_texts(df: DataFrame, order_by: list[str], path: str, text: str = "text") -> None:
    """JSON lines in corpus order, each with its order columns; Spark's commit leaves ``_SUCCESS`` at the end."""
    require_new_path(df.sparkSession, path)
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    ordered.select(F.col(text).alias("text"), F.struct(*order_by).alias(ORDER)).write.json(path)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    metadata = read_json_file(spark, meta_path(folder)) if path_exists(spark, meta_path(folder)) else {}
    return spark.read.schema(TEXT_SCHEMA).json(_texts_of(folder, metadata))


def read_ordered_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Order columns and text of a cache that was written with them, in no particular order of rows."""
    metadata = read_json_file(spark, meta_path(folder))
    if "order_schema" not in metadata:
        raise ValueError(f"the cache in {folder} holds no order columns")
    schema = f"{ORDER} struct<{metadata['order_schema']}>, {TEXT_SCHEMA}"
    return spark.read.schema(schema).json(_texts_of(folder, metadata)).select(f"{ORDER}.*", "text")


def publish(spark: SparkSession, folder: str, metadata: dict) -> None:
    """Puts the metadata of complete texts in place."""
    staged = f"{meta_path(folder)}.{uuid.uuid4().hex}"
    write_summary(spark, metadata, staged)
    replace_file(spark, staged, meta_path(folder))


def is_cached(spark: SparkSession, folder: str) -> bool:
    """True for a finished cache, False for none; a part of one under the names of a whole one is an error."""
    meta = path_exists(spark, meta_path(folder))
    target = _texts_of(folder, read_json_file(spark, meta_path(folder)) if meta else {})
    texts = path_exists(spark, target)
    # A cache brought from elsewhere may be one plain file without a commit marker.
    whole = texts and (path_exists(spark, f"{target}/_SUCCESS") or not path_exists(spark, f"{target}/_temporary"))
    if whole and meta:
        return True
    if texts or meta:
        raise ValueError(f"the held-out cache in {folder} is incomplete")
    return False


def prepare_heldout(
    open_corpus,
    spark: SparkSession,
    folder: str,
    skip_bytes: int,
    eval_bytes: int,
    dataset: str = "",
    config: str | None = None,
    split: str = "train",
    text_column: str = "text",
) -> dict:
    """Reuse the cache in ``folder`` or fill it from ``open_corpus()`` (an OrderedCorpus)."""
    if is_cached(spark, folder):
        metadata = read_json_file(spark, meta_path(folder))
        return metadata if metadata.get("format") == CACHE_FORMAT else migrate(spark, folder, metadata)
    check_budgets(skip_bytes, eval_bytes)
    corpus: OrderedCorpus = open_corpus()
    start, skipped = Position(), None
    if skip_bytes:
        start, skipped = corpus.take(skip_bytes)[1], corpus.stats(skip_bytes)
        require_bytes(skipped, skip_bytes, "held-out slice")
    taken = corpus.take(eval_bytes, start)[0]
    used = corpus.stats(eval_bytes, start)
    require_bytes(used, eval_bytes, "evaluation size")
    target = _new_text_path(folder)
    write_texts(taken, corpus.order_by, target, corpus.text)
    order_schema = ", ".join(f"`{c}`: {taken.schema[c].dataType.simpleString()}" for c in corpus.order_by)
    metadata = {
        "format": CACHE_FORMAT,
        "dataset": dataset,
        "config": config,
        "split": split,
        "text_column": text_column,
        "skip_bytes_requested": skip_bytes,
        "skipped_utf8_bytes": skipped.bytes_used if skipped else 0,
        "skipped_documents": skipped.documents_used if skipped else 0,
        "eval_bytes_requested": eval_bytes,
        "cached_utf8_bytes": used.bytes_used,
        "cached_documents": used.documents_used,
        "text_path": target,
        "order_schema": order_schema,
    }
    publish(spark, folder, metadata)
    return metadata


def legacy_texts(lines: DataFrame) -> DataFrame:
    """``(text, ok)`` from lines that each hold one bare JSON string and nothing else."""
    # As the one element of an array a line can neither add fields nor further values.
    parsed = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), "array<string>", {"mode": "PERMISSIVE"})
    is_string = F.col("value").rlike(r'^\s*"(?:[^"\\]|\\.)*+"\s*$')
    return lines.select(
        F.get(parsed, F.lit(0)).alias("text"), (is_string & (F.size(parsed) == 1) & F.get(parsed, F.lit(0)).isNotNull()).alias("ok")
    )


def migrate(spark: SparkSession, folder: str, metadata: dict) -> dict:
    """Rewrite a legacy cache as JSON objects and update its format tag.

    The new texts are complete under their own name before the metadata that names them replaces the old one in a
    single step; the old texts are deleted last.
    """
    old, target = _texts_of(folder, metadata), _new_text_path(folder)
    texts = legacy_texts(spark.read.text(old))
    if not texts.where(~F.coalesce("ok", F.lit(False))).isEmpty():
        raise ValueError(f"a line in {old} is not a single JSON string, as a legacy cache holds")
    texts.select("text").write.json(target)
    metadata = {**metadata, "format": CACHE_FORMAT, "text_path": target}
    publish(spark, folder, metadata)
    remove(spark, old)
    return metadata


def open_heldout(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """Texts and metadata of a prepared cache."""
    metadata = read_json_file(spark, meta_path(folder)) if path_exists(spark, meta_path(folder)) else None
    if metadata is None or not path_exists(spark, _texts_of(folder, metadata)):
        raise ValueError(f"there is no held-out cache in {folder}")
    if metadata.get("format") != CACHE_FORMAT:
        raise ValueError(f"the cache in {folder} is of an older format: prepare it first")
    return read_texts(spark, folder).where(is_nonempty(F.col("text"))), metadata
