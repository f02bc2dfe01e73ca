"""Token totals and compression statistics of one or more models on the same text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lexigrain.functions.bpe import WordEncoder
from lexigrain.operators.encoding import encode_words
from lexigrain.operators.model import BpeModel
from lexigrain.operators.words import word_types_by_way


def token_totals(words: DataFrame, models: dict[str, BpeModel]) -> DataFrame:
    """``(name, token_count)``: all models scored on one word table in one pass.

    The models must cut text alike, namely as the word table was cut.
    """
    if not models:
        raise ValueError("name at least one tokenizer")
    if len({model.splitting for model in models.values()}) > 1:
        raise ValueError("these tokenizers cut text differently: use corpus_token_totals")
    return (
        encode_words(words, models)
        .groupBy(F.col("model").alias("name"))
        .agg(F.sum(F.col("freq") * F.col("n_tokens")).alias("token_count"))
    )


def corpus_token_totals(corpus: DataFrame, models: dict[str, BpeModel], text: str = "text") -> DataFrame:
    """:func:`token_totals` from the text itself, in one scan however many ways of cutting there are.

    A word is counted per way of cutting, and only the models that cut that way encode it.
    """
    if not models:
        raise ValueError("name at least one tokenizer")
    ways = list(dict.fromkeys(model.splitting for model in models.values()))
    contents = {
        name: (ways.index(model.splitting), corpus.sparkSession.sparkContext.broadcast(model.content()))
        for name, model in models.items()
    }

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {name: (way, WordEncoder(content.value)) for name, (way, content) in contents.items()}
        totals = dict.fromkeys(contents, 0)
        for batch in batches:
            for way in set(batch.column(0).to_pylist()):
                own = batch.filter(pc.equal(batch.column(0), way))
                freq = own.column(2).to_numpy(zero_copy_only=False)
                for name, (cut, encoder) in encoders.items():
                    if cut == way:
                        totals[name] += int((encoder.encode(own.column(1)).sizes * freq).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["name", "token_count"]
        )

    counted = word_types_by_way(corpus, ways, text).mapInArrow(encode, "name string, token_count bigint")
    return counted.groupBy("name").agg(F.sum("token_count").alias("token_count"))


def id_bits(vocab_size: Column) -> Column:
    """Bits of a fixed-width token id: ``max(1, ceil(log2(V)))`` without floating point."""
    return F.char_length(F.bin(vocab_size.cast("bigint") - 1))


def with_ratios(df: DataFrame, text_bytes: Column) -> DataFrame:
    """Adds ``bytes_per_token`` and ``tokens_per_byte``."""
    return df.withColumns(
        {
            "bytes_per_token": text_bytes.cast("double") / F.col("token_count"),
            "tokens_per_byte": F.col("token_count").cast("double") / text_bytes,
        }
    )


def with_fixed_width_ids(df: DataFrame, text_bytes: Column) -> DataFrame:
    """Adds the cost of storing the tokens as fixed-width ids; needs ``vocab_size``."""
    bits = F.col("token_count") * F.col("fixed_id_bits_per_token")
    return df.withColumn("fixed_id_bits_per_token", id_bits(F.col("vocab_size"))).withColumns(
        {
            "fixed_id_bits_per_byte": bits.cast("double") / text_bytes,
            "fixed_id_compression_ratio": (text_bytes * 8).cast("double") / bits,
        }
    )


def tokenizer_report(totals: DataFrame, models: dict[str, BpeModel], text_bytes: int) -> DataFrame:
    """One row per tokenizer with all compression statistics."""
    spark = totals.sparkSession
    sizes = spark.createDataFrame(
        [(name, model.path, model.vocab_size) for name, model in models.items()],
        "name string, tokenizer_path string, vocab_size int",
    )
    n_bytes = F.lit(text_bytes).cast("bigint")
    joined = totals.join(F.broadcast(sizes), "name")  # one row per tokenizer
    return with_fixed_width_ids(with_ratios(joined, n_bytes), n_bytes).select(
        "name",
        "tokenizer_path",
        "vocab_size",
        "token_count",
        "bytes_per_token",
        "tokens_per_byte",
        "fixed_id_bits_per_token",
        "fixed_id_bits_per_byte",
        "fixed_id_compression_ratio",
    )


def require_tokens(report: DataFrame, names: list[str]) -> None:
    """Every named tokenizer must have produced tokens."""
    scored = {r["name"] for r in report.where("token_count > 0").select("name").collect()}
    for name in names:
        if name not in scored:
            raise ValueError(f"no text was encoded by the tokenizer {name!r}")
