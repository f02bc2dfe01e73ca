"""Distinct pre-tokens ("word types") with their frequencies: the table every later step works on."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexigrain.functions.cutting import character_classes, counted, word_counts
from lexigrain.functions.pretokens import Splitting, encoding_pretokens, pretokens
from lexigrain.functions.text import is_nonempty


def word_types(corpus: DataFrame, text: str = "text", splitting: Splitting | None = None) -> DataFrame:
    """``(word, freq)`` over a corpus.

    The group-by combines on the map side, so a word that makes up a third of all occurrences still
    sends one row per map task. With a ``splitting`` special literals are words of their own.
    """
    rows = corpus.where(is_nonempty(F.col(text)))
    if splitting is None:
        return _counted_words(rows, F.col(text)).groupBy("word").agg(F.sum("n").alias("freq"))
    words = rows.select(F.explode(encoding_pretokens(F.col(text), splitting)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("freq"))


def _counted_words(rows: DataFrame, text: Column) -> DataFrame:
    """``(word, n)``: words of texts with their counts by part of a task.

    Valid texts are cut on their bytes. Others take the pattern itself, which reads them as Java does.
    """
    classes = rows.sparkSession.sparkContext.broadcast(character_classes(rows.sparkSession))
    valid = F.is_valid_utf8(text)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from word_counts(batch.column(0).drop_null(), classes.value)
            if batch.column(1).null_count < batch.num_rows:
                yield counted(batch.column(1).flatten())

    texts = rows.select(F.when(valid, text).alias("text"), F.when(~valid, pretokens(text)).alias("words"))
    return texts.mapInArrow(count, "word string, n bigint")


def _tagged(split: Column, number: int) -> Column:
    return F.transform(split, lambda w: F.struct(F.lit(number).alias("way"), w.alias("word")))


def word_types_by_way(corpus: DataFrame, ways: list[Splitting], text: str = "text") -> DataFrame:
    """``(way, word, freq)`` for every way of cutting, by its number in ``ways``, from one scan of the corpus."""
    split = [_tagged(encoding_pretokens(F.col(text), way), number) for number, way in enumerate(ways)]
    return (
        corpus.where(is_nonempty(F.col(text)))
        .select(F.inline(F.concat(*split)))
        .groupBy("way", "word")
        .agg(F.count("*").alias("freq"))
    )
