"""Merge events of words, kept per model, so that a curve over new text encodes only words not met before.

A word's events follow from the word and the merge list alone. They are stored once per model as
``(word, ranks, merges)`` and joined to whatever word counts a text has; words that are not stored yet are encoded
and appended as a further table. Tables are complete or ignored, so a crash costs the words of one call.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrain.functions.bpe import WordEncoder
from lexigrain.operators.model import BpeModel
from lexigrain.storage import list_names, path_exists

EVENTS = "word string, ranks array<int>, merges array<int>"


def word_events(words: DataFrame, model: BpeModel) -> DataFrame:
    """``(word, ranks, merges)``: how many merges of each effective rank encoding a word makes."""
    content = words.sparkSession.sparkContext.broadcast(model.content())

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(content.value)
        for batch in batches:
            events = encoder.encode(batch.column(0)).events
            word, rank, n = (np.concatenate(p) for p in zip(*events)) if events else (np.zeros(0, np.int64),) * 3
            order = np.lexsort((rank, word))
            offsets = pa.array(np.searchsorted(word[order], np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order], pa.int32())) for c in (rank, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["word", "ranks", "merges"])

    return words.select("word").mapInArrow(encode, EVENTS)


class EventStore:
    """The stored events of one model under ``folder``, which may serve several models."""

    def __init__(self, spark: SparkSession, folder: str, model: BpeModel):
        self.spark, self.model = spark, model
        rule = F.xxhash64("rank", "left_id", "right_id", "token_id").cast("decimal(20,0)")
        settings = (model.content()["start"].tobytes(), sorted(model.specials), model.whole_words)
        found = model.merges.agg(F.sum(rule).alias("rules"), F.count("*").alias("n")).first()
        name = uuid.uuid5(uuid.NAMESPACE_OID, f"{found['rules']} {found['n']} {settings}")
        self.folder = f"{folder}/{name.hex}"

    def stored(self) -> DataFrame:
        """All complete tables; words that two calls added at once stand there twice with equal events."""
        names = list_names(self.spark, self.folder) if path_exists(self.spark, self.folder) else []
        whole = [f"{self.folder}/{n}" for n in sorted(names) if path_exists(self.spark, f"{self.folder}/{n}/_SUCCESS")]
        if not whole:
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(*whole)

    def events(self, words: DataFrame) -> DataFrame:
        """``(rank, n)`` as ``encoding.merge_events`` gives it; encodes and stores the words that are new."""
        new = words.select("word").join(self.stored().select("word"), "word", "left_anti").distinct()
        word_events(new, self.model).write.parquet(f"{self.folder}/events-{uuid.uuid4().hex}")
        known = self.stored().dropDuplicates(["word"])
        return (
            words.join(known, "word")
            .select("freq", F.inline(F.arrays_zip("ranks", "merges")))
            .groupBy(F.col("ranks").alias("rank"))
            .agg(F.sum(F.col("freq") * F.col("merges")).alias("n"))
        )
