"""Byte-pair encoding of text with a given merge list.

One encoder serves merge lists of every length and order: many words are merged at once on flat arrays (see
``functions/bpe``). The list travels to the tasks once, as arrays whose size is that of the vocabulary. Distinct
word types are encoded for statistics; documents are encoded in the pass that reads them, where only words not
met before are merged, so text is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexigrain.functions.bpe import WordEncoder
from lexigrain.functions.pretokens import encoding_pretokens
from lexigrain.functions.symbols import byte_alphabet
from lexigrain.functions.text import is_nonempty
from lexigrain.operators.model import PLAIN, BpeModel, Splitting
from lexigrain.operators.words import word_types
from lexigrain.storage import store


#: Words of whole documents that a task encodes at once.
WORDS_AT_ONCE = 1_000_000


def word_table(corpus: DataFrame, text: str = "text", splitting: Splitting = PLAIN) -> DataFrame:
    """Stored ``(word_id, word, freq)`` of a corpus, split the way encoding splits it."""
    words = word_types(corpus, text, splitting)
    return store(words.withColumn("word_id", F.monotonically_increasing_id()), "word-types")


def start_size(word: Column, splitting: Splitting = PLAIN) -> Column:
    """Symbols of a word before any merge: one per byte, one for a special token."""
    size = F.octet_length(word)
    return F.when(word.isin(list(splitting.specials)), 1).otherwise(size) if splitting.specials else size


def encode_words(words: DataFrame, models: dict[str, BpeModel]) -> DataFrame:
    """``(word_id, word, freq, model, ids, n_tokens)`` for every word and model, in one pass."""
    contents = {
        name: words.sparkSession.sparkContext.broadcast(model.content()) for name, model in models.items()
    }

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {name: WordEncoder(content.value) for name, content in contents.items()}
        for batch in batches:
            for name, encoder in encoders.items():
                merged = encoder.encode(batch.column(1))
                offsets = np.r_[0, np.cumsum(merged.sizes)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns,
                        pa.array([name] * batch.num_rows, pa.string()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(merged.ids, pa.int32())),
                        pa.array(merged.sizes, pa.int32()),
                    ],
                    names=["word_id", "word", "freq", "model", "ids", "n_tokens"],
                )

    return words.select("word_id", "word", "freq").mapInArrow(
        encode, "word_id bigint, word string, freq bigint, model string, ids array<int>, n_tokens int"
    )


def merge_events(words: DataFrame, model: BpeModel) -> DataFrame:
    """``(rank, n)``: merges made over the whole text, by effective rank.

    The effective rank of a merge is the highest rank applied so far in its word. Merges applied in
    rank order have their own rank. These sums answer for every prefix of the merge list at once.
    """
    content = words.sparkSession.sparkContext.broadcast(model.content())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(content.value)
        for batch in batches:
            events = encoder.encode(batch.column(0)).events
            if not events:
                continue
            word, rank, n = (np.concatenate(part) for part in zip(*events))
            freq = batch.column(1).to_numpy(zero_copy_only=False)
            used, place = np.unique(rank, return_inverse=True)
            sums = np.zeros(len(used), np.int64)
            np.add.at(sums, place, freq[word] * n)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums)], names=["rank", "n"])

    events = words.select("word", "freq").mapInArrow(count, "rank int, n bigint")
    return events.groupBy("rank").agg(F.sum("n").alias("n"))


def encode_word_types(words: DataFrame, model: BpeModel) -> DataFrame:
    """:func:`encode_words` for one model, without the model column."""
    return encode_words(words, {"model": model}).drop("model")


def token_ids(encoded: DataFrame) -> DataFrame:
    """``(word, ids)`` of encoded word types."""
    return encoded.select("word", "ids")


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``WORDS_AT_ONCE`` entries of a list column, of one row at least."""
    upto = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    row = 0
    while row < len(upto):
        before = upto[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(upto, before + WORDS_AT_ONCE, "right")))
        yield batch.slice(row, end - row)
        row = end


def _encode_documents(corpus: DataFrame, keys: list[str], model: BpeModel, text: str, result: str, run) -> DataFrame:
    """Keys and what ``run(encoder, word lists)`` gives for every nonempty document, in the pass that reads it."""
    content = corpus.sparkSession.sparkContext.broadcast(model.content())
    split = encoding_pretokens(F.col(text), model.splitting)
    rows = corpus.where(is_nonempty(F.col(text))).select(*keys, split.alias("_words"))
    name, kind = result.split(" ")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(content.value)
        for batch in batches:
            for part in _parts(batch, len(keys)):
                values = run(encoder, part.column(len(keys)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], values], names=[*keys, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(encode, f"{kinds}, {name} {kind}")


def document_token_ids(corpus: DataFrame, keys: list[str], model: BpeModel, text: str = "text") -> DataFrame:
    """``(keys, ids)`` of every nonempty document, ids in text order."""
    return _encode_documents(corpus, keys, model, text, "ids array<int>", lambda encoder, words: encoder.tokens(words))


def document_token_counts(corpus: DataFrame, keys: list[str], model: BpeModel, text: str = "text") -> DataFrame:
    """``(keys, n_tokens)`` per nonempty document; the ids are not made."""
    return _encode_documents(
        corpus, keys, model, text, "n_tokens bigint", lambda encoder, words: pa.array(encoder.token_counts(words), pa.int64())
    )


def decode_documents(ids: DataFrame, keys: list[str], model: BpeModel) -> DataFrame:
    """``(keys, text)`` back from token ids, within each row; special tokens are left out."""
    spelled = ids.sparkSession.sparkContext.broadcast(_spellings(model))
    names = [*keys, "text"]

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, sizes = spelled.value
        for batch in batches:
            for part in _parts(batch, len(keys)):
                lists = part.column(len(keys))
                token = lists.flatten().to_numpy(zero_copy_only=False)
                if len(token) and not (0 <= token.min() and token.max() < len(sizes) and sizes[token].min() >= 0):
                    raise KeyError("some token ids are not in the vocabulary")
                size = sizes[token]
                upto = np.append(0, np.cumsum(size))
                spelt = data[np.repeat(starts[token] - upto[:-1], size) + np.arange(upto[-1])]
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
                offsets = upto[np.append(0, ends)].astype(np.int32)
                buffers = [None, pa.py_buffer(offsets), pa.py_buffer(spelt)]
                texts = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, buffers)
                try:
                    texts = texts.cast(pa.string())
                except pa.ArrowInvalid:  # incomplete characters
                    texts = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=names)

    rows = ids.select(*keys, "ids")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(decode, f"{kinds}, text string")


def _spellings(model: BpeModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens one after the other, and by token id their place and number, -1 for no token."""
    back = {c: b for b, c in byte_alphabet().items()}
    specials = dict(model.specials)
    table = model.vocab.select("token_id", "token").toArrow()
    spelled = {
        i: b"" if token in specials else bytes(back[c] for c in token)
        for i, token in zip(table.column(0).to_pylist(), table.column(1).to_pylist())
    } | {i: b"" for i in specials.values()}
    sizes = np.full(max(spelled, default=-1) + 1, -1)
    sizes[list(spelled)] = [len(spelled[i]) for i in spelled]
    filled = np.maximum(sizes, 0)
    data = b"".join(spelled[i] for i in sorted(spelled))
    return np.frombuffer(data, np.uint8), np.cumsum(filled) - filled, sizes
