"""Cutting many texts into pre-tokens at once, on their flat UTF-8 bytes inside a task.

The pattern of ``functions/pretokens`` leaves no character out, so the pre-tokens of a text are its bytes between
neighbouring cuts, and where these lie follows from the classes of the characters next to them. The classes are
those of the Java expressions in the pattern, as Spark itself gives them for every code point.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession, functions as F

from lexigrain.functions.bpe import byte_column

# Tasks get these helpers by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Bytes of whole texts that are cut at once.
BYTES_AT_ONCE = 1_000_000
#: Parts of so many bytes whose words are counted at once.
PARTS_AT_ONCE = 64
_CODE_POINTS = 0x110000

_classes: dict[str, np.ndarray] = {}


def character_classes(spark: SparkSession) -> np.ndarray:
    """The class of every code point, asked of Spark once a session."""
    key = spark.sparkContext.applicationId
    if key not in _classes:
        character = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        kind = F.when(character.rlike(r"(?U)\s"), SPACE).when(character.rlike(r"\p{L}"), LETTER)
        kind = kind.when(character.rlike(r"\p{N}"), NUMBER).otherwise(OTHER)
        points = spark.range(0, _CODE_POINTS, 1, 8).where("id NOT BETWEEN 55296 AND 57343")  # no surrogates
        table = points.select("id", kind.cast("byte").alias("kind")).toArrow()
        classes = np.full(_CODE_POINTS, OTHER, np.uint8)
        classes[table.column(0).to_numpy()] = table.column(1).to_numpy()
        _classes[key] = classes
    return _classes[key]


def _byte_classes(data: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """For every byte of valid UTF-8 the class of its character."""
    kinds = np.append(classes[:128], np.zeros(128, np.uint8))[data]
    leads = np.flatnonzero(data >= 0xC0)
    first = data[leads]
    for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        at = leads[(first >= low) & (first < high)]
        if not len(at):
            continue
        point = data[at].astype(np.int32) - low
        for i in range(1, size):
            point = point << 6 | data[at + i] & 0x3F
        kind = classes[point]
        for i in range(size):
            kinds[at + i] = kind
    return kinds


def cut_texts(texts: pa.Array, classes: np.ndarray) -> pa.Array:
    """The pre-tokens of all texts, one after the other; the texts are valid and not null."""
    data, sizes = byte_column(texts)
    n = len(data)
    if not n:
        return pa.array([], pa.string())
    kinds = _byte_classes(data, classes)
    begins = np.zeros(n + 2, bool)  # of a text; what lies behind the last one counts as another
    begins[np.r_[0, np.cumsum(sizes)]] = begins[n + 1] = True
    cut = np.append(begins[:1], kinds[1:] != kinds[:-1])
    cut |= begins[:n]
    # The last white space before other characters stands apart; if it is a blank, they go with it.
    space = kinds == SPACE
    follows = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    follows = follows[~begins[follows]]
    last = follows - 1
    while len(inside := np.flatnonzero(data[last] & 0xC0 == 0x80)):  # bytes inside a character
        last[inside] -= 1
    cut[last] = True
    cut[follows[data[last] == ord(" ")]] = False
    # An apostrophe at a cut takes some letters with it and leaves the others.
    quotes = np.flatnonzero(cut & (data == ord("'")))
    one, two = (np.append(data, np.zeros(2, np.uint8))[quotes + i] for i in (1, 2))
    taken = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, 0)
    for a, b in (b"re", b"ve", b"ll"):
        taken[(one == a) & (two == b) & ~begins[quotes + 2]] = 2
    taken[begins[quotes + 1]] = 0
    quotes, taken = quotes[taken > 0], taken[taken > 0]
    cut[quotes + 1] = False
    ends = quotes + 1 + taken
    cut[ends[ends < n]] = True
    offsets = np.append(np.flatnonzero(cut), n).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))


def word_counts(texts: pa.Array, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(word, n)`` of the pre-tokens of texts that are valid and not null; words come again after many texts."""
    parts = text_parts(texts)
    for i in range(0, len(parts), PARTS_AT_ONCE):
        # Numbers are counted faster than texts, so words of few bytes are counted as such.
        keys, others = zip(*(_short_words(cut_texts(part, classes)) for part in parts[i : i + PARTS_AT_ONCE]))
        counts = pa.chunked_array(keys, pa.uint64()).value_counts()
        yield _batch(_spelled(counts.field(0).to_numpy()), counts.field(1))
        yield counted(pa.chunked_array(others, pa.string()))


def counted(words: pa.Array | pa.ChunkedArray) -> pa.RecordBatch:
    """``(word, n)`` of the distinct words."""
    counts = words.value_counts()
    return _batch(counts.field(0), counts.field(1))


def _batch(words: pa.Array, n: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([words, n], names=["word", "n"])


def _short_words(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words of up to eight bytes as numbers that have the first byte lowest, and the other words.

    A word that ends with a zero byte is one of the others, as its number would not show where it ends.
    """
    data, sizes = byte_column(words)
    ends = np.cumsum(sizes)
    short = sizes <= 8
    short[short] = data[ends[short] - 1] != 0
    padded = np.append(data, np.zeros(8, np.uint8))
    numbers = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from every place on
    size = sizes[short]
    unused = ((8 - size) * 8).astype(np.uint64)
    keys = numbers[ends[short] - size] << unused >> unused
    return pa.array(keys, pa.uint64()), words.filter(pa.array(~short))


def _spelled(keys: np.ndarray) -> pa.Array:
    """The words of the numbers that :func:`_short_words` gives."""
    data = keys.astype("<u8").view(np.uint8).reshape(-1, 8)
    sizes = 8 - np.argmax(data[:, ::-1] != 0, axis=1)
    used = data[np.arange(8) < sizes[:, None]]
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.StringArray.from_buffers(len(keys), pa.py_buffer(offsets), pa.py_buffer(used))


def text_parts(texts: pa.Array) -> list[pa.Array]:
    """The texts in parts of about ``BYTES_AT_ONCE``, of one text at least."""
    _, sizes = byte_column(texts)
    part = (np.cumsum(sizes) - sizes) // BYTES_AT_ONCE
    bounds = np.r_[np.flatnonzero(np.diff(part, prepend=-1)), len(texts)].tolist()
    return [texts.slice(a, b - a) for a, b in zip(bounds, bounds[1:])]
