"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

An item of L words is found in a text if some stretch of it is within ``floor(EDIT_SHARE * L)`` word edits;
an item with fewer than ``MIN_ITEM_WORDS`` words only where all its words stand in a row.
Texts are searched in item-sized windows. A stretch so near to an item holds one of ``edits + 1`` equal
pieces of the item unchanged, so windows are laid where such a piece stands, in line with the item; this
loses nothing. Window and item are embedded by the same random walks (a walk repeats or passes a word by a
random bit of the word and step), which turn few edits into few differing places. A window goes on if in
any of ``WALKS * SAMPLES`` repetitions all ``BITS`` sampled places agree. What goes on is verified by the
exact edit distance between the item and the text around the window.

Items are held by the tasks in blocks of at most ``BLOCK_BYTES``; each further block is one more pass.

Words are runs of letters and digits, A-Z in lower case. Defined results: null and empty texts hold no item;
items without words are not searched; null item ids are searched and reported as null. Equal rows are searched
each and reported once. Empty tables give no matches. Other columns pass untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigrain.llm.hashing import byte_classes, hash_words, mix, row_groups, text_buffers

EDIT_SHARE = 0.2
#: Shorter items are searched without edits.
MIN_ITEM_WORDS = 8
WALKS, SAMPLES, BITS = 4, 8, 2
BLOCK_BYTES = 1 << 23
#: Windows embedded and verified at once.
WINDOWS = 1 << 13
#: Words of windows compared at once.
CELLS = 1 << 20
_WORDS = byte_classes(bytes(b for b in range(128) if not chr(b).isalnum()))
_FACTORS = mix(np.arange(1, 257, dtype=np.uint64), 23) | np.uint64(1)
_TABLE_BITS = 20
PAD = np.uint64(0)


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        total += words[k : len(total) + k] * _FACTORS[k % 256]
    return total


@dataclass
class Pieces:
    """The pieces of one length: sorted hashes, and per piece its item and place there."""

    size: int
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray


class ItemIndex:
    """A block of items, ready to be searched for."""

    def __init__(self, ids: list, texts: list[str], edit_share: float = EDIT_SHARE, min_words: int = MIN_ITEM_WORDS):
        data, offsets = text_buffers(pa.array(texts, pa.string()))
        words, bounds, _ = hash_words(data, offsets, _WORDS)
        keep = [k for k in range(len(ids)) if bounds[k + 1] > bounds[k]]
        self.ids = [ids[k] for k in keep]
        self.words = [words[bounds[k] : bounds[k + 1]] for k in keep]
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.where(self.length < min_words, 0, np.floor(self.length * edit_share + 1e-9)).astype(np.int64)
        sizes: dict[int, list[tuple[int, int, int]]] = {}
        for k, own in enumerate(self.words):
            size = int(self.length[k] // (self.edits[k] + 1))
            grams = _grams(own, size)
            for place in range(0, size * (int(self.edits[k]) + 1), size):
                sizes.setdefault(size, []).append((int(grams[place]), k, place))
        self.pieces = []
        for size, found in sorted(sizes.items()):
            found.sort()
            hashes = np.array([f[0] for f in found], np.uint64)
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[hashes >> np.uint64(64 - _TABLE_BITS)] = True
            rest = np.array([f[1:] for f in found], np.int64)
            self.pieces.append(Pieces(size, hashes, rest[:, 0], rest[:, 1], table))
        # All items one after the other, so that a long one costs no more than its own words.
        self.flat = np.concatenate(self.words) if keep else np.zeros(0, np.uint64)
        self.first = np.cumsum(self.length) - self.length
        # Sampled steps of each walk, as shares of the walk's length of three items.
        rng = np.random.default_rng(20)
        self.shares = rng.random((WALKS, SAMPLES, BITS))

    def windows(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and first word (it may lie before the text) of the windows at unchanged pieces."""
        found = []
        for pieces in self.pieces:
            grams = _grams(words, pieces.size)
            at = np.flatnonzero(pieces.table[grams >> np.uint64(64 - _TABLE_BITS)])
            low = np.searchsorted(pieces.hashes, grams[at], "left")
            high = np.searchsorted(pieces.hashes, grams[at], "right")
            n = high - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            text = np.searchsorted(bounds, at, side="right") - 1
            whole = at + pieces.size <= bounds[text + 1]
            at, low, n, text = at[whole], low[whole], n[whole], text[whole]
            own = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([np.repeat(text, n), pieces.item[own], np.repeat(at, n) - pieces.place[own]], axis=1))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        rows = np.unique(np.concatenate(found), axis=0)
        return rows[:, 0], rows[:, 1], rows[:, 2]

    def collide(self, words: np.ndarray, bounds: np.ndarray, text, item, start) -> np.ndarray:
        """Which windows agree with their item in all sampled places of some repetition."""
        n, length = len(text), self.length[item]
        steps = 3 * length
        result = np.zeros(n, bool)
        begin, end = bounds[text], bounds[text + 1]
        for walk in range(WALKS):
            here, there = np.zeros(n, np.int64), np.zeros(n, np.int64)
            picked = np.floor(self.shares[walk][None] * steps[:, None, None]).astype(np.int64)
            agree = np.ones((n, SAMPLES), bool)
            for step in range(int(steps.max())):
                at = start + here
                inside = (here < length) & (at >= begin) & (at < end)
                a = np.where(inside, words[np.clip(at, 0, len(words) - 1)], PAD)
                b = np.where(there < length, self.flat[self.first[item] + np.minimum(there, length - 1)], PAD)
                differs = a != b
                hit = (picked == step).any(axis=2)
                agree &= ~(hit & differs[:, None])
                here += _bits(a, step, walk)
                there += _bits(b, step, walk)
            result |= agree.any(axis=1)
        return result

    def verify(self, words: np.ndarray, bounds: np.ndarray, text, item, start) -> tuple[np.ndarray, np.ndarray]:
        """Least edit distance between item and any stretch around the window, and where the stretch ends."""
        best = np.full(len(text), 1 << 30)
        ends = np.zeros(len(text), np.int64)
        for own in self._equally_long(item):
            length = int(self.length[item[own[0]]])
            reach = int(self.edits[item[own[0]]])
            pattern = self.flat[self.first[item[own], None] + np.arange(length)]
            ramp = np.arange(length + 1)
            row = np.broadcast_to(ramp, (len(own), length + 1)).copy()
            begin, end = bounds[text[own]], bounds[text[own] + 1]
            for k in range(-2 * reach, int(length) + 2 * reach):
                at = start[own] + k
                inside = (at >= begin) & (at < end)
                word = np.where(inside, words[np.clip(at, 0, len(words) - 1)], PAD)
                fresh = np.empty_like(row)
                fresh[:, 0] = 0
                fresh[:, 1:] = np.minimum(row[:, :-1] + (pattern != word[:, None]), row[:, 1:] + 1)
                fresh = np.minimum.accumulate(fresh - ramp, axis=1) + ramp
                row = np.where(inside[:, None], fresh, row)
                nearer = inside & (row[:, -1] < best[own])
                best[own[nearer]] = row[nearer, -1]
                ends[own[nearer]] = at[nearer] + 1
        return best, ends

    def _equally_long(self, item: np.ndarray) -> Iterator[np.ndarray]:
        """Places of windows whose items have the same length, in groups of about ``CELLS`` words in all."""
        for length in np.unique(self.length[item]).tolist():
            own = np.flatnonzero(self.length[item] == length)
            step = max(1, CELLS // length)
            for a in range(0, len(own), step):
                yield own[a : a + step]

    def search(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Text, item, distance and last word (exclusive, counted in the text) of what is found."""
        text, item, start = self.windows(words, bounds)
        for s in range(0, len(text), WINDOWS):
            t, i, a = text[s : s + WINDOWS], item[s : s + WINDOWS], start[s : s + WINDOWS]
            near = self.collide(words, bounds, t, i, a)
            t, i, a = t[near], i[near], a[near]
            if len(t):
                distance, end = self.verify(words, bounds, t, i, a)
                ok = distance <= self.edits[i]
                yield t[ok], i[ok], distance[ok], end[ok] - bounds[t[ok]]


def _bits(words: np.ndarray, step: int, walk: int) -> np.ndarray:
    return (mix(words, 1000 * walk + step + 31) & np.uint64(1)).astype(np.int64)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, **options) -> Iterator[ItemIndex]:
    """The items in blocks, so that the driver and each task hold one block at a time."""
    text = F.col(text_col).cast("string")
    rows = items.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Half-filled on average, so that uneven hashing stays within the bound.
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id", "text").collect()
        index = ItemIndex([r.id for r in own], [r.text for r in own], **options)
        if index.ids:
            yield index


def find_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    **options,
) -> DataFrame:
    """Matches: ``doc_id``, ``item_id``, ``distance`` (word edits), ``item_words`` and ``end_word``, the
    number of words up to the end of the nearest stretch; the nearest match of each pair."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance long, item_words long, end_word long"
    found = spark.createDataFrame([], schema)
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    for index in item_blocks(items, item_col, item_text_col, **options):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for a, b, words, bounds in _word_groups(batch.column(1)):
                    for text, item, distance, end in index.search(words, bounds):
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).slice(a, b - a).take(pa.array(text)),
                                pa.array([index.ids[i] for i in item], pa.int64()),
                                pa.array(distance),
                                pa.array(index.length[item]),
                                pa.array(end),
                            ],
                            names=["doc_id", "item_id", "distance", "item_words", "end_word"],
                        )

        found = found.unionByName(source.mapInArrow(search, schema))
    nearest = F.min(F.struct("distance", "end_word", "item_words")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(nearest).select(
        "doc_id", "item_id", "m.distance", "m.item_words", "m.end_word"
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options
) -> DataFrame:
    """All columns of the rows whose text holds no item."""
    place = docs.columns.index(text_col)
    names, schema = docs.columns, docs.schema
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    for index in item_blocks(items, item_col, item_text_col, **options):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for a, _, words, bounds in _word_groups(batch.column(place)):
                    for text, _, _, _ in shared.value.search(words, bounds):
                        keep[a + text] = False
                yield batch.filter(pa.array(keep))

        plain = plain.mapInArrow(clean, plain.schema)
    return plain.toDF(*names) if len(schema) else plain


def _word_groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffers(column)
    for a, b in row_groups(offsets):
        words, bounds, _ = hash_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _WORDS)
        yield a, b, words, bounds
