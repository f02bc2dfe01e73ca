"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1 derived from its code point. A letter trigram is the product
of its three letters' vectors, permuted by place; a text is the sum of its trigrams' vectors, and so is a
language over all its training texts. A document is given the language whose prototype has the largest
cosine with it. Sums are linear, so the dot product of a document with a prototype is taken trigram by
trigram; the length of a document's vector is its expected value, as trigram vectors are nearly orthogonal.

Defined results: null texts and texts without a letter are ``und`` with score 0, as are all texts if nothing
could be learned. Ties go to the first language in name order. Rows are predicted one by one, so repeated
ids do no harm; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexigrain.llm.hashing import mix

DIMENSIONS = 2048
UNKNOWN = "und"
#: Characters worked on at once.
GROUP = 1 << 20
#: Trigrams whose vectors are made at once.
BLOCK = 4096
_BLANK = 32
_letters = np.zeros(0x110000, np.uint8)  # 0 not looked up, 1 letter, 2 other


def letter_vectors(code_points: np.ndarray, dimensions: int) -> np.ndarray:
    """Rows of +1 and -1, the same in every process."""
    words = mix(code_points.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(dimensions // 64, dtype=np.uint64), 5)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(code_points), -1), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def is_letter(code_points: np.ndarray) -> np.ndarray:
    seen = np.zeros(0x110000, bool)
    seen[code_points] = True
    for c in np.flatnonzero(seen & (_letters == 0)).tolist():
        _letters[c] = 1 if chr(c).isalpha() else 2
    return _letters[code_points] == 1


class Trigrams:
    """The letter trigrams of a group of texts: runs of other characters count as one blank."""

    def __init__(self, texts: list[str]):
        joined = "".join("\0" + t.lower() for t in texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = is_letter(points)
        marks = points == 0
        # A null character inside a text is a blank like any other.
        lengths = np.array([len(t.lower()) + 1 for t in texts])
        places = np.cumsum(lengths) - lengths
        marks = np.zeros(len(points), bool)
        marks[places] = True
        marks[-1] = True
        keep = letters.copy()
        keep[0] = True
        keep[1:] |= letters[:-1]
        run = np.cumsum(keep) - 1
        symbols = np.where(letters, points, _BLANK)[keep]
        edge = np.zeros(len(symbols), bool)
        edge[run[marks]] = True
        text = (np.cumsum(marks) - 1)[keep]
        self.symbols, self.codes = np.unique(symbols, return_inverse=True)
        n = len(self.symbols)
        a, b, c = self.codes[:-2], self.codes[1:-1], self.codes[2:]
        inner = ~edge[1:-1] if len(symbols) > 2 else np.zeros(0, bool)
        self.ids = ((a.astype(np.int64) * n + b) * n + c)[inner]
        self.text = text[1:-1][inner]
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.has_letter = np.bincount(text[letters[keep]], minlength=len(texts))[: len(texts)] > 0

    def vectors(self, ids: np.ndarray, dimensions: int) -> Iterator[tuple[slice, np.ndarray]]:
        """Vectors of trigrams, a block at a time."""
        n = len(self.symbols)
        third = letter_vectors(self.symbols, dimensions)
        second, first = np.roll(third, 1, axis=1), np.roll(third, 2, axis=1)
        for s in range(0, len(ids), BLOCK):
            part = ids[s : s + BLOCK]
            yield slice(s, s + BLOCK), first[part // (n * n)] * second[part // n % n] * third[part % n]


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def learn_prototypes(
    docs: DataFrame, text: Column, lang: Column, dimensions: int = DIMENSIONS
) -> tuple[list[str], np.ndarray]:
    """Language names and their summed vectors. What reaches the driver is one vector per language."""

    def bundle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(dimensions, np.int64))
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for a, b in _groups(texts):
                grams = Trigrams(texts[a:b])
                names = langs[a:b]
                used, inverse = np.unique(grams.ids, return_inverse=True)
                for name in dict.fromkeys(names):
                    own = names[grams.text] == name
                    counts = np.bincount(inverse[own], minlength=len(used))
                    present = np.flatnonzero(counts)
                    for part, vectors in grams.vectors(used[present], dimensions):
                        sums[name] += np.rint(counts[present[part]].astype(np.float64) @ vectors).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))],
                names=["lang", "vector"],
            )

    rows = (
        docs.select(text.cast("string").alias("text"), lang.cast("string").alias("lang"))
        .where("text is not null and lang is not null")
        .mapInArrow(bundle, "lang string, vector array<bigint>")
        .select("lang", F.posexplode("vector").alias("place", "value"))
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("vector"))
        .select("lang", F.col("vector.value").alias("vector"))
        .orderBy("lang")
        .collect()
    )
    rows = [r for r in rows if any(r.vector)]
    return [r.lang for r in rows], np.array([r.vector for r in rows], np.float64).reshape(len(rows), dimensions)


def predict_languages(
    docs: DataFrame, text: Column, keep: dict[str, Column], model: tuple[list[str], np.ndarray]
) -> DataFrame:
    """Columns ``keep``, then ``lang_pred`` and ``score`` (the cosine, 0 to 1), for every row."""
    names, prototypes = model
    lengths = np.linalg.norm(prototypes, axis=1) if names else np.ones(0)
    unit = np.divide(prototypes.T, lengths).astype(np.float32) if names else prototypes.T
    dimensions = prototypes.shape[1]
    shared = docs.sparkSession.sparkContext.broadcast(unit)
    columns = [*keep, "lang_pred", "score"]

    def score(texts: list[str]) -> tuple[list[str], list[float]]:
        grams = Trigrams(texts)
        used, inverse = np.unique(grams.ids, return_inverse=True)
        dots = np.empty((len(used), len(names)), np.float64)
        for part, vectors in grams.vectors(used, dimensions):
            dots[part] = vectors.astype(np.float32) @ shared.value
        langs, scores = [], []
        for k in range(len(texts)):
            own = inverse[grams.bounds[k] : grams.bounds[k + 1]]
            if not grams.has_letter[k] or not len(own) or not names:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            ids, counts = np.unique(own, return_counts=True)
            cosines = counts @ dots[ids] / np.sqrt(dimensions * float(counts @ counts))
            best = int(np.argmax(cosines))
            langs.append(names[best])
            scores.append(float(min(1.0, max(0.0, cosines[best]))))
        return langs, scores

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in _groups(texts):
                langs, scores = score(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=columns,
                )

    source = docs.select(text.cast("string").alias("text"), *(c.alias(k) for k, c in keep.items()))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]]
    return source.mapInArrow(predict, ", ".join([*fields, "lang_pred string", "score double"]))
