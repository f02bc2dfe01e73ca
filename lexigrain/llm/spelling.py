"""Grouping of spelling variants by reduced-alphabet generation.

Letters are hashed to ``SYMBOLS`` symbols, so a word becomes a reduced word. Two words one edit apart have
reduced words at most one edit apart. The one-edit neighbourhood of every distinct reduced word is written
out as hashes and joined with the reduced vocabulary; words whose reduced words meet are then compared letter
by letter, so a collision costs a comparison and never a wrong pair. Of two neighbouring reduced words only
one has to generate the other: shorter ones by deletion from the longer, equally long ones by replacing a
symbol with a larger one, and every reduced word itself. This covers each neighbourhood in full.

Only distinct words leave the first aggregation, which combines on the map side; a word that makes up a third
of all text is one row per task. Neighbourhoods are made in bounded pieces, also those of a very long word.

Defined results: null and empty texts hold no words. A run in a row with a null id is taken as it is by
:func:`planted_runs`. Repeated rows count each time. Equal counts: the smaller word in code-point order. An
empty table gives no rows. Only the named columns are read, so further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexigrain.storage import StoredTable

#: Symbols that letters are hashed to: the code point modulo this number, which spreads Latin letters evenly.
SYMBOLS = 8
MIN_LENGTH = 5
MIN_COUNT = 3
#: A form must be this many times as frequent as the word.
RATIO = 2
#: Array cells worked on at once while neighbourhoods are generated.
CELLS = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def letter_runs(text: Column, min_length: int = MIN_LENGTH) -> Column:
    """Maximal runs of Latin-1 letters (with U+00D7 and U+00F7) of at least ``min_length`` code points."""
    return F.regexp_extract_all(text, F.lit(rf"[A-Za-zÀ-ÿ]{{{min_length},}}"), F.lit(0))


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    ascii_only = F.octet_length(word) == F.char_length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, _UPPER, _UPPER.lower()))


def planted_runs(key: Column, run: Column, every: int = 97) -> Column:
    """The run without one code point where ``every`` divides the crc32 of ``<key>:<run>``."""
    h = F.crc32(F.concat(key.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def count_words(
    docs: DataFrame, text: Column, spelled=lambda run: run, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT
) -> DataFrame:
    """``(word, n)`` over all texts. ``spelled`` maps a lower-cased run to what is counted; it may drop letters."""
    runs = docs.select("*", F.explode(letter_runs(text.cast("string"), min_length)).alias("_run"))
    return (
        runs.select(spelled(lower_ascii(F.col("_run"))).alias("word"))
        .where(F.char_length("word") >= min_length)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_count)
    )


def _powers(base: int, n: int) -> np.ndarray:
    table = np.full(n, base, np.uint64)
    table[:1] = 1
    return np.multiply.accumulate(table)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and reduced words (symbols from 1 on) of equally long words, in pieces of about ``CELLS``."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        step = max(1, CELLS // (size * SYMBOLS))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            yield part, points[starts[part][:, None] + np.arange(size)] % np.uint32(SYMBOLS) + np.uint32(1)


def reduced_hashes(words: list[str]) -> np.ndarray:
    """A hash of each word's reduced word, as signed 64-bit numbers."""
    out = np.zeros(len(words), np.uint64)
    for rows, symbols in _by_length(words):
        out[rows] = (symbols * _powers(_BASE, symbols.shape[1])).sum(axis=1, dtype=np.uint64)
    return out.view(np.int64)


def neighbour_hashes(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a reduced word's hash and that of a neighbour it generates, itself included, in pieces."""
    for _, symbols in _by_length(words):
        size = symbols.shape[1]
        power = _powers(_BASE, size)
        weighted = symbols * power
        upto = np.cumsum(weighted, axis=1, dtype=np.uint64)
        total = upto[:, -1]
        yield total, total
        step = max(1, CELLS // (len(symbols) * SYMBOLS))
        for a in range(0, size, step):
            b = min(a + step, size)
            own = symbols[:, a:b]
            if size > 1:
                # Deleting any symbol of a stretch of equal ones gives the same word: the last one stands for all.
                last = np.ones(own.shape, bool)
                stop = min(b, size - 1)
                last[:, : stop - a] = symbols[:, a:stop] != symbols[:, a + 1 : stop + 1]
                row, at = np.nonzero(last)
                before, after = upto[row, at + a] - weighted[row, at + a], total[row] - upto[row, at + a]
                yield total[row], before + after * np.uint64(_INVERSE)
            for symbol in range(2, SYMBOLS + 1):
                row, at = np.nonzero(own < symbol)
                change = (np.uint64(symbol) - own[row, at].astype(np.uint64)) * power[at + a]
                yield total[row], total[row] + change


def _with_reduced(words: DataFrame) -> DataFrame:
    """``(word, n, form_id)``: the hash of the reduced word beside each word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = reduced_hashes(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes)], names=["word", "n", "reduced"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, reduced long")


def _neighbourhoods(words: DataFrame) -> DataFrame:
    """``(reduced, near)``: hashes of every reduced word and of the neighbours it generates."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, near in neighbour_hashes(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.view(np.int64)), pa.array(near.view(np.int64))], names=["reduced", "near"]
                )

    example = words.groupBy("reduced").agg(F.min("word").alias("word"))
    return example.select("word").mapInArrow(run, "reduced long, near long")


def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, n_a, b, n_b)``: every unordered pair of words that differ by one code point, once.

    ``words`` has ``word``, ``n`` and ``reduced`` and should be stored, as it is read several times.
    """
    known = words.select(F.col("reduced").alias("near")).distinct()
    meeting = _neighbourhoods(words).join(known, "near", "left_semi").distinct()
    first = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "reduced")
    second = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("reduced").alias("near"))
    return (
        meeting.join(first, "reduced")
        .join(second, "near")
        .where((F.col("reduced") != F.col("near")) | (F.col("a") < F.col("b")))
        .where(F.levenshtein("a", "b", 1) == 1)
        .select("a", "n_a", "b", "n_b")
    )


def _best_forms(pairs: DataFrame, ratio: int) -> DataFrame:
    """``(word, n_near, form, form_n)`` for every word that has a near word."""
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m")),
    )
    best = F.min(F.struct((-F.col("m")).alias("m"), "other"))
    grouped = pairs.select(F.inline(sides)).groupBy("word").agg(
        F.count("*").alias("n_near"), F.first("n").alias("own"), best.alias("best")
    )
    frequent = -F.col("best.m") >= ratio * F.col("own")
    return grouped.select(
        "word",
        "n_near",
        F.when(frequent, F.col("best.other")).alias("form"),
        F.when(frequent, -F.col("best.m")).alias("form_n"),
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for words with a form. Counts grow along forms, so chains end; a round doubles the step."""
    step = StoredTable(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = step.df.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        moved = step.df.join(onward, step.df["root"] == onward["via"], "left")
        further = StoredTable(
            moved.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots"
        )
        step.drop()
        step = further
        if not step.df.where("moved").limit(1).count():
            return step.df.select("word", "root")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words`` (``word`` distinct, ``n``).

    A word's form is its near word of largest ``n`` if that is at least ``ratio`` times its own; its root is
    where the forms end.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent, or forms could run in circles")
    stored = StoredTable(_with_reduced(words), "spelled-words")
    best = StoredTable(_best_forms(near_pairs(stored.df), ratio), "spelling-forms")
    roots = _roots(best.df.where("form IS NOT NULL"))
    own = stored.df.select("word", "n")
    near = best.df.select(F.col("word").alias("near_word"), "n_near", "form", "form_n")
    ends = roots.select(F.col("word").alias("root_word"), "root")
    return (
        own.join(near, own["word"] == near["near_word"], "left")
        .join(ends, own["word"] == ends["root_word"], "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.col("form_n").cast("long").alias("form_n"),
        )
    )


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant_every: int | None = None) -> DataFrame:
    """:func:`group_variants` over the words of whole texts; ``plant_every`` cuts letters by :func:`planted_runs`."""
    rows = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    if plant_every is None:
        words = count_words(rows, F.col("_text"))
    else:
        def spelled(run: Column) -> Column:
            return F.coalesce(planted_runs(F.col("_key"), run, plant_every), run)

        words = count_words(rows, F.col("_text"), spelled)
    return group_variants(words)
