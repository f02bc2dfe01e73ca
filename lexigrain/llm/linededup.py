"""Removal of repeated runs of lines by winnowing over line hashes.

Lines are hashed; a short window is the least run of lines from some line on that holds at least half of
``min_words`` words. From all short windows inside each least run of ``min_words`` words the one with the
smallest hash is selected, so any two equal runs of at least ``min_words`` words select an equal
fingerprint. Only fingerprints that occur more than once are followed: their positions are joined back to
the texts, and around each the match is extended both ways by hashing the least runs of ``min_words`` words
that contain it, once from every first line forward and once from every last line backward. A run whose
hash occurs earlier (by id, then line) without overlapping it is a repeat, and the lines of all repeats
are deleted. So the first occurrence stays whole, wherever the repeats stand, and no pairs are formed.

Defined results: a null text stays null, an empty one empty. Rows with a null id come after all others;
repeated ids are told apart by their text, and equal rows are one position, so both stay or both lose the
same lines. A text that loses all its lines is left out by ``dedup_lines``. An empty table gives no rows.
Other columns pass untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigrain.llm.hashing import hash_words, mix, row_groups, text_buffers
from lexigrain.storage import StoredTable

MIN_WORDS = 50
#: Rows and array entries sent to all tasks, at up to about 40 bytes each; more are joined by shuffle.
BROADCAST_ITEMS = 1_000_000


def line_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and word count of every line, and the line offsets of the texts. Lines end at line feeds; white
    space around and between words does not count, letters do not differ by case."""
    rows = len(offsets) - 1
    words, _, places = hash_words(data, offsets)
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    line_offsets = np.concatenate(([0], np.cumsum(1 + np.diff(np.searchsorted(breaks, offsets)))))
    first = np.searchsorted(places, starts)
    counts = np.diff(np.append(first, len(places)))
    rank = np.arange(len(places)) - np.repeat(first, counts)
    # A sum of mixed words, each tied to its place in the line.
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words + mix(rank.astype(np.uint64), 3), 5))))
    hashes = mix(sums[first + counts] - sums[first] + counts.astype(np.uint64), 9)
    assert len(starts) == line_offsets[-1] and rows == len(line_offsets) - 1
    return hashes, counts, line_offsets


class Runs:
    """The least runs of a text's lines that hold a number of words, from each line on."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.n = len(hashes)
        self.words = np.concatenate(([0], np.cumsum(counts)))
        # hash(a..b) = (sum over lines of hash * base**line) / base**a, so that it does not depend on a.
        self.base = np.uint64(0xC2B2AE3D27D4EB4F)
        inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        scale = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(self.n, self.base))))
        self.unscale = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(self.n, inverse))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * scale[: self.n])))

    def hash(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the runs ``first .. last``, both inclusive."""
        return mix((self.sums[last + 1] - self.sums[first]) * self.unscale[first] + (last - first).astype(np.uint64))

    def forward(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last lines of the least runs from each line on."""
        last = np.searchsorted(self.words, self.words[:-1] + least) - 1
        first = np.flatnonzero(last < self.n)
        return first, last[first]

    def backward(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last lines of the least runs that end with each line."""
        first = np.searchsorted(self.words, self.words[1:] - least, side="right") - 1
        last = np.flatnonzero(first >= 0)
        return first[last], last


def winnow(runs: Runs, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines at which the selected short windows begin, and their hashes."""
    first, last = runs.forward(min_words)
    if not len(first):
        return first, np.zeros(0, np.uint64)
    short_first, short_last = runs.forward((min_words + 1) // 2)
    hashes = runs.hash(short_first, short_last)
    # Short windows inside the run a..b start at a or later and end by b; both ends rise with the start.
    low = np.searchsorted(short_first, first)
    high = np.searchsorted(short_last, last, side="right")
    chosen = [int(a) + int(np.argmin(hashes[a:b])) for a, b in zip(low, high)]
    at = np.unique(chosen)
    return short_first[at], hashes[at]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row number, line hashes and line word counts of each text of a batch."""
    data, offsets = text_buffers(batch.column(column))
    for a, b in row_groups(offsets):
        hashes, counts, lines = line_table(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for k in range(b - a):
            yield a + k, hashes[lines[k] : lines[k + 1]], counts[lines[k] : lines[k + 1]]


def _few(stored: DataFrame, array: str | None = None) -> bool:
    """Whether a stored table may be sent to all tasks, counting the entries of its array column."""
    items = F.count("*") + (F.sum(F.size(array)) if array else F.lit(0))
    return (stored.agg(items.alias("n")).first().n or 0) <= BROADCAST_ITEMS


def _text_key(name: str):
    return F.xxhash64(F.col(name).cast("string"))


FINGERPRINTS = "id long, text_key long, line int, fingerprint long"


def fingerprints(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lines, hashes = [], [], []
            for row, line_hashes, counts in _texts(batch, 2):
                if counts.sum() < min_words:
                    continue
                at, own = winnow(Runs(line_hashes, counts), min_words)
                rows.append(np.full(len(at), row))
                lines.append(at)
                hashes.append(own)
            if rows:
                where = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(where),
                        batch.column(1).take(where),
                        pa.array(np.concatenate(lines), pa.int32()),
                        pa.array(np.concatenate(hashes).view(np.int64)),
                    ],
                    names=["id", "text_key", "line", "fingerprint"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("id"), _text_key(text_col), F.col(text_col).cast("string"))
    return source.mapInArrow(select, FINGERPRINTS)


RUNS = "id long, text_key long, first int, last int, run long"


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Runs to delete: ``id``, ``text_key``, ``first`` and ``last`` line, and the earlier ``source_id``."""
    found = StoredTable(fingerprints(docs, id_col, text_col, min_words), "fingerprints").df
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "line")
    shared = (
        found.groupBy("fingerprint")
        .agg(F.min(order).alias("low"), F.max(order).alias("high"))
        .where("low <> high")
        .select("fingerprint")
    )
    # Once per text, the lines where shared fingerprints begin.
    positions = (
        found.join(shared, "fingerprint")
        .groupBy("id", "text_key")
        .agg(F.array_sort(F.collect_set("line")).alias("at"))
    )
    positions = StoredTable(positions, "positions").df
    few = _few(positions, "at")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), _text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text")
    )
    where = positions.select(F.col("id").alias("p_id"), F.col("text_key").alias("p_key"), "at")
    touched = rows.join(
        F.broadcast(where) if few else where, rows.id.eqNullSafe(where.p_id) & (rows.text_key == where.p_key)
    ).select("id", "text_key", "text", "at")

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for row, hashes, counts in _texts(batch, 2):
                runs = Runs(hashes, counts)
                at = np.array(batch.column(3)[row].as_py())
                short_first, short_last = runs.forward((min_words + 1) // 2)
                ends = short_last[np.searchsorted(short_first, at)]
                for first, last in (runs.forward(min_words), runs.backward(min_words)):
                    # A run holds a fingerprint if the first one that begins in it also ends in it.
                    k = np.searchsorted(at, first)
                    inside = (k < len(at)) & (ends[np.minimum(k, len(at) - 1)] <= last)
                    first, last = first[inside], last[inside]
                    for column, values in zip(out, (np.full(len(first), row), first, last, runs.hash(first, last))):
                        column.append(values)
            if out[0]:
                where_rows = pa.array(np.concatenate(out[0]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(where_rows),
                        batch.column(1).take(where_rows),
                        pa.array(np.concatenate(out[1]), pa.int32()),
                        pa.array(np.concatenate(out[2]), pa.int32()),
                        pa.array(np.concatenate(out[3]).view(np.int64)),
                    ],
                    names=["id", "text_key", "first", "last", "run"],
                )

    runs = StoredTable(touched.mapInArrow(extend, RUNS).distinct(), "runs").df
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "first", "last")
    firsts = StoredTable(
        runs.groupBy("run")
        .agg(F.min(place).alias("source"), F.max(place).alias("other"))
        .where("source <> other")
        .select("run", "source"),
        "run-sources",
    ).df
    # One row per run that repeats. Sent to all tasks, the rows of a very common run stay where they are.
    firsts = F.broadcast(firsts) if _few(firsts) else firsts
    same_text = F.col("id").eqNullSafe(F.col("source.id")) & (F.col("text_key") == F.col("source.text_key"))
    return (
        runs.join(firsts, "run")
        .where(~same_text | (F.col("first") > F.col("source.last")))
        .select("id", "text_key", "first", "last", F.col("source.id").alias("source_id"))
    )


def deleted_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per text that loses lines: ``id``, ``text_key`` and the sorted ``lines``."""
    return (
        repeated_runs(docs, id_col, text_col, min_words)
        .select("id", "text_key", F.explode(F.sequence("first", "last")).alias("line"))
        .groupBy("id", "text_key")
        .agg(F.array_sort(F.collect_set("line")).alias("lines"))
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, keep_emptied: bool = False
) -> DataFrame:
    """All columns of ``docs`` without the repeated lines in its text; texts that lose everything go."""
    gone = StoredTable(deleted_lines(docs, id_col, text_col, min_words), "deleted-lines").df
    few = _few(gone, "lines")
    # Columns are told apart by place, so names of further columns do no harm.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = plain[place[text_col]].cast("string")
    gone = F.broadcast(gone) if few else gone
    joined = plain.join(
        gone, plain[place[id_col]].cast("long").eqNullSafe(gone["id"]) & (F.xxhash64(text) == gone["text_key"]), "left"
    )
    # The generator makes the parts once per row, so that taking one of them does not split the text again.
    parts = F.when(F.col("lines").isNotNull(), F.split(text, "\n"))
    split = joined.select(*plain.columns, "lines", F.inline(F.array(F.struct(parts.alias("parts")))))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "lines")
    shorter = F.when(F.col("lines").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n"))
    rows = split.select(*(shorter.alias(c) if c == place[text_col] else c for c in plain.columns), (F.size("lines") == F.size("parts")).alias("emptied"))
    if not keep_emptied:
        rows = rows.where("not coalesce(emptied, false)")
    return rows.select(*plain.columns).toDF(*docs.columns)
