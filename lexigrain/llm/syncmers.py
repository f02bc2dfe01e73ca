"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if its smallest inner s-mer (by hash) stands at its beginning or end.
That depends on the k-mer alone, so equal passages have equal anchors wherever they stand. The
fingerprint is a one-permutation MinHash sketch of a text's anchor hashes; ``anchors`` gives the anchors
themselves with their positions.

Defined results: a null text is empty. An empty text has the fingerprint ``EMPTY``, equal only to itself;
a text without a syncmer, such as one shorter than a k-mer, has its whole self as one anchor. Rows follow each other by descending id,
then text; null ids come last. Only id and text are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexigrain.llm.hashing import mix, powers

K = 20
S = 6
#: Slots of a fingerprint, four hex digits each.
SLOTS = 64
#: Code points worked on at once; a longer text is cut with an overlap of one k-mer.
PIECE = 1 << 19
EMPTY = "0" * (4 * SLOTS)
_BASE = 0xD6E8FEB86659FD93
_EDGE_RATIO = 4  # ranges per shuffle partition, to even out their sizes


def _smer_hashes(points: np.ndarray, s: int) -> np.ndarray:
    weights = powers(_BASE, s)
    total = np.zeros(len(points) - s + 1, np.uint64)
    for j in range(s):
        total += (points[j : len(points) - s + 1 + j].astype(np.uint64) + np.uint64(1)) * weights[j]
    return mix(total, 11)


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have, result = 1, values
    while have < width:
        step = min(have, width - have)
        result = np.minimum(result[: len(result) - step], result[step:])
        have += step
    return result


def syncmers(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of one text's code points."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    for start in range(0, n - k + 1, PIECE):
        part = points[start : start + PIECE + k - 1]
        inner = _smer_hashes(part, s)
        width = k - s + 1
        least = _window_minimum(inner, width)
        at = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
        # Three s-mers that cover the k-mer's beginning, middle and end, and the rest by a second hash.
        total = np.zeros(len(at), np.uint64)
        for j in range(0, width, s):
            total += mix(inner[at + j], j + 17)
        hashes.append(mix(total + mix(inner[at + width - 1], 7), 13))
        places.append(at + start)
    if not sum(map(len, places)):
        total = ((points.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n)).sum(dtype=np.uint64)
        return np.zeros(1, np.int64), mix(np.array([total], np.uint64), 13)
    return np.concatenate(places), np.concatenate(hashes)


def fingerprint(points: np.ndarray, k: int = K, s: int = S, slots: int = SLOTS) -> np.ndarray:
    """Sketch of the anchor set: per slot 16 bits of the least anchor; an empty slot takes the next full one."""
    _, hashes = syncmers(points, k, s)
    if len(hashes) == 0:
        return np.zeros(slots, np.uint16)
    least = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (hashes >> np.uint64(32)) % np.uint64(slots), hashes)
    full = np.flatnonzero(least != np.iinfo(np.uint64).max)
    # Densification: an empty slot takes its value from a full slot chosen by rotation, mixed with the distance.
    source = full[np.searchsorted(full, np.arange(slots)) % len(full)]
    distance = (source - np.arange(slots)) % slots
    values = mix(least[source] + distance.astype(np.uint64), 19)
    return (values & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots, 0 to 1."""
    return float(np.mean(a == b))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """One row per anchor: id, position (code points from 0) and hash, for positional matching."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                places, hashes = syncmers(code_points(text.as_py() or ""), k, s)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id.as_py()] * len(places), pa.int64()),
                        pa.array(places, pa.int64()),
                        pa.array(hashes.view(np.int64)),
                    ],
                    names=["id", "position", "anchor"],
                )

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(find, "id long, position long, anchor long")


def in_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt out by id ranges, each range followed by the row that comes next after it.

    Range bounds come from quantiles of the ids, and the row next to each range from one row of figures
    per range; both are bounded by the number of shuffle partitions. The text is shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    # Rows without an id come last; among the lowest numbers their texts spread them over several ranges.
    spread = F.lit(-(1 << 63)) + F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    order = F.coalesce(F.col("doc_id"), spread).alias("o")
    n = _EDGE_RATIO * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)]
    bounds = sorted(set(rows.agg(F.percentile_approx(order, F.array(*map(F.lit, shares)), 100 * n)).first()[0] or []))
    # Range r holds the ids above bounds[r - 1] up to bounds[r].
    held = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<bigint>")
    rank = _range_of(F.col("o"), held)
    ranged = rows.select("doc_id", "text", order).withColumn("range", rank)
    tops = sorted((r.range, r.top) for r in ranged.groupBy("range").agg(F.max("o").alias("top")).collect())
    # The largest id of a range follows the smallest of the range above; after the last row comes the first.
    follows = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}
    places = [F.col("range")]
    lookup = F.lit(None).cast("int")
    if follows:
        table = F.create_map(*(F.lit(x) for pair in follows.items() for x in pair))
        lookup = F.element_at(table, F.col("o")).cast("int")
    dealt = ranged.select(
        "doc_id",
        "text",
        "o",
        F.explode(
            F.when(lookup.isNull(), F.array(F.struct(places[0].alias("range"), F.lit(0).alias("ahead")))).otherwise(
                F.array(
                    F.struct(places[0].alias("range"), F.lit(0).alias("ahead")),
                    F.struct(lookup.alias("range"), F.lit(1).alias("ahead")),
                )
            )
        ).alias("to"),
    ).select("doc_id", "text", "o", "to.range", "to.ahead")
    return dealt.repartition(max(1, n // _EDGE_RATIO), "range").sortWithinPartitions(
        "range", "ahead", F.col("o").desc(), F.col("text").desc()
    )


def _range_of(value: Column, bounds: Column) -> Column:
    """Number of bounds below ``value``, by halving."""
    size = F.size(bounds)

    def step(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        open_ = state["low"] < state["high"]
        below = F.element_at(bounds, F.least(middle + 1, F.greatest(size, F.lit(1)))) < value
        return F.struct(
            F.when(open_ & below, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(open_ & ~below, middle).otherwise(state["high"]).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), size.alias("high"))
    return F.when(size == 0, F.lit(0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, step, lambda state: state["low"])
    )


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprint_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, slots: int = SLOTS
) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose second half is the next row's beginning."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64())]
        + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [(c, pa.float64()) for c in ("near_edited", "near_next")]
    )

    def hexed(values: np.ndarray) -> str:
        return values.astype(">u2").tobytes().hex()

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one is still to come
        for batch in batches:
            out = []
            for doc_id, text, part, ahead in zip(
                batch.column(0), batch.column(1), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            ):
                if ahead and (held is None or held["range"] != part):
                    continue  # only the first of the rows that follow a range counts
                text = text.as_py()
                points = code_points(text)
                own = fingerprint(points, k, s, slots)
                if held is not None and held["range"] == part:
                    half = len(held["points"]) // 2
                    edited = np.concatenate([held["points"][: len(held["points"]) - half], points[:half]])
                    changed = fingerprint(edited, k, s, slots)
                    whole = edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
                    out.append(
                        {
                            "doc_id": held["doc_id"],
                            "n_chars": len(held["points"]),
                            "edited_sha256": hashlib.sha256(whole).hexdigest(),
                            "fingerprint": hexed(held["own"]),
                            "edited_fingerprint": hexed(changed),
                            "near_edited": likeness(held["own"], changed),
                            "near_next": likeness(held["own"], own),
                        }
                    )
                held = None if ahead else {"doc_id": doc_id.as_py(), "points": points, "own": own, "range": part}
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    dealt = in_ranges(docs, id_col, text_col)
    return dealt.mapInArrow(compare, OUT)
