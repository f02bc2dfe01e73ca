"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has ``BINS`` coordinates. In each of up to ``BINS`` rounds every shingle goes to a hashed bin of
the round, and a bin keeps the least value of the first round that reaches it; bins still empty go through
further rounds that put every shingle into one bin each, so every coordinate fills. Coordinates of two
sketches agree with the Jaccard similarity of the sets, concentrated as with independent MinHashes, and
usually after one or two rounds.

``ROWS`` coordinates make a band. With 64 bands of 6, two sets of similarity 0.75 share no band with
probability 4e-6. Documents with equal sets are one class. Classes that share a band are linked if their
full sets confirm it:

1. Each class is compared with the class it shares most bands with as their smallest member, which joins
   the copies of a group; confirmed links make components.
2. Bands whose members are still in different components are searched completely. A band of up to
   ``GROUP`` members is searched in one task: pairs whose whole sketches agree in a share of ``ESTIMATE``
   (five standard deviations below the threshold) are confirmed there on full sets, until the band's
   components are joined or all pairs are refused. Members of a larger band are first compared with a few
   leaders, and components are contracted after each. What is still apart is dealt into blocks, a task for
   each pair of blocks, so that every pair between components is searched and no task holds more than
   about two thirds of ``GROUP`` members and ``GROUP_SHINGLES``. Two blocks of one component are not compared.

Only links between different components are looked for in the second step, as links inside one change
nothing. Copies are never expanded into pairs.

Words are runs of anything but ASCII white space, A-Z in lower case. Defined results: a text with fewer
than five words is one shingle; one without words, or null, has no shingle and no link. Rows that repeat an
id are one node with several texts. Rows with a null id are never linked, have no component, and are
kept. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigrain.llm.components import connected_components
from lexigrain.llm.hashing import hash_words, mix, row_groups, shingle_hashes, text_buffers
from lexigrain.storage import StoredTable

SHINGLE = 5
SIMILAR = 75  # per cent
BANDS, ROWS = 64, 6
BINS = BANDS * ROWS
#: Classes, and shingles of all together, that a group is searched with in one task.
GROUP = 2_000
GROUP_SHINGLES = 8_000_000
ESTIMATE = 0.75 - 5 * 0.022
#: Leaders that the members of larger groups are compared with before these are dealt into blocks.
LEADERS = 3
#: Ids sent to all tasks; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows and shingles that a worker holds at once.
ROWS_AT_ONCE = 512
SHINGLES_AT_ONCE = 1 << 19
_BLOCK = 4096


def sketch(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of hashes."""
    n = len(shingles)
    rounds = max(1, _BLOCK // n)
    empty = np.iinfo(np.uint64).max
    filled = np.full(bins, empty, np.uint64)
    spread = shingles * np.uint64(0x9E3779B97F4A7C15)
    for first in range(0, bins, rounds):
        numbers = np.arange(first, min(first + rounds, bins), dtype=np.uint64)
        values = mix(spread[None, :] ^ mix(numbers, 41)[:, None])
        places = (values % np.uint64(bins)).astype(np.int64)
        # The round leads, so that an earlier round always wins.
        keys = (numbers[:, None] << np.uint64(48)) | (values >> np.uint64(16))
        np.minimum.at(filled, places.ravel(), keys.ravel())
        if not (filled == empty).any():
            return filled
    for place in np.flatnonzero(filled == empty).tolist():
        values = mix(spread ^ mix(np.array([bins + place], np.uint64), 43))
        filled[place] = (np.uint64(bins + place) << np.uint64(48)) | (values.min() >> np.uint64(16))
    return filled


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One hash per band of each sketch (rows), tied to the band's number."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS)
    total = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64), 3), parts.shape[:2]).copy()
    for r in range(ROWS):
        total += mix(parts[:, :, r], r + 61)
    return mix(total)


def _shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = text_buffers(column)
    for a, b in row_groups(offsets):
        words, bounds, _ = hash_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for k in range(b - a):
            yield a + k, shingle_hashes(words[bounds[k] : bounds[k + 1]], SHINGLE)


def _set_hash(shingles: np.ndarray, seed: int) -> int:
    """A hash of the set that does not depend on order."""
    return int(mix(mix(shingles, seed).sum(dtype=np.uint64, keepdims=True))[0].astype(np.int64))


SKETCHES = "id long, n long, set_key long, set_check long, bands array<bigint>, bytes binary"


def _in_parts(column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Row ranges of a batch with their shingle sets, a bounded number at a time."""
    sets, first, held = [], 0, 0
    for row, shingles in _shingle_sets(column):
        sets.append(shingles)
        held += len(shingles)
        if len(sets) >= ROWS_AT_ONCE or held >= SHINGLES_AT_ONCE:
            yield first, row + 1, sets
            sets, first, held = [], row + 1, 0
    if sets:
        yield first, first + len(sets), sets


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrays as one Arrow list column, without Python numbers."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def sketch_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``SKETCHES`` of every row: set size, two hashes of the set, band keys, and a byte per coordinate."""
    none = np.zeros(0, np.uint64)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _in_parts(batch.column(1)):
                used = [len(s) > 0 for s in sets]
                table = np.array([sketch(s) if len(s) else np.zeros(BINS, np.uint64) for s in sets])
                bands = band_keys(table)
                low = (mix(table, 79) & np.uint64(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_set_hash(s, 71) for s in sets], pa.int64()),
                        pa.array([_set_hash(s, 73) for s in sets], pa.int64()),
                        _lists([k if u else none for k, u in zip(bands, used)]),
                        pa.array([r.tobytes() if u else b"" for r, u in zip(low, used)], pa.binary()),
                    ],
                    names=["id", "n", "set_key", "set_check", "bands", "bytes"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(measure, SKETCHES)


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def stored_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, shingles`` of the documents in ``ids``, made anew from their texts and stored."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    own = rows.join(F.broadcast(ids) if _few(ids) else ids, "id", "left_semi")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found in _in_parts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(found)], names=["id", "shingles"])

    return StoredTable(own.mapInArrow(sets, "id long, shingles array<bigint>"), "sets").df


def confirm(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``; at most one per ``b``) whose full sets are similar enough.

    Each pair carries one of its two sets through one shuffle; a document with many pairs is split by
    adaptive execution.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    stored = stored_sets(docs, ids, id_col, text_col)
    left = stored.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = stored.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(100 * both >= SIMILAR * (F.size("sa") + F.size("sb") - both))
        .select("a", "b")
        .distinct()
    )


def _sizes_fit(a: str, b: str):
    """Sets whose sizes differ by more cannot be similar enough."""
    return 100 * F.least(a, b) >= SIMILAR * F.greatest(a, b)


def _first_pairs(keyed: DataFrame, order) -> DataFrame:
    """For each class, of the first members by ``order`` in its bands and in other components, the one
    it shares most bands with: ``a`` (that member), ``b``."""
    leaders = (
        keyed.groupBy("band")
        .agg(F.min_by(F.struct("id", "n", "component"), order).alias("lead"),
             F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("band", "lead")
    )
    return (
        keyed.join(leaders, "band")
        .where((F.col("component") != F.col("lead.component")) & (F.col("id") != F.col("lead.id")) & _sizes_fit("n", "lead.n"))
        .groupBy("id", "lead.id")
        .agg(F.count("*").alias("shared"))
        .toDF("b", "a", "shared")
        .groupBy("b")
        .agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
        .select("a", "b")
    )


def _open_groups(keyed: DataFrame, component: DataFrame) -> DataFrame:
    """Rows of ``keyed`` (``band, number, id, n``) with their component, for bands held by several components."""
    labelled = keyed.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = (
        labelled.groupBy("band")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"),
             F.count("*").alias("members"), F.sum("n").alias("shingles"))
        .where("low <> high")
        .select("band", "members", "shingles")
    )
    return labelled.join(mixed, "band")


MEMBER = ("band", "number", "id", "n", "component")


def _dealt(rows: DataFrame, group: int) -> DataFrame:
    """``MEMBER`` rows of groups of any size with ``task`` and ``side``, for every pair of a group's blocks.

    A component that fills several blocks has them for itself, so that none is compared with another.
    Sides 1 and 2 are compared with each other, side 0 with itself.
    """
    parts = F.ceil(F.greatest(F.col("m") / max(1, group // 3), F.col("s") / (GROUP_SHINGLES // 3)))
    count = (F.sum("m").alias("m"), F.sum("s").alias("s"))
    counted = rows.select(*MEMBER, F.lit(1).alias("m"), F.col("n").alias("s")).groupBy("band", "component").agg(*count)
    counted = counted.withColumn("owned", parts > 1).withColumn("owner", F.when(F.col("owned"), F.col("component")).otherwise(0))
    shares = counted.groupBy("band", "owned", "owner").agg(*count).withColumn("parts", parts)
    place = counted.select("band", "component", "owned", "owner").join(
        shares.select("band", "owned", "owner", "parts"), ["band", "owned", "owner"]
    )
    block = F.struct("owned", "owner", F.pmod(F.xxhash64("id"), F.col("parts")).alias("slot")).alias("block")
    members = rows.select(*MEMBER).join(place, ["band", "component"]).select(*MEMBER, block)
    slots = shares.select("band", "owned", "owner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("slot"))
    low = slots.select("band", F.struct("owned", "owner", "slot").alias("x"))
    tasks = low.join(low.withColumnRenamed("x", "y"), "band").where(
        (F.col("x") <= F.col("y")) & ~(F.col("x.owned") & F.col("y.owned") & (F.col("x.owner") == F.col("y.owner")))
    )
    tasks = tasks.withColumn("task", F.xxhash64("x", "y"))
    sides = tasks.select("band", "task", F.col("x").alias("block"), F.when(F.col("x") == F.col("y"), 0).otherwise(1).alias("side"))
    sides = sides.unionByName(tasks.where("x <> y").select("band", "task", F.col("y").alias("block"), F.lit(2).alias("side")))
    return members.join(sides, ["band", "block"]).select(*MEMBER, "task", "side")


def _candidates(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Per row of a task the later rows in other components whose sketches agree well enough.

    Every pair belongs to one group only, that of the first band which the pair shares.
    """
    ids, component, n, side = (frame[c].to_numpy() for c in ("id", "component", "n", "side"))
    bands = np.stack(frame["bands"].to_numpy())[:, : frame["number"].iloc[0] + 1]
    table = np.frombuffer(b"".join(frame["bytes"]), np.uint8).reshape(len(frame), BINS)
    for i in range(len(frame) - 1):
        apart = (component[i + 1 :] != component[i]) & (ids[i + 1 :] != ids[i])
        if side[i]:
            apart &= side[i + 1 :] != side[i]
        others = np.flatnonzero(apart) + i + 1
        low, high = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
        others = others[100 * low >= SIMILAR * high]
        others = others[(bands[others] == bands[i]).sum(axis=1) == 1]
        if len(others):
            others = others[(table[others] == table[i]).mean(axis=1) >= ESTIMATE]
            if len(others):
                yield i, others


def _mark_group(frame: pd.DataFrame) -> pd.DataFrame:
    """The members of a task that stand in a candidate pair."""
    frame = frame.sort_values("id", kind="stable")
    marked = np.zeros(len(frame), bool)
    for i, others in _candidates(frame):
        marked[i] = marked[others] = True
    return frame.loc[marked, ["band", "task", "id"]].drop_duplicates()


def _link_group(frame: pd.DataFrame) -> pd.DataFrame:
    """Links between components of a task, each confirmed on full sets; no more than join its components."""
    frame = frame.sort_values("id", kind="stable")
    ids, component, sets = (frame[c].to_numpy() for c in ("id", "component", "shingles"))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for i, others in _candidates(frame):
        for j in others.tolist():
            if root(component[i]) != root(component[j]):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= SIMILAR * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(component[j])] = root(component[i])
                    links.append((ids[i], ids[j]))
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def _remaining_links(
    docs: DataFrame, classes: DataFrame, component: DataFrame, group: int, id_col: str, text_col: str
) -> DataFrame:
    """Links between components, searched for completely over all bands.

    Pairs are formed and confirmed inside a task and never leave it; full sets are sent only to tasks,
    and only of members, that hold a candidate pair.
    """
    # An empty frame of local rows would start Python workers of their own in every executor.
    found = classes.sparkSession.range(0, 0, 1, 1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    keyed = classes.select("id", F.posexplode("bands").alias("number", "band"), "n")
    rows = StoredTable(_open_groups(keyed, component), "open-bands").df
    large = (F.col("members") > group) | (F.col("shingles") > GROUP_SHINGLES)
    within = rows.where(~large).select(*MEMBER, F.lit(0).cast("long").alias("task"), F.lit(0).alias("side"))
    apart = rows.where(large).select(*MEMBER)
    for leader in range(LEADERS):
        if not apart.limit(1).count():
            break
        pairs = StoredTable(_first_pairs(apart, F.xxhash64("id", F.lit(leader))), "pairs").df
        joined = StoredTable(confirm(docs, pairs, id_col, text_col), "links").df
        found = found.unionByName(joined)
        joined = joined.unionByName(component.select(F.col("id").alias("a"), F.col("component").alias("b")))
        component = connected_components(joined).select(F.col("node").alias("id"), "component")
        apart = StoredTable(_open_groups(apart.drop("component"), component).select(*MEMBER), "open-bands").df
    if apart.limit(1).count():
        within = within.unionByName(StoredTable(_dealt(apart, group), "blocks").df)
    within = within.join(classes.select("id", "bands", "bytes"), "id")
    marked = StoredTable(
        within.groupBy("band", "task").applyInPandas(_mark_group, "band long, task long, id long"), "marked"
    ).df
    if marked.limit(1).count():
        sets = stored_sets(docs, marked.select("id").distinct(), id_col, text_col)
        members = within.join(marked, ["band", "task", "id"], "left_semi").join(sets, "id")
        found = found.unionByName(members.groupBy("band", "task").applyInPandas(_link_group, "a long, b long"))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` and ``kept`` for every row."""
    sketches = StoredTable(sketch_documents(docs, id_col, text_col), "sketches").df
    sets = sketches.where("id is not null and n > 0")
    same = sets.groupBy("n", "set_key", "set_check").agg(F.min("id").alias("class_id"), F.max("id").alias("other"))
    copied = same.where("class_id <> other").drop("other")
    copies = StoredTable(
        sets.select("id", "n", "set_key", "set_check")
        .join(copied, ["n", "set_key", "set_check"])
        .where("id <> class_id")
        .select(F.col("class_id").alias("a"), F.col("id").alias("b"), "set_key")
        .distinct(),
        "copies",
    ).df
    drop = copies.select(F.col("b").alias("id"), "set_key")
    classes = sets.join(F.broadcast(drop) if _few(drop) else drop, ["id", "set_key"], "left_anti")
    classes = StoredTable(classes.select("id", "n", "bands", "bytes"), "classes").df
    keyed = classes.select(F.explode("bands").alias("band"), "id", "n", F.col("id").alias("component"))

    first = confirm(docs, StoredTable(_first_pairs(keyed, F.col("id")), "pairs").df, id_col, text_col)
    links = StoredTable(first, "links").df
    component = connected_components(links).select(F.col("node").alias("id"), "component")
    more = _remaining_links(docs, classes, component, group, id_col, text_col)
    edges = links.unionByName(more).unionByName(copies.select("a", "b"))
    final = connected_components(edges)
    final = F.broadcast(final) if _few(final) else final
    return sketches.join(final, sketches.id == final.node, "left").select(
        "id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("component", "id") == F.col("id")).alias("kept"),
    ).withColumn("kept", F.coalesce("kept", F.lit(True)))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows that stay: one document of each component."""
    marks = near_duplicates(docs, id_col, text_col)
    gone = StoredTable(marks.where("not kept").select(F.col("id").alias("gone")).distinct(), "dropped").df
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    own = plain[f"c{docs.columns.index(id_col)}"].cast("long")
    left = plain.join(F.broadcast(gone) if _few(gone) else gone, own == gone["gone"], "left_anti")
    return left.toDF(*docs.columns)
