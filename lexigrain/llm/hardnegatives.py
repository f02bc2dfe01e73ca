"""Hard-negative mining with bounds along a spanning tree of the anchors.

Anchors are joined by a minimum spanning tree of their distances, in trees of ``TREE_ANCHORS`` neighbours. The
tree's root is scored against all candidates of a shard. If an anchor lies at distance ``d`` from its parent,
its score with a candidate ``c`` differs from the parent's by at most ``d |c|``; so every candidate has an
interval, and only those whose interval overlaps the window that matters are scored again. The others pass their
interval, widened by the next edge, on to the anchor's children.

The window of a positive search reaches from the k-th best score known upwards. The window of a negative search
is the contract's share of the positive's score, from the last of the best ones found so far upwards. Both known
scores come from a visit to the anchor's home shard (see ``vectors``) and are shared with all other shards.

Defined results: rows with a null id, a null label, or a vector that is null or holds null or non-finite
components take no part. Rows of an anchor's own id are neither its positives nor its negatives. Repeated rows
are candidates, and anchors, each for itself. Vectors are compared with vectors of their own length; scores
beyond 64 bits are held at the end of that range. Ties go to the smaller id. An anchor without positives and a
positive without negatives in its window give no rows. Only the id, vector and label columns are read, and an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigrain.llm.vectors import (
    BLOCK_ROWS,
    SHARD_ROWS,
    Shards,
    above,
    by_dim,
    first_of_each,
    integer_vectors,
    products,
    unpack,
)
from lexigrain.storage import StoredTable

TREE_ANCHORS = 256
POSITIVES = 5
NEGATIVES = 3
_LOWEST = -(1 << 63)
FOUND = "anchor_uid long, anchor_id long, positive_id long, positive_score long, place int, id long, score long"


def spanning_tree(points: np.ndarray) -> list[tuple[int, int, float]]:
    """Prim's tree over all points from the first one on: ``(point, parent, distance)``; the root's parent is -1.

    Parents stand before their children.
    """
    n = len(points)
    nearest = np.full(n, np.inf)
    parent = np.full(n, -1)
    left = np.ones(n, bool)
    order, here = [(0, -1, 0.0)], 0
    for _ in range(n - 1):
        left[here] = False
        away = np.sqrt(((points - points[here]) ** 2).sum(axis=1))
        closer = left & (away < nearest)
        nearest[closer], parent[closer] = away[closer], here
        here = int(np.where(left, nearest, np.inf).argmin()) if np.isfinite(nearest[left]).any() else int(left.argmax())
        order.append((here, int(max(parent[here], 0)), float(nearest[here])))
    return order


def scored_along_tree(anchors: np.ndarray, candidates: np.ndarray, window) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(anchor, rows, scores)`` for every anchor: the candidates whose interval overlaps its window, scored.

    ``window(anchor, middle, reach)`` says which candidates overlap, given that each score lies within
    ``reach`` of ``middle``. Intervals of an anchor are freed once its last child is done.
    """
    norms = np.sqrt((candidates**2).sum(axis=1))
    order = spanning_tree(anchors)
    children = np.bincount([p for _, p, _ in order[1:]], minlength=len(anchors))
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for anchor, parent, distance in order:
        if parent < 0:
            exact = products(candidates, anchors[anchor : anchor + 1])[:, 0]
            middle, path = exact.astype(float), np.zeros(len(candidates))
            rows = np.flatnonzero(window(anchor, middle, above(np.zeros(len(middle)))))
            scores = exact[rows]
        else:
            middle, path = kept[parent]
            children[parent] -= 1
            middle, path = (kept.pop(parent) if not children[parent] else (middle.copy(), path.copy()))
            path = path + distance
            reach = above(np.nan_to_num(path * norms, nan=np.inf)) + np.abs(middle) * 1e-9
            rows = np.flatnonzero(window(anchor, middle, reach))
            scores = products(candidates[rows], anchors[anchor : anchor + 1])[:, 0]
            middle[rows], path[rows] = scores, 0.0
        if children[anchor]:
            kept[anchor] = middle, path
        yield anchor, rows, scores


def _neighbour_order(points: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Anchors so that those of one label, and among them those close by, stand together."""
    far = points[((points - points[0]) ** 2).sum(axis=1).argmax()] - points[0]
    return np.lexsort((points @ far, labels))


class _Task:
    """The candidates and anchors of one length that meet in a task, anchors tree by tree."""

    def __init__(self, dim: int, own: pa.Table, asking: pa.Table):
        self.points = unpack(dim, own.column("data").to_pylist())
        self.ids, self.labels = own.column("id").to_numpy(), own.column("label").to_numpy()
        self.asking = asking
        self.anchors = unpack(dim, asking.column("data").to_pylist())
        self.names, self.own_labels = asking.column("id").to_numpy(), asking.column("label").to_numpy()

    def trees(self) -> Iterator[np.ndarray]:
        order = _neighbour_order(self.anchors, self.own_labels)
        for a in range(0, len(order), TREE_ANCHORS):
            yield order[a : a + TREE_ANCHORS]


def _tasks(own: pa.Table, asking: pa.Table) -> Iterator[_Task]:
    lengths = dict(by_dim(own)) if own.num_rows else {}
    for dim, who in by_dim(asking) if asking.num_rows else ():
        if dim in lengths:
            yield _Task(dim, own.take(lengths[dim]), asking.take(who))


def _table(rows: list[tuple[np.ndarray, ...]]) -> pa.Table:
    names = ["anchor_uid", "anchor_id", "positive_id", "positive_score", "place", "id", "score"]
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*rows) if rows else [()] * 7)]
    return pa.table({n: pa.array(c, pa.int32() if n == "place" else pa.int64()) for n, c in zip(names, columns)})


def _positives(k: int):
    """Visit that gives the anchors' best rows of their own label that reach ``floor``."""

    def visit(own: pa.Table, asking: pa.Table) -> pa.Table:
        rows = []
        for task in _tasks(own, asking):
            uids, floors = task.asking.column("uid").to_numpy(), task.asking.column("floor").to_numpy()
            for tree in task.trees():

                def window(i, middle, reach):
                    who = tree[i]
                    fitting = (task.labels == task.own_labels[who]) & (task.ids != task.names[who])
                    same = np.flatnonzero(fitting)
                    floor = float(floors[who])
                    if len(same) >= k:
                        # The k-th best of the likeliest rows is reached by the k best ones.
                        likely = same[np.argpartition(-middle[same], k - 1)[:k]]
                        sure = products(task.points[likely], task.anchors[who : who + 1])[:, 0].min()
                        floor = max(floor, float(sure) - abs(float(sure)) * 1e-9)
                    return fitting & (middle + reach >= floor)

                for i, at, scores in scored_along_tree(task.anchors[tree], task.points, window):
                    who = tree[i]
                    best = first_of_each(np.zeros(len(at), np.int64), scores, task.ids[at], k)
                    best = best[scores[best] >= floors[who]]
                    n = np.ones(len(best), np.int64)
                    rows.append((n * uids[who], n * task.names[who], n * 0, n * 0, n * 0, task.ids[at[best]], scores[best]))
        return _table(rows)

    return visit


def window_of(positive: int, low_percent: int, high_percent: int) -> tuple[int, int]:
    """Least and largest integer score between the two shares of a positive's score."""
    return -(-low_percent * positive // 100), high_percent * positive // 100


def _negatives(k: int, low_percent: int, high_percent: int):
    """Visit that gives, per anchor and positive, the best rows of other labels inside the window."""

    def visit(own: pa.Table, asking: pa.Table) -> pa.Table:
        rows = []
        for task in _tasks(own, asking):
            uids = task.asking.column("uid").to_numpy()
            positives = task.asking.column("positives").to_pylist()
            for tree in task.trees():
                windows = []  # per anchor: (place, positive's id, its score, least and largest score)
                for who in tree:
                    own_windows = []
                    for p in positives[who]:
                        low, high = window_of(p["score"], low_percent, high_percent)
                        low = max(low, p["floor"])
                        if low <= high:
                            own_windows.append((p["place"], p["id"], p["score"], low, high))
                    windows.append(own_windows)

                def window(i, middle, reach):
                    if not windows[i]:
                        return np.zeros(len(middle), bool)
                    low, high = min(w[3] for w in windows[i]), max(w[4] for w in windows[i])
                    return (task.labels != task.own_labels[tree[i]]) & (middle + reach >= low) & (middle - reach <= high)

                for i, at, scores in scored_along_tree(task.anchors[tree], task.points, window):
                    who = tree[i]
                    other = task.ids[at] != task.names[who]
                    at, scores = at[other], scores[other]
                    order = np.lexsort((task.ids[at], -scores))
                    falling = -scores[order]  # rising
                    for place, positive, value, low, high in windows[i]:
                        first = np.searchsorted(falling, -high, "left")
                        stop = min(first + k, np.searchsorted(falling, -low, "right"))
                        best = order[first:stop]
                        n = np.ones(len(best), np.int64)
                        rows.append(
                            (n * uids[who], n * task.names[who], n * positive, n * value, n * place, task.ids[at[best]], scores[best])
                        )
        return _table(rows)

    return visit


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_uid", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: float = 256.0,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For each of an anchor's ``positives`` best rows of the same label, the ``negatives`` best rows of other labels
    whose score lies between the two shares of the positive's score.
    """
    keep = {"id": F.col(id_col).cast("long"), "label": label.cast("long"), "asks": F.coalesce(is_anchor, F.lit(False))}
    given = rows.where(F.col(id_col).isNotNull() & label.isNotNull())
    clean = integer_vectors(given, F.col(vector_col), keep, scale)
    stored = StoredTable(clean.withColumn("uid", F.monotonically_increasing_id()), "mining-vectors")
    shards = Shards.of(stored, shard_rows)
    anchors = stored.df.where("asks").select("uid", "id", "label", "dim", "data")
    n_anchors = anchors.count()
    lowest = F.lit(_LOWEST).cast("long")

    # The best rows of the same label: at home, then elsewhere from the k-th score on.
    visit = _positives(positives)
    home = StoredTable(shards.visit_home(anchors.withColumn("floor", lowest), visit, FOUND), "mining-home")
    same = home.df
    if shards.n_shards > 1:
        reached = (
            same.groupBy(F.col("anchor_uid").alias("own"))
            .agg(F.count("*").alias("got"), F.min("score").alias("kth"))
            .where(F.col("got") >= positives)
        )
        asking = anchors.join(reached, anchors["uid"] == reached["own"], "left").select(
            *anchors.columns, F.coalesce("kth", lowest).alias("floor")
        )
        same = same.unionByName(shards.visit_others(asking, n_anchors, visit, FOUND, block_rows))
    chosen = StoredTable(
        _first(same, positives).select("anchor_uid", "rank", "id", "score"), "mining-positives"
    ).df

    # The best rows of other labels in each window: at home, then elsewhere from the last of them on.
    def asking_for(windows: DataFrame) -> DataFrame:
        listed = windows.groupBy(F.col("anchor_uid").alias("own")).agg(
            F.collect_list(F.struct(F.col("rank").alias("place"), "id", "score", "floor")).alias("positives")
        )  # at most ``positives`` of them
        return anchors.join(listed, anchors["uid"] == listed["own"]).select(*anchors.columns, "positives")

    visit = _negatives(negatives, low_percent, high_percent)
    home = StoredTable(shards.visit_home(asking_for(chosen.withColumn("floor", lowest)), visit, FOUND), "mining-home")
    found = home.df
    if shards.n_shards > 1:
        reached = (
            found.groupBy(F.col("anchor_uid").alias("own"), F.col("place").alias("at"))
            .agg(F.count("*").alias("got"), F.min("score").alias("kth"))
            .where(F.col("got") >= negatives)
        )
        narrowed = chosen.join(
            reached, (chosen["anchor_uid"] == reached["own"]) & (chosen["rank"] == reached["at"]), "left"
        ).select(*chosen.columns, F.coalesce("kth", lowest).alias("floor"))
        found = found.unionByName(shards.visit_others(asking_for(narrowed), n_anchors, visit, FOUND, block_rows))
    return _first(found, negatives).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
