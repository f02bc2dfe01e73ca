"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

Candidates are dealt into shards. In each shard a tree of balls is built over the vectors; for a query ``q`` a
ball with centre ``c`` and radius ``r`` holds no score above ``q.c + |q| r``. A query goes to the likeliest leaf
first, then descends into all balls whose bound reaches its k-th best score so far, and opens their leaves from
the highest bound on. It visits its home shard first; the k-th score found there is shared with the visits to all
other shards, so these open few leaves and send few rows. Bounds are moved up by more than their rounding error
and equal bounds are kept, so results are exact; scores are 64-bit integers.

Defined results: rows with a null id, and vectors that are null or hold null or non-finite components, take no
part. Rows of a query's own id are not among its answers. Vectors are compared with vectors of their own
length. Repeated rows are candidates, and queries, each for itself; scores beyond 64 bits are held at the end of
that range. Ties go to the smaller id. Only the id and vector columns are read, and an empty table gives no rows.
"""

from __future__ import annotations

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

LEAF_ROWS = 128
#: Queries searched together in a shard.
QUERIES_AT_ONCE = 512
FOUND = "query_uid long, query_id long, vec_id long, score long"


class BallTree:
    """Balls over the rows of ``points``, halved along the line between two far points down to the leaves.

    ``levels[i]`` has the centres and radii of all balls of a level and the parent of each; the leaves are the
    last level, and ``rows[j]`` has the row numbers of leaf ``j``.
    """

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        parts = [np.arange(len(points))]
        self.levels = [self._balls(points, parts, np.zeros(1, np.int64))]
        while max(map(len, parts)) > leaf_rows:
            halves, parents = [], []
            for i, rows in enumerate(parts):
                for half in self._halve(points, rows) if len(rows) > 1 else (rows,):
                    halves.append(half)
                    parents.append(i)
            parts = halves
            self.levels.append(self._balls(points, parts, np.array(parents)))
        self.rows = parts

    @staticmethod
    def _balls(points, parts, parents):
        centres = np.stack([points[rows].mean(axis=0) for rows in parts])
        radii = np.array([np.sqrt(((points[rows] - c) ** 2).sum(axis=1).max()) for rows, c in zip(parts, centres)])
        return centres, radii, parents

    @staticmethod
    def _halve(points, rows):
        own = points[rows]
        one = own[((own - own[0]) ** 2).sum(axis=1).argmax()]
        two = own[((own - one) ** 2).sum(axis=1).argmax()]
        order = np.argsort(own @ (one - two), kind="stable")
        return rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]

    def bounds(self, level: int, queries: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of queries (rows) in the balls of a level (columns)."""
        centres, radii, _ = self.levels[level]
        return above(queries @ centres.T + np.outer(lengths, radii))


class _Best:
    """The k best candidates so far of each query of a chunk."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.kth = floor.copy()  # a score that the k-th best one reaches, as far as it is known
        self.query = np.zeros(0, np.int64)
        self.vec_id = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)

    def add(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        query, vec_id, score = (
            np.concatenate([old, *(f[i] for f in found)]) for i, old in enumerate((self.query, self.vec_id, self.score))
        )
        best = first_of_each(query, score, vec_id, self.k)
        self.query, self.vec_id, self.score = query[best], vec_id[best], score[best]
        full = np.bincount(self.query, minlength=len(self.ids)) == self.k
        last = np.flatnonzero(np.r_[self.query[1:] != self.query[:-1], True]) if len(self.query) else best
        last = last[full[self.query[last]]]
        self.kth[self.query[last]] = np.maximum(self.kth[self.query[last]], self.score[last])


def _open(tree: BallTree, points, ids, queries, best: _Best, asking: np.ndarray, leaf: np.ndarray) -> None:
    """Scores the pairs (query ``asking[i]``, leaf ``leaf[i]``), leaf by leaf."""
    order = np.argsort(leaf, kind="stable")
    found = []
    for group in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1) if len(order) else ():
        rows, who = tree.rows[leaf[group[0]]], asking[group]
        scores = products(queries[who], points[rows])
        other = best.ids[who][:, None] != ids[rows][None, :]
        at, row = np.nonzero(other & (scores >= best.kth[who][:, None]))
        found.append((who[at], ids[rows[row]], scores[at, row]))
    best.add(found)


def search(tree: BallTree, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, best: _Best) -> None:
    """Fills ``best`` with what the tree's points add."""
    n = len(queries)
    lengths = np.sqrt((queries**2).sum(axis=1))
    last = len(tree.levels) - 1
    # The likeliest leaf gives a first bound to queries that bring none.
    place = np.zeros(n, np.int64)
    for level in range(1, last + 1):
        centres, radii, parents = tree.levels[level]
        child = np.searchsorted(parents, place)  # balls of a level stand in the order of their parents
        second = np.minimum(child + 1, len(parents) - 1)
        second = np.where(parents[second] == place, second, child)
        one = (queries * centres[child]).sum(axis=1) + lengths * radii[child]
        two = (queries * centres[second]).sum(axis=1) + lengths * radii[second]
        place = np.where(two > one, second, child)
    _open(tree, points, ids, queries, best, np.arange(n), place)
    alive = np.ones((n, 1), bool)
    for level in range(last + 1):
        parents = tree.levels[level][2]
        bound = tree.bounds(level, queries, lengths)
        alive = alive[:, parents] & (bound >= best.kth[:, None])
    alive[np.arange(n), place] = False  # opened already
    # Leaves from the highest bound on, twice as many in each round, while their bound reaches the k-th score.
    order = np.argsort(np.where(alive, -bound, np.inf), axis=1, kind="stable")
    start, width = 0, 1
    while start < order.shape[1]:
        part = order[:, start : start + width]
        row = np.arange(n)[:, None]
        going = alive[row, part] & (bound[row, part] >= best.kth[:, None])
        if not going.any():
            break  # bounds only fall along the order
        asking, column = np.nonzero(going)
        _open(tree, points, ids, queries, best, asking, part[asking, column])
        start, width = start + width, 2 * width


def _visit(k: int, leaf_rows: int):
    def visit(own: pa.Table, asking: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], []]
        lengths = dict(by_dim(own)) if own.num_rows else {}
        for dim, who in by_dim(asking) if asking.num_rows else ():
            if dim not in lengths:
                continue
            rows = own.take(lengths[dim])
            points, ids = unpack(dim, rows.column("data").to_pylist()), rows.column("id").to_numpy()
            tree = BallTree(points, leaf_rows)
            callers = asking.take(who)
            queries = unpack(dim, callers.column("data").to_pylist())
            uids, names = callers.column("uid").to_numpy(), callers.column("id").to_numpy()
            floor = callers.column("floor").to_numpy()
            for a in range(0, len(queries), QUERIES_AT_ONCE):
                part = slice(a, a + QUERIES_AT_ONCE)
                best = _Best(names[part], floor[part], k)
                search(tree, points, ids, queries[part], best)
                for column, values in zip(columns, (uids[part][best.query], names[part][best.query], best.vec_id, best.score)):
                    column.append(values)
        names = ["query_uid", "query_id", "vec_id", "score"]
        return pa.table({n: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for n, c in zip(names, columns)})

    return visit


def _best_rows(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of every row that ``is_query`` marks."""
    keep = {"id": F.col(id_col).cast("long"), "asks": F.coalesce(is_query, F.lit(False))}
    clean = integer_vectors(rows.where(F.col(id_col).isNotNull()), F.col(vector_col), keep, scale)
    stored = StoredTable(clean.withColumn("uid", F.monotonically_increasing_id()), "search-vectors")
    shards = Shards.of(stored, shard_rows)
    queries = stored.df.where("asks").select("uid", "id", "dim", "data")
    visit = _visit(k, leaf_rows)
    lowest = F.lit(-(1 << 63)).cast("long")
    home = StoredTable(shards.visit_home(queries.withColumn("floor", lowest), visit, FOUND), "search-home")
    found = home.df
    if shards.n_shards > 1:
        reached = (
            home.df.groupBy(F.col("query_uid").alias("own"))
            .agg(F.count("*").alias("got"), F.min("score").alias("kth"))
            .where(F.col("got") >= k)
        )
        bound = queries.join(reached, queries["uid"] == reached["own"], "left").select(
            *queries.columns, F.coalesce("kth", lowest).alias("floor")
        )
        others = shards.visit_others(bound, queries.count(), visit, FOUND, block_rows)
        found = found.unionByName(others)
    return _best_rows(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
