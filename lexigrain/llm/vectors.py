"""Integer vectors in compact rows, and visits of queries to bounded shards of candidates.

Candidates are dealt evenly into shards and queries into blocks; a task gets one shard and one block, so its
memory is bounded by ``SHARD_ROWS`` and ``BLOCK_ROWS`` whatever the tables hold, and a vector, label or id that
makes up a third of the rows is spread like any other. Every query first visits one shard, its home; the bound
that it brings back prunes the visits to all other shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lexigrain.storage import StoredTable

SHARD_ROWS = 16_384
#: Shards are made smaller than that, down to this size, as long as there are fewer of them than shuffle partitions.
LEAST_SHARD_ROWS = 1_024
BLOCK_ROWS = 16_384
#: Integers up to here are exact in doubles.
_EXACT = 1 << 53
_LONG = (1 << 63) - 1


def integer_vectors(rows: DataFrame, vector: Column, keep: dict[str, Column], scale: float = 256.0) -> DataFrame:
    """``keep``, ``dim`` and ``data`` of rows whose vector is complete: ``floor(scale * x)`` of each component.

    Vectors that are null or hold null or non-finite components (before or after scaling) are left out.
    ``data`` has 16-bit integers, or doubles if they do not fit.
    """
    narrow = rows.select(*(c.alias(k) for k, c in keep.items()), vector.cast("array<double>").alias("_v"))
    names, width = [*keep, "dim", "data"], len(keep)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(width)
            parts = pc.list_flatten(lists)
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.floor(parts.fill_null(np.nan).to_numpy(zero_copy_only=False) * scale)
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            whole = lists.is_valid().to_numpy(zero_copy_only=False)
            row_of = np.repeat(np.arange(len(sizes)), sizes)
            whole[row_of[~np.isfinite(values)]] = False
            data, at = [], 0
            for size, good in zip(sizes.tolist(), whole.tolist()):
                if good:
                    own = values[at : at + size]
                    small = size == 0 or np.abs(own).max() < 32_768
                    data.append(own.astype("<i2" if small else "<f8").tobytes())
                at += size
            kept = pa.array(whole)
            yield pa.RecordBatch.from_arrays(
                [c.filter(kept) for c in batch.columns[:width]] + [pa.array(sizes[whole], pa.int32()), pa.array(data, pa.binary())],
                names=names,
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(pack, f"{kinds}, dim int, data binary")


def unpack(dim: int, data: list[bytes]) -> np.ndarray:
    """Rows of ``data`` as doubles."""
    out = np.empty((len(data), dim))
    for i, row in enumerate(data):
        out[i] = np.frombuffer(row, "<i2" if len(row) == 2 * dim else "<f8")
    return out


def by_dim(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers per vector length."""
    dims = table.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, np.flatnonzero(dims == dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with the rows of ``b`` as exact 64-bit integers.

    Products outside that range are held at its ends.
    """
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    if most < _LONG / 2 and np.abs(a).max() < _EXACT and np.abs(b).max() < _EXACT:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    held = [[max(-_LONG, min(_LONG, s)) for s in row] for row in whole]
    return np.array(held, np.int64).reshape(len(a), len(b))


def above(bound: np.ndarray) -> np.ndarray:
    """A bound on a product, moved up by more than its rounding error; one that overflows bounds nothing."""
    return np.nan_to_num(bound + 1 + np.abs(bound) * 1e-9, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def first_of_each(group: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of each group's ``k`` highest scores, ties by smaller key; ordered by group and rank."""
    order = np.lexsort((key, -score, group))
    sorted_group = group[order]
    starts = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]]) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


Visit = Callable[[pa.Table, pa.Table], pa.Table]


@dataclass
class Shards:
    """Candidates dealt into shards. The stored rows have a number ``uid`` of their own each."""

    stored: StoredTable
    n_shards: int

    @classmethod
    def of(cls, stored: StoredTable, shard_rows: int = SHARD_ROWS, least_rows: int = LEAST_SHARD_ROWS) -> "Shards":
        n = stored.df.count()
        tasks = int(stored.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cls(stored, max(1, -(-n // shard_rows), min(-(-n // least_rows), tasks)))

    def _rows(self) -> DataFrame:
        """The rows with columns of their own, as queries come from the same table."""
        return self.stored.df.sparkSession.read.schema(self.stored.df.schema).parquet(self.stored.path)

    def _place(self, salt: int, n: int) -> Column:
        return F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(n)).cast("int")

    def visit_home(self, queries: DataFrame, visit: Visit, schema: str) -> DataFrame:
        """Each query with the candidates of its home shard."""
        candidates = self._rows().withColumn("shard", self._place(1, self.n_shards)).withColumn("block", F.lit(0))
        # A shard is home to as many queries as there are candidates to a shard at most.
        callers = queries.withColumn("shard", self._place(2, self.n_shards)).withColumn("block", F.lit(0))
        return self._meet(candidates, callers, 1, visit, schema)

    def visit_others(self, queries: DataFrame, n_queries: int, visit: Visit, schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """Each query with the candidates of all other shards, in blocks of queries."""
        n_blocks = max(1, -(-n_queries // block_rows))
        candidates = self._rows().withColumn("shard", self._place(1, self.n_shards)).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
        )
        callers = (
            queries.withColumn("home", self._place(2, self.n_shards))
            .withColumn("block", self._place(3, n_blocks))
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.n_shards - 1))))
            .where("shard <> home")
            .drop("home")
        )
        return self._meet(candidates, callers, n_blocks, visit, schema)

    def _meet(self, candidates: DataFrame, callers: DataFrame, n_blocks: int, visit: Visit, schema: str) -> DataFrame:
        tasks = min(self.n_shards * n_blocks, 20_000)
        left = candidates.repartition(tasks, "shard", "block").groupBy("shard", "block")
        right = callers.repartition(tasks, "shard", "block").groupBy("shard", "block")

        def meet(own: pa.Table, asking: pa.Table) -> pa.Table:
            return visit(own.combine_chunks(), asking.combine_chunks())

        return left.cogroup(right).applyInArrow(meet, schema)
