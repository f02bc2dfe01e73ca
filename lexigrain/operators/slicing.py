"""Cutting an ordered corpus by UTF-8 byte budget, and accounting for the bytes used.

A budget needs a running byte sum along the order, which as one unpartitioned window would run on a
single task. Here only ``(order, size)`` pairs are laid out in ranges of the order column; the per-range
totals (one row per range) locate the range holding a boundary, and only that range is scanned for the
boundary row. The corpus is sized in steps that double, each a filter on the order column that reaches the
file scan, and only as far as the budgets ask. The text itself is never shuffled: a slice is a filter on
the order column plus a cut of its last row.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from lexigrain.functions.text import MAX_BOUNDARY_LOSS, is_nonempty, utf8_bytes, utf8_prefix
from lexigrain.storage import StoredTable, path_exists, store

ROWS_PER_RANGE = 500_000
PROGRESS_BYTES = 500_000_000
#: The first step covers about 2 ** -STEPS of the rows; each further one as much as all before.
STEPS = 10
#: Order values drawn to place the steps. They steer how much is sized at a time, never a result.
STEP_SAMPLE = 2_000

_RANGE = "__range"
_MEASURES = {"n_bytes", "bytes_before", "documents_before", "bytes_end", "bytes_used", "documents_used"}


@dataclass(frozen=True)
class Position:
    """A point between two rows: the last row consumed, and the whole bytes and rows before the next one."""

    last: tuple | None = None
    byte_offset: int = 0
    row_offset: int = 0


@dataclass(frozen=True)
class CorpusStats:
    bytes_used: int
    documents_used: int


class OrderedCorpus:
    """A corpus with a unique order (one or more columns) and its byte layout along that order.

    Order values must be unique and not null, as rows could not be told apart at a boundary otherwise; rows
    that break this raise an error as soon as they are sized.

    With a ``layout`` folder the sizes of a corpus read from files are kept there, under a name that follows from
    the files' paths, sizes and times and from the order. Another run over the same files takes them from there and
    reads no text to find a boundary; changed files have another name, so their sizes are taken anew.
    """

    def __init__(
        self,
        corpus: DataFrame,
        order_by: list[str],
        text: str = "text",
        rows_per_range: int = ROWS_PER_RANGE,
        layout: str | None = None,
    ):
        if clash := _MEASURES & set(order_by):
            raise ValueError(f"order columns may not be named {', '.join(sorted(clash))}")
        self.order_by = list(order_by)
        self.text = text
        self.rows_per_range = rows_per_range
        self.rows = corpus.where(is_nonempty(F.col(text))).select(*self.order_by, text)
        keys = corpus.select(*self.order_by)
        unordered = " OR ".join(f"`{c}` IS NULL" for c in self.order_by)
        if not keys.where(unordered).isEmpty():
            raise ValueError(f"the order columns {', '.join(self.order_by)} hold nulls")
        self._sized: list[DataFrame] = []
        self._parts: list[tuple[int, int]] = []  # bytes and documents of each range
        self._ends: list[int] = []
        self._kept = layout and f"{layout}/{self._fingerprint(corpus)}"
        if self._kept and path_exists(corpus.sparkSession, f"{self._kept}/bounds/_SUCCESS"):
            self._read_layout()
        else:
            self._bounds = self._step_bounds(keys.select(self.order_by[0]))
            if self._kept:
                self._keep_bounds()

    def _fingerprint(self, corpus: DataFrame) -> str:
        """A name for the corpus' files as they are now, and for how they are laid out."""
        file = corpus.select(*(F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_size", "file_modification_time")))
        found = file.distinct().agg(F.count("*").alias("n"), F.sum(F.xxhash64("*").cast("decimal(20,0)")).alias("files")).first()
        return uuid.uuid5(uuid.NAMESPACE_OID, f"{found} {self.order_by} {self.text} {self.rows_per_range}").hex

    def _bound_schema(self) -> T.StructType:
        return T.StructType([T.StructField("step", T.IntegerType()), T.StructField("bound", self.rows.schema[self.order_by[0]].dataType)])

    def _keep_bounds(self) -> None:
        spark = self.rows.sparkSession
        spark.createDataFrame(list(enumerate(self._bounds)), self._bound_schema()).write.parquet(f"{self._kept}/bounds")

    def _read_layout(self) -> None:
        """The steps that earlier runs sized, as far as they are complete."""
        spark = self.rows.sparkSession
        self._bounds = [r["bound"] for r in spark.read.schema(self._bound_schema()).parquet(f"{self._kept}/bounds").orderBy("step").collect()]
        for step in range(len(self._bounds)):
            path = f"{self._kept}/step-{step}"
            if not path_exists(spark, f"{path}/_SUCCESS"):
                return
            self._add_step(spark.read.parquet(path))

    def _step_bounds(self, first: DataFrame) -> list:
        """Upper bounds of the sizing steps; the last step has none."""
        n = first.count()
        if n <= self.rows_per_range:
            return [None]
        drawn = sorted(row[0] for row in first.sample(min(1.0, STEP_SAMPLE / n), seed=7).collect())
        picked = {drawn[len(drawn) >> k] for k in range(1, STEPS + 1) if len(drawn) >> k < len(drawn)} if drawn else ()
        return [*sorted(picked), None]

    def _grow(self) -> bool:
        """Sizes the next step; false if all is sized. This pass over the step's text is the only one."""
        done = len(self._sized)
        if done == len(self._bounds):
            return False
        first, rows = F.col(self.order_by[0]), self.rows
        if done:
            rows = rows.where(first > self._value(self._bounds[done - 1]))
        if self._bounds[done] is not None:
            rows = rows.where(first <= self._value(self._bounds[done]))
        seen = Observation()
        sized = rows.select(*self.order_by, utf8_bytes(F.col(self.text)).alias("n_bytes"))
        sizes = StoredTable(sized.observe(seen, F.count("*").alias("n")), "sizes")
        n_ranges = max(1, ceil(seen.get["n"] / self.rows_per_range))
        ranged = sizes.df.repartitionByRange(n_ranges, *self.order_by) if n_ranges > 1 else sizes.df.repartition(1)
        laid = ranged.withColumn(_RANGE, F.spark_partition_id() + len(self._parts))
        if self._kept:
            path = f"{self._kept}/step-{done}"
            laid.write.mode("overwrite").parquet(path)
            laid = laid.sparkSession.read.schema(laid.schema).parquet(path)
        else:
            laid = store(laid, "ranges")
        self._add_step(laid)
        sizes.drop()
        return True

    def _add_step(self, laid: DataFrame) -> None:
        """Takes in a step's sizes; equal order values lie in one range, next to each other."""
        beside = Window.partitionBy(_RANGE).orderBy(*self.order_by)
        key = F.struct(*self.order_by)
        found = (
            laid.withColumn("again", F.lag(key).over(beside) == key)
            .groupBy(_RANGE)
            .agg(
                F.sum("n_bytes").alias("bytes"),
                F.count("*").alias("documents"),
                F.max(F.when(F.col("again"), F.to_json(key))).alias("repeated"),
            )
            .orderBy(_RANGE)
            .collect()  # one row per range
        )
        for row in found:
            if row["repeated"] is not None:
                raise ValueError(f"the order {row['repeated']} stands on several rows")
            while len(self._parts) < row[_RANGE]:  # a range without rows
                self._add_range(0, 0)
            self._add_range(row["bytes"], row["documents"])
        if not found:
            self._add_range(0, 0)
        self._sized.append(laid)

    def _add_range(self, n_bytes: int, documents: int) -> None:
        self._ends.append((self._ends[-1] if self._ends else 0) + n_bytes)
        self._parts.append((n_bytes, documents))

    def _grow_to(self, target: int | None) -> None:
        """Sizes until the running sum reaches ``target``, or everything."""
        while (target is None or not self._ends or self._ends[-1] < target) and self._grow():
            pass

    @property
    def sizes(self) -> DataFrame:
        """``(order, n_bytes, range)`` of what is sized so far."""
        if not self._sized:
            self._grow()
        df = self._sized[0]
        for more in self._sized[1:]:
            df = df.unionByName(more)
        return df

    @property
    def total_bytes(self) -> int:
        self._grow_to(None)
        return self._ends[-1]

    def running_totals(self, target: int | None = None) -> DataFrame:
        """Per row: its size and the bytes and documents before it, by a two-level prefix sum.

        With a ``target`` at least the rows up to that running sum are there.
        """
        self._grow_to(target)
        before = Window.partitionBy(_RANGE).orderBy(*self.order_by).rowsBetween(Window.unboundedPreceding, -1)
        data, documents = [], 0
        for number, (part, end) in enumerate(zip(self._parts, self._ends)):
            data.append((number, end - part[0], documents))
            documents += part[1]
        offsets = self.rows.sparkSession.createDataFrame(
            data, f"{_RANGE} int, {_RANGE}_bytes bigint, {_RANGE}_documents bigint"
        )
        # One row per range, so the broadcast side stays small by construction.
        return self.sizes.join(F.broadcast(offsets), _RANGE).select(
            *self.order_by,
            "n_bytes",
            (F.col(f"{_RANGE}_bytes") + F.coalesce(F.sum("n_bytes").over(before), F.lit(0))).alias(
                "bytes_before"
            ),
            (F.col(f"{_RANGE}_documents") + F.count("*").over(before)).alias("documents_before"),
        )

    def _row_reaching(self, target: int):
        """The first row at whose end the running byte sum is at least ``target``."""
        self._grow_to(target)
        index = bisect_left(self._ends, target)
        if index == len(self._ends):
            return None
        start = self._ends[index] - self._parts[index][0]
        documents = sum(part[1] for part in self._parts[:index])
        running = Window.orderBy(*self.order_by).rowsBetween(Window.unboundedPreceding, 0)  # in one range
        return (
            self.sizes.where(F.col(_RANGE) == index)
            .withColumn("bytes_end", F.lit(start) + F.sum("n_bytes").over(running))
            .withColumn("documents_used", F.lit(documents) + F.count("*").over(running))
            .where(F.col("bytes_end") >= target)
            .orderBy(*self.order_by)
            .limit(1)
            .collect()[0]
        )

    def _key(self) -> Column:
        return F.col(self.order_by[0]) if len(self.order_by) == 1 else F.struct(*self.order_by)

    def _value(self, value) -> Column:
        return F.lit(value).cast(self.rows.schema[self.order_by[0]].dataType)

    def _literal(self, values: tuple) -> Column:
        types = {f.name: f.dataType for f in self.rows.schema.fields}
        parts = [F.lit(v).cast(types[c]).alias(c) for c, v in zip(self.order_by, values)]
        return parts[0] if len(parts) == 1 else F.struct(*parts)

    def _edge(self, max_bytes: int, start: Position) -> tuple[Position, int, int | None]:
        """Where a slice ends, its number of whole rows, and the bytes that fit of its cut row if it has one."""
        if max_bytes < 1:
            raise ValueError("a byte budget must be positive")
        target = start.byte_offset + max_bytes
        edge = self._row_reaching(target)
        if edge is None:
            documents = sum(part[1] for part in self._parts)
            return Position(self._last_key(), self._ends[-1], documents), documents - start.row_offset, None
        end = Position(tuple(edge[c] for c in self.order_by), edge["bytes_end"], edge["documents_used"])
        cut = edge["bytes_end"] > target
        room = target - (edge["bytes_end"] - edge["n_bytes"])
        return end, edge["documents_used"] - start.row_offset - cut, room if cut else None

    def take(self, max_bytes: int, start: Position = Position()) -> tuple[DataFrame, Position]:
        """Whole rows after ``start`` while bytes remain, the last one cut to fit.

        Returns the slice and the position after its boundary row; what the cut left of that row
        belongs to no slice.
        """
        end, _, room = self._edge(max_bytes, start)
        rows, first = self.rows, F.col(self.order_by[0])
        if start.last is not None:
            rows = rows.where((first >= self._value(start.last[0])) & (self._key() > self._literal(start.last)))
        if end.last is None:
            return rows, end
        rows = rows.where((first <= self._value(end.last[0])) & (self._key() <= self._literal(end.last)))
        if room is not None:
            text = F.col(self.text)
            rows = rows.withColumn(
                self.text,
                F.when(self._key() == self._literal(end.last), utf8_prefix(text, room)).otherwise(text),
            ).where(F.col(self.text) != "")
        return rows, end

    def _cut_size(self, end: Position, room: int | None) -> int:
        """Bytes left of the boundary row; reads that row alone."""
        if room is None:
            return 0
        row = (
            self.rows.where((F.col(self.order_by[0]) == self._value(end.last[0])) & (self._key() == self._literal(end.last)))
            .select(utf8_bytes(utf8_prefix(F.col(self.text), room)).alias("n"))
            .first()
        )
        return row["n"]

    def stats(self, max_bytes: int, start: Position = Position()) -> CorpusStats:
        """Bytes and documents of the slice, from the layout and the boundary row, without its text."""
        end, documents, room = self._edge(max_bytes, start)
        if room is None:
            return CorpusStats(end.byte_offset - start.byte_offset, documents)
        kept = self._cut_size(end, room)
        return CorpusStats(max_bytes - room + kept, documents + (kept > 0))

    def _last_key(self) -> tuple | None:
        descending = [F.col(c).desc() for c in self.order_by]
        row = self.sizes.orderBy(*descending).select(*self.order_by).first()
        return None if row is None else tuple(row)


def byte_budget_prefix(corpus: OrderedCorpus, max_bytes: int) -> DataFrame:
    """The first ``max_bytes`` bytes of the corpus as (order, text) rows."""
    return corpus.take(max_bytes)[0]


def heldout_slice(corpus: OrderedCorpus, skip_bytes: int, eval_bytes: int) -> DataFrame:
    """Skip a byte budget, then take the next one, starting at a whole row."""
    check_budgets(skip_bytes, eval_bytes)
    start = corpus.take(skip_bytes)[1] if skip_bytes else Position()
    return corpus.take(eval_bytes, start)[0]


def check_budgets(skip_bytes: int, eval_bytes: int) -> None:
    if skip_bytes < 0:
        raise ValueError("the skipped byte count cannot be negative")
    if eval_bytes < 1:
        raise ValueError("the evaluated byte count must be at least 1")


def corpus_stats(corpus: DataFrame, text: str = "text") -> DataFrame:
    """One row: bytes and documents in use, null and empty texts not counted."""
    return corpus.where(is_nonempty(F.col(text))).agg(
        F.coalesce(F.sum(utf8_bytes(F.col(text))), F.lit(0)).alias("bytes_used"),
        F.count("*").alias("documents_used"),
    )


def read_stats(corpus: DataFrame, text: str = "text") -> CorpusStats:
    row = corpus_stats(corpus, text).first()
    return CorpusStats(row["bytes_used"], row["documents_used"])


def require_documents(stats: CorpusStats) -> None:
    if stats.documents_used == 0:
        raise ValueError("the corpus holds no nonempty text within the size limit")


def shortfall_report(stats: DataFrame, requested: int) -> DataFrame:
    """Requested against used bytes; a loss up to an incomplete character is accepted."""
    missing = F.lit(requested).cast("bigint") - F.col("bytes_used")
    return stats.select(
        F.lit(requested).cast("bigint").alias("requested"),
        "bytes_used",
        missing.alias("shortfall"),
        (missing <= MAX_BOUNDARY_LOSS).alias("ok"),
    )


def require_bytes(stats: CorpusStats, requested: int, what: str) -> None:
    if stats.bytes_used < requested - MAX_BOUNDARY_LOSS:
        raise ValueError(
            f"the corpus ended before the requested {what}: {stats.bytes_used:,} of {requested:,} bytes"
        )


def progress_marks(corpus: OrderedCorpus, max_bytes: int, step: int = PROGRESS_BYTES) -> DataFrame:
    """One mark per row of the prefix that carries the running byte count across a multiple of ``step``."""
    end, _, room = corpus._edge(max_bytes, Position())
    kept = corpus._cut_size(end, room)
    size = F.col("n_bytes")
    rows = corpus.running_totals(max_bytes)
    if room is not None:
        at_edge = corpus._key() == corpus._literal(end.last)
        size = F.when(at_edge, kept).otherwise(size)
    after = F.col("bytes_before") + size
    crossed = F.floor(after / F.lit(step)) > F.floor(F.col("bytes_before") / F.lit(step))
    return rows.where((F.col("bytes_before") < max_bytes) & crossed).select(
        *corpus.order_by,
        after.alias("bytes_used"),
        F.lit(max_bytes).cast("bigint").alias("max_bytes"),
        (F.lit(100) * after / F.lit(max_bytes)).alias("pct"),
        (F.col("documents_before") + 1).alias("documents_used"),
    )
