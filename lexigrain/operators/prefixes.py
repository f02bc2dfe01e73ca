"""Compression as a function of vocabulary size, for all prefixes of one merge list.

Encoding with the full list meets the same merges in the same order as encoding with a prefix, up to
the first one outside the prefix. Recording per word the highest rank applied so far ("effective
rank") therefore gives every prefix from one pass:
``tokens(V) = symbols before merging - merges with effective rank below V - base``.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexigrain.operators.encoding import encode_word_types, merge_events, start_size
from lexigrain.operators.model import BpeModel
from lexigrain.operators.scoring import with_ratios
from lexigrain.storage import store

VOCAB_STEP = 16_000
RANKS_PER_BLOCK = 1_024


def vocabulary_grid(model: BpeModel, step: int = VOCAB_STEP) -> DataFrame:
    """``(vocab_size)``: multiples of the step from the base size on, and the full size."""
    return size_grid(model.vocab.sparkSession, model.base_size, model.vocab_size, step)


def size_grid(spark: SparkSession, base: int, full: int, step: int) -> DataFrame:
    if step < 1:
        raise ValueError("the vocabulary step must be at least 1")
    sizes = spark.range(max(step, base), full + 1, step).union(spark.range(full, full + 1))
    return sizes.distinct().select(F.col("id").cast("int").alias("vocab_size"))


def prefix_sweep(
    words: DataFrame, model: BpeModel, grid: DataFrame, text_bytes: int, events: DataFrame | None = None
) -> DataFrame:
    """One measurement point per size of ``grid``, from one encoding with the full model.

    ``events`` are merge events of these words if they are known already, by whichever way of encoding.

    The plan does not grow with the grid. A merge event of rank r counts for all sizes above r + base, so
    sizes read running sums over ranks, taken in blocks of ranks. There is at most one event row per rank,
    whatever the size of the text.
    """
    low, high = model.base_size, model.vocab_size
    ends = grid.agg(F.min("vocab_size").alias("low"), F.max("vocab_size").alias("high")).first()
    if ends["low"] is None or not 0 < low <= ends["low"] <= ends["high"] <= high:
        raise ValueError(f"prefix sizes must lie between {low:,} and {high:,}")
    start = words.agg(
        F.sum(F.col("freq") * start_size(F.col("word"), model.splitting)).alias("symbols")
    ).first()["symbols"]
    events = store(merge_events(words, model), "merge-events") if events is None else events
    # Events and sizes on one line of ranks; a size asks for all events up to its last rank.
    line = events.select(F.col("rank").alias("place"), "n", F.lit(None).cast("int").alias("vocab_size")).unionByName(
        grid.distinct().select(
            (F.col("vocab_size") - low - 1).alias("place"), F.lit(0).cast("bigint").alias("n"), "vocab_size"
        )
    )
    line = line.withColumn("block", F.floor(F.col("place") / RANKS_PER_BLOCK).cast("int"))
    totals = line.groupBy("block").agg(F.sum("n").alias("n")).orderBy("block").collect()  # one row per block
    earlier = words.sparkSession.createDataFrame(
        list(zip((row["block"] for row in totals), accumulate((row["n"] for row in totals), initial=0))),
        "block int, earlier bigint",
    )
    inside = (
        Window.partitionBy("block")
        .orderBy("place", F.col("vocab_size").isNotNull())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    points = (
        line.withColumn("so_far", F.sum("n").over(inside))
        .where("vocab_size IS NOT NULL")
        .join(F.broadcast(earlier), "block")  # one row per block
        .select(
            "vocab_size",
            (F.lit(start or 0).cast("bigint") - F.col("earlier") - F.col("so_far")).alias("token_count"),
        )
    )
    return with_ratios(points, F.lit(text_bytes).cast("bigint"))


def measure_prefix(words: DataFrame, model: BpeModel, vocab_size: int, text_bytes: int) -> DataFrame:
    """One point by encoding with the prefix model itself."""
    encoded = encode_word_types(words, model.prefix(vocab_size))
    point = encoded.agg(F.sum(F.col("freq") * F.col("n_tokens")).alias("token_count")).select(
        F.lit(vocab_size).alias("vocab_size"), "token_count"
    )
    return with_ratios(point, F.lit(text_bytes).cast("bigint"))


def require_point_tokens(points: DataFrame) -> None:
    empty = points.where(F.coalesce("token_count", F.lit(0)) == 0).orderBy("vocab_size").first()
    if empty is not None:
        raise ValueError(f"no text was encoded by the prefix of {empty['vocab_size']:,} entries")


def sweep_summary(points: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: totals of the measured text and the points in order of size."""
    used = stats.first()  # one row
    point = F.struct("vocab_size", "token_count", "bytes_per_token", "tokens_per_byte")
    return points.agg(F.sort_array(F.collect_list(point)).alias("points")).select(
        F.lit(used["bytes_used"]).cast("bigint").alias("evaluated_utf8_bytes"),
        F.lit(used["documents_used"]).cast("bigint").alias("evaluated_documents"),
        "points",
    )


def parity(points: DataFrame, earlier: DataFrame) -> DataFrame:
    """Sizes measured by both: ``(vocab_size, token_count, earlier_count, equal)``.

    A size without an earlier result keeps nulls.
    """
    before = earlier.select("vocab_size", F.col("token_count").alias("earlier_count"))
    return points.join(before, "vocab_size", "left").select(
        "vocab_size",
        "token_count",
        "earlier_count",
        (F.col("token_count") == F.col("earlier_count")).alias("equal"),
    )


def require_parity(points: DataFrame, earlier: DataFrame) -> DataFrame:
    """The parity rows, after checking that no shared size disagrees."""
    rows = parity(points, earlier)
    bad = rows.where("not equal").orderBy("vocab_size").first()
    if bad is not None:
        raise ValueError(
            f"the sweep disagrees with the earlier result at size {bad['vocab_size']:,}: "
            f"{bad['token_count']:,} against {bad['earlier_count']:,} tokens"
        )
    return rows
