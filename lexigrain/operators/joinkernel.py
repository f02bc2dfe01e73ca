"""A second way to encode: rounds of joins between the pairs of words and the merge list, without Python.

In a round every word that still holds a pair of the merge list meets all its pairs' rules in a join, takes the
one of least rank, and replaces its places in the word, which is a string with one character per token. Words
without a rule leave. The number of rounds is that of the distinct merges in the busiest word. It shares no code
with the flat-array encoder beyond the byte alphabet, so the two check each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexigrain.functions.symbols import id_to_symbol, one_char_per_byte, symbol_char, translation
from lexigrain.operators.model import BpeModel
from lexigrain.storage import StoredTable

#: Merge lists up to this length are sent to all tasks; longer ones are shuffled to the pairs.
BROADCAST_MERGES = 200_000


def _rules(model: BpeModel) -> DataFrame:
    """``(pair, rule)``: per pair its rank, the character it becomes, and whether it is replaced one at a time."""
    merges = model.merges
    used = merges.select(F.col("left_id").alias("id"), "rank").unionByName(merges.select(F.col("right_id").alias("id"), "rank"))
    earliest = used.groupBy("id").agg(F.min("rank").alias("earliest"))
    # A rule whose token is part of a rule of lower rank may have to wait for that one after each replacement.
    marked = merges.join(earliest, merges["token_id"] == earliest["id"], "left").withColumn(
        "alone", F.coalesce(F.col("earliest") <= F.col("rank"), F.lit(False))
    )
    pair = F.concat(id_to_symbol(F.col("left_id")), id_to_symbol(F.col("right_id")))
    rule = F.struct("rank", pair.alias("pair"), id_to_symbol(F.col("token_id")).alias("made"), "alone")
    return marked.groupBy(pair.alias("pair")).agg(F.min(rule).alias("rule"))  # of equal pairs the first counts


def _start(word: Column, model: BpeModel) -> Column:
    ids = model.content()["start"][0].tolist()
    if model.inner_prefix or model.word_end or model.whole_words or min(ids) < 0:
        raise ValueError("the join rounds take byte-level models whose words begin as one token per byte")
    return F.translate(one_char_per_byte(word), *translation({b: symbol_char(i) for b, i in enumerate(ids)}))


def _replaced(s: Column, rule: Column) -> Column:
    at = F.position(rule["pair"], s)
    first = F.concat(F.substring(s, F.lit(1), at - 1), rule["made"], F.substring(s, at + 2, F.char_length(s)))
    return F.when(rule["alone"], first).otherwise(F.replace(s, rule["pair"], rule["made"]))


def merge_events_by_joins(words: DataFrame, model: BpeModel) -> DataFrame:
    """``(rank, n)``: merges made over the whole text, by effective rank; see ``encoding.merge_events``."""
    literals = [literal for literal, _ in model.specials]
    plain = words.where(~F.col("word").isin(literals)) if literals else words
    rules = StoredTable(_rules(model), "join-rules")
    rule_rows = F.broadcast(rules.df) if model.merge_count <= BROADCAST_MERGES else rules.df
    state = StoredTable(
        plain.select(
            F.monotonically_increasing_id().alias("id"), _start(F.col("word"), model).alias("s"), "freq", F.lit(-1).alias("highest")
        ).where(F.char_length("s") > 1),
        "join-words",
    )
    spark, parts = words.sparkSession, []
    while True:
        chars, n = F.split("s", ""), F.char_length("s")
        pairs = F.zip_with(F.slice(chars, F.lit(1), n - 1), F.slice(chars, F.lit(2), n - 1), lambda a, b: F.concat(a, b))
        met = state.df.select("id", F.explode(F.array_distinct(pairs)).alias("pair")).join(rule_rows, "pair")
        least = met.groupBy("id").agg(F.min("rule").alias("rule"))
        merged = state.df.join(least, "id").withColumn("t", _replaced(F.col("s"), F.col("rule")))
        moved = StoredTable(
            merged.select(
                "id",
                F.col("t").alias("s"),
                "freq",
                F.greatest("highest", F.col("rule")["rank"]).alias("highest"),
                (F.char_length("s") - F.char_length("t")).alias("merges"),
            ),
            "join-words",
        )
        done = moved.df.groupBy(F.col("highest").alias("rank")).agg(F.sum(F.col("freq") * F.col("merges")).alias("n"))
        parts.append(StoredTable(done, "join-events"))  # at most one row per rank
        state.drop()
        if moved.df.limit(1).isEmpty():
            break
        state = StoredTable(moved.df.where(F.char_length("s") > 1).drop("merges"), "join-words")
        moved.drop()
    events = spark.read.schema(parts[0].df.schema).parquet(*(p.path for p in parts))
    total = StoredTable(events.groupBy("rank").agg(F.sum("n").alias("n")), "merge-events")
    for part in (*parts, rules):
        part.drop()
    return total.df
