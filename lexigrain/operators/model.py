"""The token set as tables: base vocabulary, merges, and prefixes of a merge list."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrain.functions.pretokens import Splitting
from lexigrain.functions.symbols import (
    BASE_SIZE,
    SPECIAL_ID,
    SPECIAL_TOKEN,
    alphabet_to_bytes,
    base_tokens,
    byte_alphabet,
)

PLAIN = Splitting()
MAX_ENTRIES = 2**31 - 1

VOCAB_SCHEMA = "token_id int, token string"
MERGES_SCHEMA = (
    "rank int, left string, right string, token string, token_id int, left_id int, right_id int"
)


def check_vocab_size(vocab_size: int) -> None:
    if vocab_size < BASE_SIZE:
        raise ValueError(f"a vocabulary needs at least {BASE_SIZE} entries (256 bytes and one special)")
    if vocab_size > MAX_ENTRIES:
        raise ValueError("token ids are 32-bit numbers")


def base_vocabulary(spark: SparkSession) -> DataFrame:
    """``(token_id, token)`` of the 257 entries every trained vocabulary starts with."""
    return spark.createDataFrame(list(enumerate(base_tokens())), VOCAB_SCHEMA)


@dataclass(frozen=True)
class BpeModel:
    """``vocab(token_id, token)`` and ``merges(rank, left, right, token, token_id, left_id, right_id)``.

    ``specials`` are literals with ids that stand for themselves; ``unknown`` is the id of a byte that the
    vocabulary does not hold (such bytes are left out if it is null). ``cutting`` has the settings that cut text;
    its literals are those of ``specials``. Symbols that do not begin a word carry ``inner_prefix``, the one that
    ends it ``word_end``. With ``whole_words`` a word that is an entry of the vocabulary is not merged at all.
    """

    vocab: DataFrame
    merges: DataFrame
    path: str = field(default="")
    specials: tuple[tuple[str, int], ...] = ((SPECIAL_TOKEN, SPECIAL_ID),)
    unknown: int | None = SPECIAL_ID
    cutting: Splitting = PLAIN
    inner_prefix: str = ""
    word_end: str = ""
    whole_words: bool = False
    sections: str = ""  # settings of the file that the model was read from, as JSON

    @cached_property
    def vocab_size(self) -> int:
        return self.vocab.count()

    @cached_property
    def merge_count(self) -> int:
        return self.merges.count()

    @property
    def base_size(self) -> int:
        return self.vocab_size - self.merge_count

    @property
    def prefix_space(self) -> bool:
        return self.cutting.prefix_space

    @property
    def splitting(self) -> Splitting:
        return replace(self.cutting, specials=tuple(literal for literal, _ in self.specials))

    def content(self) -> dict:
        """What tasks need to encode: a few arrays, as large as the vocabulary."""
        return self._content

    @cached_property
    def _content(self) -> dict:
        letters = self.vocab.where(F.col("token").isin(self.first_tokens())).collect()  # at most 1,024
        ids = {row["token"]: row["token_id"] for row in letters}
        table = self.merges.select("rank", "left_id", "right_id", "token_id").orderBy("rank").toArrow()
        rank, left, right, token = (c.to_numpy() for c in table.columns)
        missing = -1 if self.unknown is None else self.unknown
        return {
            "rank": rank,
            "left": left,
            "right": right,
            "token": token,
            "start": np.array([ids.get(t, missing) for t in self.first_tokens()], np.int64).reshape(4, 256),
            "specials": dict(self.specials),
            "whole": self._entries() if self.whole_words else {},
        }

    def _entries(self) -> dict[str, int]:
        """Vocabulary entries that spell text, by that text."""
        table = self.vocab.select(F.decode(alphabet_to_bytes(F.col("token")), "ISO-8859-1"), "token_id").toArrow()
        entries = {}
        for latin, token_id in zip(table.column(0).to_pylist(), table.column(1).to_pylist()):
            try:
                entries[latin.encode("latin-1").decode("utf-8")] = token_id
            except UnicodeDecodeError:
                pass  # a part of a character is no word
        return entries

    def first_tokens(self) -> list[str]:
        """Spelling of every byte as a word's inner, first, last and only symbol."""
        alphabet = byte_alphabet()
        return [
            ("" if first else self.inner_prefix) + alphabet[b] + (self.word_end if last else "")
            for last in (False, True)
            for first in (False, True)
            for b in range(256)
        ]

    def prefix(self, vocab_size: int) -> "BpeModel":
        """The model a training run stopped at ``vocab_size`` would have produced."""
        if not 0 < self.base_size <= vocab_size <= self.vocab_size:
            raise ValueError(
                f"the prefix size must lie between {self.base_size:,} and {self.vocab_size:,}"
            )
        ids = self.vocab.agg(
            F.min("token_id").alias("low"),
            F.max("token_id").alias("high"),
            F.count_distinct("token_id").alias("n"),
        ).first()
        if (ids["low"], ids["high"], ids["n"]) != (0, self.vocab_size - 1, self.vocab_size):
            raise ValueError("token ids must run from zero without gaps")
        return BpeModel(
            self.vocab.where(F.col("token_id") < vocab_size),
            self.merges.where(F.col("rank") < vocab_size - self.base_size),
            self.path,
            self.specials,
            self.unknown,
            self.cutting,
            self.inner_prefix,
            self.word_end,
            self.whole_words,
            self.sections,
        )


def model_from_merges(spark: SparkSession, merges: list[tuple[int, int, int]], tokens: list[str]) -> BpeModel:
    """Tables from a list of ``(left_id, right_id, token_id)`` and the token strings by id."""
    rows = [
        (rank, tokens[a], tokens[b], tokens[c], c, a, b) for rank, (a, b, c) in enumerate(merges)
    ]
    return BpeModel(
        spark.createDataFrame(list(enumerate(tokens)), VOCAB_SCHEMA),
        spark.createDataFrame(rows, MERGES_SCHEMA),
    )
