"""Exact byte-pair-encoding training as rounds of Spark jobs over an index from pairs to words.

One job per merge would spend its time on job start-up, so each round proposes a whole sequence of merges and
lets Spark play the sequence through while recording how each step changes the counts of pairs. The driver then
walks the sequence and accepts it as far as every step really was the best pair at that moment; the counts after
the last accepted step are already known, so the next round can start at once. The result is the same merge
list as one-at-a-time training. Sequences are proposed from the current counts and from what earlier rounds
showed a merge to do to other pairs; a wrong guess costs a round, never a wrong merge. With many words the most
frequent ones are trained on first: what merges do there is what the first proposals over all words go by, and rounds
grow longer as long as proposals turn out right.

The state is the table of words with the list of merges accepted so far; words are merged many at once on flat
arrays (``functions/bpe``), so the present form of a word is made where it is needed and nothing is rewritten. Pair
counts are sums over the changes that rounds recorded. The first rounds concern most words and read them all. Once
a round has touched less than ``DENSE`` of the words, an inverted index from pairs to words is written. From then
on a round reads the index rows of the proposed pairs only, plays those words, and appends the pairs that arose in
them; all other words are left alone. Token ids are 32-bit numbers.

What reaches the driver is bounded by the frontier size, the round length and the vocabulary size, never by the
corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush, nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from lexigrain.functions.bpe import MergeTable, Trace, byte_column, merge_words, pair_key, play_in_order
from lexigrain.functions.symbols import base_tokens, byte_alphabet, to_symbols
from lexigrain.operators.model import BpeModel, check_vocab_size, model_from_merges
from lexigrain.storage import StoredTable, store

FRONTIER_SIZE = 4_096  # best pairs fetched at a recount
ROUND_LENGTH = 256  # merges proposed per job, or twice those that the last round accepted
LONGEST_ROUND = 4  # in round lengths
REHEARSED_WORDS = 100_000  # most frequent words that are trained on first if there are several times as many
REHEARSED_MERGES = 8_192  # merges learned there; their effects are kept by the driver
ROUNDS_PER_STORE = 24  # rounds appended before the index is written anew
WORDS_PER_TASK = 40_000  # words that a task plays a round on
LEAST_TASKS = 16  # tasks that words are dealt to if they are few
SUMS_PER_TASK = 2_000_000  # sums that a task holds before it hands them on
DENSE = 0.3  # share of the words that a round must touch for the next one to read them all
CHANGES = "pair long, step int, d long, known boolean, word string, freq long"
INDEX = "pair long, word string, freq long, round int, step int"
_TOUCHED = -1  # pair number of the rows that count the words played
_PUSHED_VALUES = "spark.sql.parquet.pushdown.inFilterThreshold"


def symbol_words(word_types: DataFrame) -> DataFrame:
    """``(s, freq)``: word types as one character per byte."""
    return word_types.select(to_symbols(F.col("word")).alias("s"), "freq")


def pair_counts(words: DataFrame) -> DataFrame:
    """``(pair, n)``: neighbouring symbols inside words, weighted by word frequency."""
    chars, n = F.split("s", ""), F.char_length("s")
    neighbours = F.arrays_zip(
        F.slice(chars, F.lit(1), n - 1).alias("a"), F.slice(chars, F.lit(2), n - 1).alias("b")
    )
    return (
        words.where(n > 1)
        .select("freq", F.inline(neighbours))
        .groupBy(F.concat("a", "b").alias("pair"))
        .agg(F.sum("freq").alias("n"))
    )


def _sums(step: np.ndarray, pair: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums per step and pair that are not zero."""
    order = np.lexsort((pair, step))
    step, pair = step[order], pair[order]
    if not len(order):
        return step, pair, d
    first = np.flatnonzero(np.r_[True, (step[1:] != step[:-1]) | (pair[1:] != pair[:-1])])
    sums = np.add.reduceat(d[order], first)
    left = sums != 0
    return step[first][left], pair[first][left], sums[left]


def _changes(words: DataFrame, merges: np.ndarray, since: int, known: np.ndarray, name_words: bool) -> DataFrame:
    """What the merges of rank ``since`` and above do, summed per task: ``CHANGES`` rows without a word.

    ``merges`` has the left, right and made id of every rank. ``known`` pairs are marked. With ``name_words``
    there are also rows for the words in which a pair arose, by the first step that made it. Without merges, the
    changes are the words' first pairs.
    """
    ids = {token: i for i, token in enumerate(base_tokens())}
    start = np.array([ids[c] for _, c in sorted(byte_alphabet().items())])
    content = words.sparkSession.sparkContext.broadcast((merges.astype(np.int32), np.sort(known)))
    names = ["pair", "step", "d", "known", "word", "freq"]

    def rows(pair, step, d, marked, word=None, freq=None) -> pa.RecordBatch:
        n = len(pair)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(pair, pa.int64()),
                pa.array(step, pa.int32()),
                pa.array(d, pa.int64()),
                pa.array(np.isin(pair, marked)),
                pa.nulls(n, pa.string()) if word is None else word,
                pa.nulls(n, pa.int64()) if freq is None else freq,
            ],
            names=names,
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (left, right, made), marked = content.value
        table = MergeTable(left, right, np.arange(len(left)), made)
        total, touched = (np.zeros(0, np.int64),) * 3, 0
        parts, waiting = [], 0
        for batch in batches:
            data, sizes = byte_column(batch.column(0))
            freq = batch.column(1).to_numpy(zero_copy_only=False)
            tokens = start[data]
            if name_words:
                trace = Trace(since)
                merge_words(tokens, sizes, table, in_rank_order=True, trace=trace)
                word, step, pair, change = trace.columns()
                touched += len(np.unique(word))
                arose = np.flatnonzero(change > 0)
                order = arose[np.lexsort((step[arose], pair[arose], word[arose]))]
                new = np.r_[True, (word[order[1:]] != word[order[:-1]]) | (pair[order[1:]] != pair[order[:-1]])]
                order = order[new[: len(order)]]
                at = pa.array(word[order])
                yield rows(pair[order], step[order], np.zeros(len(order)), marked, batch.column(0).take(at), batch.column(1).take(at))
                change = freq[word] * change
            elif len(left):
                step, pair, change, n = play_in_order(tokens, sizes, freq, content.value[0].T, since)
                touched += n
            else:
                word = np.repeat(np.arange(len(sizes)), sizes)
                at = np.flatnonzero(word[1:] == word[:-1])
                sums = np.bincount(tokens[at] * len(ids) + tokens[at + 1], freq[word[at]])  # whole, exact up to 2**53
                found = np.flatnonzero(sums)
                pair, change = pair_key(found // len(ids), found % len(ids)), sums[found].astype(np.int64)
                step = np.full(len(found), -1)
            parts.append(_sums(step, pair, change))
            waiting += len(parts[-1][0])
            # Sums are put together when as many new ones wait, so each is sorted few times however many batches come.
            if waiting > max(len(total[0]), SUMS_PER_TASK // 8):
                total, parts, waiting = _sums(*map(np.concatenate, zip(total, *parts))), [], 0
                if len(total[0]) > SUMS_PER_TASK:
                    step, pair, d = total
                    yield rows(pair, step, d, marked)
                    total = (np.zeros(0, np.int64),) * 3
        step, pair, d = _sums(*map(np.concatenate, zip(total, *parts)))
        yield rows(np.append(pair, _TOUCHED), np.append(step, -1), np.append(d, touched), marked)

    return words.select("word", "freq").mapInArrow(run, CHANGES)


def _present_pairs(words: DataFrame, merges: np.ndarray) -> DataFrame:
    """``(pair, word, freq)``: the pairs that each word holds after the merges."""
    ids = {token: i for i, token in enumerate(base_tokens())}
    start = np.array([ids[c] for _, c in sorted(byte_alphabet().items())])
    content = words.sparkSession.sparkContext.broadcast(merges.astype(np.int32))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, made = content.value
        table = MergeTable(left, right, np.arange(len(left)), made)
        for batch in batches:
            data, sizes = byte_column(batch.column(0))
            merged = merge_words(start[data], sizes, table, in_rank_order=True)
            word = np.repeat(np.arange(len(sizes)), merged.sizes)
            at = np.flatnonzero(word[1:] == word[:-1])
            word, pair = word[at], pair_key(merged.ids[at], merged.ids[at + 1])
            order = np.lexsort((pair, word))
            new = np.r_[True, (word[order[1:]] != word[order[:-1]]) | (pair[order[1:]] != pair[order[:-1]])][: len(order)]
            order = order[new]
            rows = pa.array(word[order])
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[order]), batch.column(0).take(rows), batch.column(1).take(rows)], names=["pair", "word", "freq"]
            )

    return words.select("word", "freq").mapInArrow(run, "pair long, word string, freq long")


def _tasks(n_words: int) -> int:
    """Tasks for so many words: a quarter of ``WORDS_PER_TASK`` each until there are ``LEAST_TASKS``, then more words."""
    return max(1, min(LEAST_TASKS, -(-4 * n_words // WORDS_PER_TASK)), -(-n_words // WORDS_PER_TASK))


class PairIndex:
    """Words, the recorded changes of pair counts, and from some round on the words of each pair."""

    def __init__(self, word_types: DataFrame):
        self.spark = word_types.sparkSession
        seen = Observation()
        given = StoredTable(word_types.where(F.octet_length("word") > 1).observe(seen, F.count("*").alias("n")), "words")
        self.n_words = seen.get["n"]
        self.tasks = _tasks(self.n_words)
        self.words = given
        if given.df.rdd.getNumPartitions() < min(self.tasks, self.spark.sparkContext.defaultParallelism):
            self.words = StoredTable(given.df.repartition(self.tasks), "words")
            given.drop()
        none = np.zeros((3, 0), np.int64)
        self.changes = [self._record(_changes(self.words.df, none, 0, none[0], False))]
        self.index: list[StoredTable] = []  # the pairs of all words, then one table per round
        self.accepted = [0]  # per round: the rank that its accepted steps end before
        self.touched = self.n_words

    def _record(self, changes: DataFrame) -> StoredTable:
        return StoredTable(changes.withColumn("round", F.lit(len(getattr(self, "accepted", ())))), "pair-changes")

    def _accepted(self, tables: list[StoredTable]) -> DataFrame:
        """The accepted rows of stored tables, in one scan."""
        stored = self.spark.read.schema(tables[0].df.schema).parquet(*(t.path for t in tables))
        ends = F.lit(np.array(self.accepted, np.int32))
        return stored.where(F.col("step") < F.get(ends, F.col("round")))

    def best_pairs(self, n: int) -> list[tuple[int, int]]:
        """The ``n`` most frequent pairs with their counts."""
        changes = self._accepted(self.changes).where((F.col("pair") != _TOUCHED) & F.col("word").isNull())
        counts = changes.groupBy("pair").agg(F.sum("d").alias("n"))
        best = counts.where("n > 0").orderBy(F.desc("n"), "pair").limit(n).collect()
        return [(row["pair"], row["n"]) for row in best]

    def _words_of(self, pairs: list[int]) -> DataFrame:
        """The words that hold one of the pairs, or held it lately."""
        held = F.expr(f"word IS NOT NULL AND pair IN ({', '.join(map(str, pairs))})")
        rows = self._accepted(self.index).where(held)
        tasks = min(self.tasks, _tasks(2 * self.touched))
        return rows.select("word", "freq").repartition(tasks, "word").distinct()

    def play(self, merges: list[tuple[int, int, int]], since: int, known: list[int], floor: int, first_new: int):
        """Plays the merges from rank ``since`` on; returns the words played and lists of pairs, ranks and changes.

        A pair is at its most frequent when the younger of its symbols is made and only falls later, so the pairs
        that matter are the known ones and new ones that start with at least ``floor``; others do not leave Spark.
        """
        table = np.array(merges, np.int64).reshape(-1, 3).T
        if not self.index and self.touched < DENSE * self.n_words:
            present = _present_pairs(self.words.df, table[:, :since]).sortWithinPartitions("pair")
            self.index = [StoredTable(present.withColumns({"round": F.lit(0), "step": F.lit(-1)}), "pair-index")]
        if self.index:
            # A pair of a symbol made in this round stands in words that an earlier step of the round touches.
            words = self._words_of([int(p) for p in pair_key(table[0][since:], table[1][since:])])
        else:
            words = self.words.df
        played = self._record(_changes(words, table, since, np.array(known, np.int64), bool(self.index)))
        self.changes.append(played)
        new = F.greatest(F.shiftright("pair", 32), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))) >= first_new
        sums = (
            played.df.where(F.col("word").isNull() & (F.col("known") | (F.col("pair") == _TOUCHED) | new))
            .groupBy("pair", "step", "known")
            .agg(F.sum("d").alias("d"))
            .where("d <> 0")
            .groupBy("pair", "known")
            .agg(F.max("d").alias("most"), F.collect_list("step").alias("steps"), F.collect_list("d").alias("ds"))
            .where(F.col("known") | (F.col("pair") == _TOUCHED) | (new & (F.col("most") >= floor)))
            .select("pair", "steps", "ds")
            .toArrow()
        )
        pair, steps, ds = (sums.column(i).combine_chunks() for i in range(3))
        pairs = np.repeat(pair.to_numpy(), steps.value_lengths().to_numpy())
        changes = pairs, steps.flatten().to_numpy(), ds.flatten().to_numpy()
        counted = pairs == _TOUCHED
        self.touched = int(changes[2][counted].sum())
        return self.touched, tuple(c[~counted].tolist() for c in changes)

    def accept(self, end: int) -> None:
        """Keep the last round's steps of ranks below ``end``."""
        self.accepted.append(end)
        if self.index:
            self.index.append(self.changes[-1])
        if len(self.changes) > ROUNDS_PER_STORE:
            self._write_anew()

    def _write_anew(self) -> None:
        """One table instead of one per round. Words that lost a pair stay with it, at the cost of a look."""
        counts = self._accepted(self.changes).where(F.col("word").isNull() & (F.col("pair") != _TOUCHED))
        counts = counts.groupBy("pair").agg(F.sum("d").alias("d")).where("d <> 0")
        whole = counts.select(
            "pair",
            F.lit(-1).alias("step"),
            "d",
            F.lit(False).alias("known"),
            F.lit(None).cast("string").alias("word"),
            F.lit(None).cast("long").alias("freq"),
            F.lit(0).alias("round"),
        )
        summed, old = StoredTable(whole, "pair-changes"), self.changes
        if len(self.index) > 1:
            rows = self._accepted(self.index[1:]).where("word IS NOT NULL").select("pair", "word", "freq").distinct()
            rows = rows.withColumns({"round": F.lit(0), "step": F.lit(-1)})
            if self.index[1] not in old:
                old = [*old, self.index[1]]
            self.index = [self.index[0], StoredTable(rows.sortWithinPartitions("pair"), "pair-index")]
        for table in old:
            table.drop()
        self.changes = [summed]

    def drop(self) -> None:
        for table in {id(t): t for t in (*self.changes, *self.index, self.words)}.values():
            table.drop()


@dataclass
class TrainingReport:
    rounds: int = 0
    recounts: int = 0
    words_played: list[int] = field(default_factory=list)  # per round


#: Token strings of a pair -> (left token, right token, count change) of the pairs that its merge touches.
Effects = dict[tuple[str, str], list[tuple[str, str, int]]]


def _pair(left: int, right: int) -> int:
    return left << 32 | right


def _sides(pair: int) -> tuple[int, int]:
    return pair >> 32, pair & 0xFFFFFFFF


class _Vocabulary:
    """Token strings by id, the merges accepted so far, and what the last proposals did."""

    def __init__(self, rehearsed: Effects):
        self.tokens = base_tokens()
        self.ids = {token: i for i, token in enumerate(self.tokens)}
        self.merges: list[tuple[int, int, int]] = []
        self.effects: Effects = {}
        # The same for merges of a rehearsal; pairs not played yet are expected to act like that.
        self.rehearsed = rehearsed

    def propose(self, counts: dict[int, int], cut: tuple[int, int], limit: int, length: int) -> list[tuple[int, int, int]]:
        """Steps ``(left, right, made)``, best first by the expected counts; ends after one that respells a token."""
        expected, steps = _Ranking(counts), []
        spelling = _Spelling(self.tokens)
        while len(steps) < length and len(self.tokens) + len(steps) < limit:
            pair = expected.best()
            if pair is None or _order(pair, expected.counts[pair]) > cut:
                break
            left, right = _sides(pair)
            names = spelling[left], spelling[right]
            token = names[0] + names[1]
            if token in spelling.new:
                break
            if token in self.ids:
                steps.append((left, right, self.ids[token]))
                break
            steps.append((left, right, spelling.add(token)))
            del expected.counts[pair]
            for one, two, d in self.effects.get(names) or self.rehearsed.get(names, ()):
                touched = self._id(one, spelling), self._id(two, spelling)
                if None in touched:
                    continue
                key = _pair(*touched)
                if d > 0 or key in expected.counts:
                    expected[key] = expected.counts.get(key, 0) + d
        return steps

    def _id(self, token: str, spelling: "_Spelling") -> int | None:
        return self.ids.get(token, spelling.new.get(token))

    def learn(self, steps: list[tuple[int, int, int]], updates: list[list[tuple[int, int]]]) -> None:
        """Keep the effects of the steps just played, by token strings, which outlive rejected ids."""
        self.effects = {}
        spelling = _Spelling(self.tokens)
        for (left, right, made), changed in zip(steps, updates):
            names = spelling[left], spelling[right]
            if made >= len(self.tokens):
                spelling.add(names[0] + names[1])
            self.effects[names] = [
                (*(spelling[i] for i in _sides(pair)), d) for pair, d in changed if pair != _pair(left, right)
            ]

    def accept(self, step: tuple[int, int, int]) -> bool:
        """Record a step; False if it respells a token that exists already."""
        left, right, made = step
        self.merges.append(step)
        if made < len(self.tokens):
            return False
        token = self.tokens[left] + self.tokens[right]
        self.ids[token] = len(self.tokens)
        self.tokens.append(token)
        return True


class _Spelling:
    """Token strings of ids, including those a proposed sequence makes on the way."""

    def __init__(self, tokens: list[str]):
        self.tokens = tokens
        self.made: list[str] = []
        self.new: dict[str, int] = {}

    def __getitem__(self, i: int) -> str:
        return self.tokens[i] if i < len(self.tokens) else self.made[i - len(self.tokens)]

    def add(self, token: str) -> int:
        self.new[token] = len(self.tokens) + len(self.made)
        self.made.append(token)
        return self.new[token]


def _order(pair: int, count: int) -> tuple[int, int]:
    """Best first: larger count, then smaller left and right id."""
    return -count, pair


class _Ranking:
    """Pair counts with quick access to the best pair; outdated heap entries are skipped."""

    def __init__(self, counts: dict[int, int]):
        self.counts = dict(counts)
        self._heap = [_order(pair, n) for pair, n in counts.items()]
        heapify(self._heap)

    def __setitem__(self, pair: int, count: int) -> None:
        self.counts[pair] = count
        heappush(self._heap, _order(pair, count))

    def best(self) -> int | None:
        while self._heap:
            negative, pair = self._heap[0]
            if self.counts.get(pair) == -negative:
                return pair
            heappop(self._heap)
        return None


def train_bpe(
    word_types: DataFrame,
    vocab_size: int,
    frontier_size: int = FRONTIER_SIZE,
    round_length: int = ROUND_LENGTH,
    report: TrainingReport | None = None,
    share: float = 1.0,
) -> BpeModel:
    """Learn merges over ``(word, freq)`` until ``vocab_size`` entries exist or no pair is left.

    With ``share`` below 1 the result is approximate and takes fewer rounds: a proposed merge is accepted as long
    as its exact count at that moment is at least this share of the best pair's.
    """
    check_vocab_size(vocab_size)
    if not 0 < share <= 1:
        raise ValueError("the share of the best count must lie above 0 and at most at 1")
    spark = word_types.sparkSession
    report = report or TrainingReport()
    pushed = spark.conf.get(_PUSHED_VALUES)
    # So the file scan gets the proposed pairs one by one and skips what holds none of them.
    spark.conf.set(_PUSHED_VALUES, str(max(int(pushed), LONGEST_ROUND * round_length)))
    try:
        index = PairIndex(word_types)
        rehearsed = _rehearse(index, vocab_size, frontier_size, round_length)
        vocab = _learn_merges(index, vocab_size, frontier_size, round_length, report, share, rehearsed)
    finally:
        spark.conf.set(_PUSHED_VALUES, pushed)
    made = model_from_merges(spark, vocab.merges, vocab.tokens)
    return BpeModel(store(made.vocab, "vocab"), store(made.merges, "merges"))


def _rehearse(index: PairIndex, vocab_size: int, frontier_size: int, round_length: int) -> Effects:
    """What merges do to pairs of the most frequent words, which make up most of a text however large it is.

    It serves to propose merges only; which ones are accepted is up to the counts over all words.
    """
    if index.n_words < 4 * REHEARSED_WORDS:
        return {}
    frequent = PairIndex(index.words.df.orderBy(F.desc("freq"), "word").limit(REHEARSED_WORDS))
    limit = min(vocab_size, len(base_tokens()) + REHEARSED_MERGES)
    kept: Effects = {}
    _learn_merges(frequent, limit, frontier_size, round_length, TrainingReport(), 1.0, {}, kept)
    return kept


def _learn_merges(
    index: PairIndex,
    vocab_size: int,
    frontier_size: int,
    round_length: int,
    report: TrainingReport,
    share: float,
    rehearsed: Effects,
    lasting: Effects | None = None,
) -> _Vocabulary:
    """Accepted merges; what each did when it was accepted goes to ``lasting`` if that is given."""
    vocab, length = _Vocabulary(rehearsed), round_length
    while len(vocab.tokens) < vocab_size:
        best = index.best_pairs(frontier_size)
        report.recounts += 1
        if not best:
            break
        ranking = _Ranking(dict(best))
        counts = ranking.counts
        # Pairs that were not fetched rank below the last one fetched, and stay below it.
        complete = len(best) < frontier_size
        cut = (-1, 1 << 62) if complete else _order(*best[-1])
        distinct = True

        while distinct and counts and len(vocab.tokens) < vocab_size:
            proposed = vocab.propose(counts, cut, vocab_size, length)
            since = len(vocab.merges)
            played, changes = index.play(vocab.merges + proposed, since, list(counts), -cut[0], len(vocab.tokens))
            report.rounds += 1
            report.words_played.append(played)
            updates: list[list[tuple[int, int]]] = [[] for _ in proposed]
            for pair, step, d in zip(*changes):
                updates[step - since].append((pair, d))
            vocab.learn(proposed, updates)
            for step, changed in zip(proposed, updates):
                best, pair = ranking.best(), _pair(*step[:2])
                if best != pair and (share == 1 or counts.get(pair, 0) < share * counts.get(best, 1)):
                    break
                if lasting is not None:
                    names = tuple(vocab.tokens[i] for i in step[:2])
                    lasting[names] = vocab.effects[names]
                distinct = vocab.accept(step)
                for pair, d in changed:  # the merged pair among them
                    value = counts.get(pair, 0) + d
                    if value > 0 and _order(pair, value) <= cut:
                        ranking[pair] = value
                    else:
                        counts.pop(pair, None)
            index.accept(len(vocab.merges))
            length = min(max(2 * (len(vocab.merges) - since), round_length), LONGEST_ROUND * round_length)
            if len(counts) > 2 * frontier_size:  # the least frequent pairs wait for a recount
                kept = nsmallest(frontier_size, counts.items(), key=lambda c: _order(*c))
                ranking, cut = _Ranking(dict(kept)), _order(*kept[-1])
                counts, complete = ranking.counts, False
            if not complete and 2 * len(proposed) < round_length:
                break  # few pairs above the cut are left
    index.drop()
    return vocab
