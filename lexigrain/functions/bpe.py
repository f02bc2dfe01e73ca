"""Byte-pair merging of many words at once, on flat token arrays inside a task.

The tokens of all words of a batch lie in one array. A round looks at the rank of every neighbouring pair, takes
the least rank of each word by a segmented minimum, and merges all its places; words without a pair leave. Only
pairs next to a merge are looked up again, in the sorted keys of the merge list. A round costs a few array passes
over the words that are still going, whatever the number of merges in the list.
"""

from __future__ import annotations

import heapq
import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Tasks get these helpers by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NO_RANK = np.iinfo(np.int64).max
#: Words kept with their tokens in a task, and the tokens kept for them.
MEMO_WORDS = 300_000
MEMO_TOKENS = 4_000_000
#: Words of more tokens are merged with a heap, whose time does not grow with the square of their length.
LONG_WORD = 256


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.int64) << 32) | right.astype(np.int64)


class MergeTable:
    """A merge list sorted by pair; of equal pairs the one with the lower rank comes first."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        keys = pair_key(left, right)
        order = np.lexsort((rank, keys))
        self.keys = keys[order]
        self.rank = np.append(rank[order].astype(np.int64), NO_RANK)
        self.made = made[order].astype(np.int64)
        self.none = len(keys)
        # A rule whose token belongs to a rule of lower rank must be applied one place at a time.
        size = int(max(left.max(initial=-1), right.max(initial=-1), made.max(initial=-1))) + 1
        earliest = np.full(size, NO_RANK)
        np.minimum.at(earliest, left, rank)
        np.minimum.at(earliest, right, rank)
        self.one_by_one = earliest[self.made] <= self.rank[:-1]

    def find(self, left: np.ndarray, right: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
        """Places of the pairs' rules (``none`` without one), of rank above ``after`` if that is given."""
        keys = pair_key(left, right)
        at = np.searchsorted(self.keys, keys)
        if self.none == 0:
            return at
        found = np.where(self.keys[np.minimum(at, self.none - 1)] == keys, at, self.none)
        while after is not None:
            early = np.flatnonzero((found < self.none) & (self.rank[found] <= after))
            if not len(early):
                break
            further = found[early] + 1
            same = self.keys[np.minimum(further, self.none - 1)] == keys[early]
            found[early] = np.where(same & (further < self.none), further, self.none)
        return found


@dataclass
class Trace:
    """What rules of rank ``since`` and above did: changes of pairs by word and rank, as arrays per round."""

    since: int
    word: list[np.ndarray] = field(default_factory=list)
    rank: list[np.ndarray] = field(default_factory=list)
    pair: list[np.ndarray] = field(default_factory=list)
    change: list[np.ndarray] = field(default_factory=list)

    def add(self, ids: np.ndarray, word: np.ndarray, places: np.ndarray, rank_of_word, change: int) -> None:
        places = np.unique(places[(places >= 0) & (places + 1 < len(ids))])
        places = places[word[places] == word[places + 1]]
        self.word.append(word[places])
        self.rank.append(rank_of_word[word[places]])
        self.pair.append(pair_key(ids[places], ids[places + 1]))
        self.change.append(np.full(len(places), change))

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = (self.word, self.rank, self.pair, self.change)
        return tuple(np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)


@dataclass
class Merged:
    """Tokens of all words in order, tokens per word, and ``(word, rank, n)``: merges by effective rank.

    The effective rank of a merge is the highest rank applied so far in its word.
    """

    ids: np.ndarray
    sizes: np.ndarray
    events: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])


def merge_words(
    ids: np.ndarray, sizes: np.ndarray, table: MergeTable, in_rank_order: bool = False, trace: Trace | None = None
) -> Merged:
    """Merges every word as far as it goes; ``ids`` has the words' tokens one after the other.

    Encoding takes the lowest rank that stands in a word, leftmost first. With ``in_rank_order`` each rule is
    applied once and never after a later one, which is what training did.
    """
    n = len(sizes)
    word = np.repeat(np.arange(n), sizes)
    ids = ids.astype(np.int64)
    rule = np.full(len(ids), table.none)
    inner = np.flatnonzero(word[1:] == word[:-1]) if len(ids) else np.zeros(0, np.int64)
    rule[inner] = table.find(ids[inner], ids[inner + 1])
    highest = np.full(n, -1)
    latest = np.full(n, -1)
    done_ids, done_words, events = [], [], []
    while len(ids):
        rank = table.rank[rule]
        first = _starts(word)
        least = np.minimum.reduceat(rank, first)
        going = least < NO_RANK
        if not going.all():
            stays = np.repeat(going, np.diff(np.r_[first, len(ids)]))
            done_ids.append(ids[~stays])
            done_words.append(word[~stays])
            ids, word, rule, rank, least = ids[stays], word[stays], rule[stays], rank[stays], least[going]
            if not len(ids):
                break
            first = _starts(word)
        own = word[first]
        latest[own] = least
        highest[own] = np.maximum(highest[own], least)
        at = np.flatnonzero(rank == latest[word])
        linked = np.r_[False, at[1:] == at[:-1] + 1]
        if linked.any():  # of overlapping places of one pair every second counts, from the left
            number = np.arange(len(at))
            at = at[(number - np.maximum.accumulate(np.where(linked, 0, number))) % 2 == 0]
        if not in_rank_order:
            alone = table.one_by_one[rule[at]]
            if alone.any():
                leftmost = np.r_[True, word[at[1:]] != word[at[:-1]]]
                at = at[leftmost | ~alone]
        merges = _starts(word[at])
        events.append((own, highest[own], np.diff(np.r_[merges, len(at)])))
        traced = at[latest[word[at]] >= trace.since] if trace is not None else at[:0]
        if len(traced):
            trace.add(ids, word, np.concatenate([traced - 1, traced, traced + 1]), latest, -1)
        ids[at] = table.made[rule[at]]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        ids, word, rule = ids[keep], word[keep], rule[keep]
        if len(traced):
            trace.add(ids, word, np.concatenate([moved[traced] - 1, moved[traced]]), latest, 1)
        look = np.concatenate([moved[at], moved[at] - 1])
        look = look[look >= 0]
        rule[look] = table.none
        look = look[look + 1 < len(ids)]
        look = look[word[look] == word[look + 1]]
        rule[look] = table.find(ids[look], ids[look + 1], latest[word[look]] if in_rank_order else None)
    ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
    word = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
    order = np.argsort(word, kind="stable")
    return Merged(ids[order], np.bincount(word, minlength=n), events)


def play_in_order(ids: np.ndarray, sizes: np.ndarray, weight: np.ndarray, merges: np.ndarray, since: int):
    """Applies every merge once, in list order, to all words; what those from ``since`` on did to the pairs.

    ``merges`` has rows of left, right and made ids. Returns the step, pair and weighted change as arrays, with sums
    per merge and neighbour, and the number of words changed. Words are linked lists over fixed places, and the
    places of every token are known, so a merge costs work for the places of its left token only.
    """
    n = len(sizes)
    # One place of no token stands before every word and one at the end.
    word = np.repeat(np.arange(n + 1), np.append(sizes + 1, 1))
    token = np.full(len(word), -1, np.int16 if merges.max(initial=0) < 2**15 and ids.max(initial=0) < 2**15 else np.int32)
    heads = np.append(0, np.cumsum(sizes + 1))
    inner = np.ones(len(word), bool)
    inner[heads] = False
    token[inner] = ids
    after = np.arange(1, len(word) + 1)
    before = np.arange(-1, len(word) - 1)
    order = np.argsort(token, kind="stable")
    kinds = _starts(token[order])
    places = dict(zip(token[order[kinds]].tolist(), np.split(order, kinds[1:])))
    weight = np.append(weight, 0)
    changed = np.zeros(n + 1, bool)
    steps, pairs, changes = [], [], []

    def add(step: int, neighbour: np.ndarray, w: np.ndarray, other: int, left: bool, sign: int) -> None:
        """The neighbours stand left or right of the ``other`` token; those that are no tokens are left out."""
        inside = neighbour >= 0
        sums = np.bincount(neighbour[inside], w[inside])  # whole numbers, exact up to 2**53
        found = np.flatnonzero(sums)
        steps.append(np.full(len(found), step))
        pairs.append(pair_key(found, np.full(len(found), other)) if left else pair_key(np.full(len(found), other), found))
        changes.append(sign * sums[found].astype(np.int64))

    for step, (left, right, made) in enumerate(merges.tolist()):
        if left not in places or right not in places:
            continue
        own = places[left]
        own = places[left] = own[token[own] == left]
        at = own[token[after[own]] == right]
        if not len(at):
            continue
        if left == right:  # of overlapping places every second counts, from the left
            linked = np.r_[False, at[1:] == after[at[:-1]]]
            number = np.arange(len(at))
            at = at[(number - np.maximum.accumulate(np.where(linked, 0, number))) % 2 == 0]
        second = after[at]
        following = after[second]
        if step >= since:
            touched = word[at]
            changed[touched] = True
            w = weight[touched].astype(np.float64)
            previous = token[before[at]]
            behind = token[following]
            # Between two places side by side lies one pair, which is counted with the one on the right.
            side = np.r_[following[:-1] == at[1:], False]
            beside = np.r_[False, side[:-1]]
            add(step, np.full(1, left), w.sum(keepdims=True), right, True, -1)
            add(step, np.where(beside, right, previous), w, left, True, -1)
            add(step, behind[~side], w[~side], right, False, -1)
            add(step, np.where(beside, made, previous), w, made, True, 1)
            add(step, behind[~side], w[~side], made, False, 1)
        token[at] = made
        token[second] = -2
        after[at] = following
        before[following] = at
        places[made] = np.unique(np.concatenate([places[made], at])) if made in places else at
    parts = (steps, pairs, changes)
    return *(np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts), int(changed.sum())


def merge_long_word(ids: list[int], table: MergeTable) -> tuple[list[int], list[int]]:
    """Tokens of one word and its merges by effective rank, with a heap over a linked list of tokens."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def push(i: int) -> None:
        j = after[i]
        if 0 <= i and j < n:
            rule = int(np.searchsorted(table.keys, ids[i] << 32 | ids[j]))
            if rule < table.none and table.keys[rule] == ids[i] << 32 | ids[j]:
                heapq.heappush(heap, (int(table.rank[rule]), i, ids[i], ids[j], int(table.made[rule])))

    for i in range(n):
        push(i)
    ranks, highest = [], -1
    while heap:
        rank, i, left, right, made = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j >= n or ids[j] != right:
            continue  # one of the two is gone or changed
        highest = max(highest, rank)
        ranks.append(highest)
        ids[i], ids[j] = made, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [t for t in ids if t is not None], ranks


def byte_column(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the length of each row."""
    if len(words) == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, kind)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


class WordEncoder:
    """A merge list in the form that tasks work with, and the words met so far in this task."""

    def __init__(self, content: dict):
        self.table = MergeTable(content["left"], content["right"], content["rank"], content["token"])
        self.start = content["start"]
        self.specials = content["specials"]
        self.whole = content["whole"]
        self._forget()

    def _forget(self) -> None:
        self.memo = {literal: i for i, literal in enumerate(self.specials)}
        self.ids = np.array(list(self.specials.values()), np.int32)
        self.sizes = np.ones(len(self.specials), np.int64)
        self.offsets = np.arange(len(self.specials))

    def start_tokens(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """One token per byte before any merge, and tokens per word; bytes without a token are left out."""
        data, sizes = byte_column(words)
        ends = np.cumsum(sizes)
        role = np.zeros(len(data), np.int64)
        filled = sizes > 0
        role[(ends - sizes)[filled]] += 1  # first byte of a word
        role[ends[filled] - 1] += 2  # last byte
        ids = self.start[role, data]
        known = ids >= 0
        if not known.all():
            row = np.repeat(np.arange(len(sizes)), sizes)
            ids, sizes = ids[known], np.bincount(row[known], minlength=len(sizes))
        return ids, sizes

    def encode(self, words: pa.Array) -> Merged:
        """Distinct words, special literals among them, without a memo."""
        ids, sizes = self.start_tokens(words)
        offsets = np.cumsum(sizes) - sizes
        fixed = self._fixed(words)
        long = [i for i in np.flatnonzero(sizes > LONG_WORD).tolist() if i not in fixed]
        if not fixed and not long:
            return merge_words(ids, sizes, self.table)
        # Words with tokens of their own and long ones are put in place of the others' results.
        apart = {i: ([t], []) for i, t in fixed.items()}
        apart |= {i: merge_long_word(ids[offsets[i] : offsets[i] + sizes[i]].tolist(), self.table) for i in long}
        plain = np.ones(len(sizes), bool)
        plain[list(apart)] = False
        merged = merge_words(ids[np.repeat(plain, sizes)], np.where(plain, sizes, 0), self.table)
        counts = merged.sizes.copy()
        events = merged.events
        for i, (own, ranks) in apart.items():
            counts[i] = len(own)
            rank, n = np.unique(np.array(ranks, np.int64), return_counts=True)
            events.append((np.full(len(rank), i), rank, n))
        result = np.empty(counts.sum(), np.int64)
        result[np.repeat(plain, counts)] = merged.ids
        place = np.cumsum(counts) - counts
        for i, (own, _) in apart.items():
            result[place[i] : place[i] + counts[i]] = own
        return Merged(result, counts, events)

    def _fixed(self, words: pa.Array) -> dict[int, int]:
        """Words that are tokens as they stand: special literals, and all entries if the model says so."""
        if not self.specials and not self.whole:
            return {}
        known = self.whole | self.specials
        return {i: known[w] for i, w in enumerate(words.to_pylist()) if w in known}

    def places(self, words: pa.Array) -> np.ndarray:
        """Per word its place in the memo: ``offsets`` and ``sizes`` of its tokens in ``ids``."""
        if len(self.memo) > MEMO_WORDS or len(self.ids) > MEMO_TOKENS:
            self._forget()
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        known = self.memo.get
        place = np.array([known(w, -1) for w in distinct.to_pylist()], np.int64)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            unseen = distinct.take(pa.array(fresh))
            merged = self.encode(unseen)
            place[fresh] = np.arange(len(self.sizes), len(self.sizes) + len(fresh))
            self.memo.update(zip(unseen.to_pylist(), place[fresh].tolist()))
            self.offsets = np.concatenate([self.offsets, len(self.ids) + np.cumsum(merged.sizes) - merged.sizes])
            self.ids = np.concatenate([self.ids, merged.ids.astype(np.int32)])
            self.sizes = np.concatenate([self.sizes, merged.sizes])
        return place[coded.indices.to_numpy(zero_copy_only=False)]

    def token_counts(self, lists: pa.ListArray) -> np.ndarray:
        """Tokens per row of a column of word lists."""
        sizes = self.sizes[place] if len(place := self.places(lists.flatten())) else np.zeros(0, np.int64)
        return _row_sums(sizes, lists)

    def tokens(self, lists: pa.ListArray) -> pa.ListArray:
        """Token ids per row of a column of word lists."""
        place = self.places(lists.flatten())
        sizes = self.sizes[place]
        total = np.cumsum(sizes)
        first = np.repeat(self.offsets[place] - (total - sizes), sizes)
        ids = self.ids[first + np.arange(len(first))]
        per_row = np.r_[0, np.cumsum(_row_sums(sizes, lists))]
        return pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), pa.array(ids, pa.int32()))


def _row_sums(values: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Sums over the rows of ``lists`` of one value per entry; a null row has none."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]
