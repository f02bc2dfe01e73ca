"""Best-fit packing of token sequences by hierarchical residual packing.

Documents are tokenized in Arrow batches. Whole-capacity pieces are sequences at once. All other pieces
are packed best-fit inside partitions of at most ``ITEMS_PER_TASK`` items; bins that are nearly full are
final, and the underfull ones become the items of the next, smaller level of a tree of merges. The last
level is one partition, or the level after which underfull bins no longer combine.

Defined results: a null or empty text is the end token alone. A null ``id`` is packed and stays null.
Repeated rows are packed each. A literal of an added token in a text becomes that token. Very long texts are
encoded a stretch at a time. An empty table gives no rows. Only the id and text columns are read, so
further columns may have any names.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lexigrain.functions.pretokens import Splitting, encoding_pretokens
from lexigrain.functions.symbols import byte_alphabet
from lexigrain.llm.hashing import row_groups
from lexigrain.storage import StoredTable

CAPACITY = 2048
END_ID = 0
ITEMS_PER_TASK = 200_000
#: A bin with at most this share of its room left is final before the last level.
NEARLY_FULL = 0.01
#: Pre-tokens kept with their ids in each worker.
MEMO_WORDS = 200_000
#: Pre-tokens of a batch that are encoded at once, or those of one text.
PART_WORDS = 150_000
#: Longer texts are not cut into pre-tokens by Spark but read by the library itself, a stretch at a time.
SPLIT_BYTES = 1 << 20
STRETCH = 1 << 18
#: White space of the tokenizer's own splitting rule (Unicode White_Space); a token never starts before
#: such a run and ends inside it with text on both sides, so texts may be cut where a run begins.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "fill int, members binary, done boolean, sequence_id long"
PACKED = PIECES + ", sequence_id long, offset long"


def added_tokens(definition: str) -> tuple[str, ...]:
    """Literals that the tokenizer takes out of a text before anything else."""
    return tuple(entry["content"] for entry in json.loads(definition).get("added_tokens") or ())


class WordEncoder:
    """Token ids of pre-tokens and of whole texts, as 32-bit numbers; the library's default settings hold.

    A pre-token is encoded by the library once per worker, as long as it is remembered; all later ones are
    looked up together, and their ids are taken from one array. Of a full memo stays what was met again.
    """

    _shared: dict[int, WordEncoder] = {}
    _spelling = {ord(chr(b)): c for b, c in byte_alphabet().items()}

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.literals = {s: self.tokenizer.token_to_id(s) for s in added_tokens(definition)}
        longest_first = sorted(self.literals, key=lambda s: (-len(s), s))
        # Added tokens stand for themselves wherever they are, so a stretch may end on either side of one.
        apart = "|".join(map(re.escape, longest_first)) or r"(?!)"
        self._cuts = re.compile(rf"({apart})")
        self._stretches = re.compile(rf"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")
        self.memo = {literal: i for i, literal in enumerate(self.literals)}
        self.ids = np.array(list(self.literals.values()), "<u4")
        self.sizes = np.ones(len(self.ids), np.int64)
        self.offsets = np.arange(len(self.ids))
        self.again = np.ones(len(self.ids), bool)

    def _forget(self) -> None:
        """Leaves the literals and what was met again since the last time, unless that is over half a memo."""
        first = len(self.literals)
        if np.count_nonzero(self.again) > MEMO_WORDS // 2:
            self.again[first:] = False
        kept = np.flatnonzero(self.again)
        words = list(self.memo)  # in the order of their places
        self.memo = {words[i]: k for k, i in enumerate(kept.tolist())}
        self.ids, upto = self._ids_at(kept)
        self.sizes, self.offsets = np.diff(upto), upto[:-1]
        self.again = np.arange(len(kept)) < first

    @classmethod
    def shared(cls, definition: str) -> WordEncoder:
        key = zlib.crc32(definition.encode())
        if key not in cls._shared:
            cls._shared[key] = cls(definition)
        return cls._shared[key]

    def _places(self, words: pa.Array) -> np.ndarray:
        """Per pre-token its place in the memo."""
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self.memo.get
        place = np.array([known(w, -1) for w in distinct], np.int64)
        self.again[place[place >= 0]] = True
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            tokenize, spelling = self.tokenizer.model.tokenize, self._spelling
            unseen = [distinct[i] for i in fresh.tolist()]
            ids = [[t.id for t in tokenize(w.encode("utf-8").decode("latin-1").translate(spelling))] for w in unseen]
            sizes = np.array([len(i) for i in ids], np.int64)
            place[fresh] = np.arange(len(self.sizes), len(self.sizes) + len(fresh))
            self.memo.update(zip(unseen, place[fresh].tolist()))
            self.offsets = np.concatenate([self.offsets, len(self.ids) + np.cumsum(sizes) - sizes])
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(ids), "<u4", int(sizes.sum()))])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.again = np.concatenate([self.again, np.zeros(len(sizes), bool)])
        return place[coded.indices.to_numpy(zero_copy_only=False)]

    def _ids_at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens at places of the memo, and where each one's begin and end."""
        sizes = self.sizes[place]
        upto = np.r_[0, np.cumsum(sizes)]
        first = np.repeat(self.offsets[place] - upto[:-1], sizes)
        return self.ids[first + np.arange(len(first))], upto

    def encode_lists(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of pre-tokens one after the other, and where each row's begin and end."""
        ids, upto = self._ids_at(self._places(lists.flatten()))
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return ids, upto[np.r_[0, np.cumsum(counts)]]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as bytes, from the library, in stretches cut before white space."""
        parts = []
        for part in self._cuts.split(text):
            if part in self.literals:
                parts.append(np.array([self.literals[part]], "<u4").tobytes())
                continue
            stretch, size = [], 0
            for word in itertools.chain((m.group() for m in self._stretches.finditer(part)), [None]):
                if word is None or size >= STRETCH:
                    ids = self.tokenizer.encode("".join(stretch), add_special_tokens=False).ids
                    parts.append(np.array(ids, "<u4").tobytes())
                    stretch, size = [], 0
                if word is not None:
                    stretch.append(word)
                    size += len(word)
        return b"".join(parts)


def batch_parts(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in parts whose column of words holds about ``PART_WORDS`` list entries, or one row."""
    for batch in batches:
        counts = batch.column(words).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for a, b in row_groups(np.r_[0, np.cumsum(counts, dtype=np.int64)], PART_WORDS):
            yield batch.slice(a, b - a)


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens: all full but perhaps the first."""
    first = n % capacity
    bounds = [(0, first)] if first else []
    return bounds + [(start, capacity) for start in range(first, n, capacity)]


def token_pieces(
    docs: DataFrame, definition: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of each document's ids (its tokens, then the end token).

    Spark cuts texts into pre-tokens. Texts that are very long or hold characters which Spark's Unicode tables
    do not know go to the library as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    end = np.array([END_ID], "<u4").tobytes()

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.shared(shared.value)
        for batch in batch_parts(batches, 1):
            rows: list[list] = [[], [], [], [], []]
            ids, bounds = encoder.encode_lists(batch.column(1))
            bounds = bounds.tolist()
            whole = batch.column(2)
            apart = set(np.flatnonzero(whole.is_valid().to_numpy(zero_copy_only=False)).tolist())
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                if i in apart:
                    tokens = encoder.encode(whole[i].as_py()) + end
                else:
                    tokens = ids[bounds[i] : bounds[i + 1]].tobytes() + end
                tokens = memoryview(tokens)
                for piece, (start, length) in enumerate(piece_bounds(len(tokens) // 4, capacity)):
                    crc = zlib.crc32(tokens[4 * start : 4 * (start + length)])
                    for column, value in zip(rows, (doc_id, piece, start, length, crc)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    text = F.col(text_col).cast("string")
    apart = (F.octet_length(text) > SPLIT_BYTES) | text.rlike(r"\p{Cn}")
    split = encoding_pretokens(text, Splitting(added_tokens(definition)))
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.when(~apart, split).alias("words"), F.when(apart, text).alias("text")
    )
    return source.mapInArrow(pieces, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: positions of ``sizes`` by bin. Open bins lie in stacks by room left."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    rooms = 0  # bit r is set if some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = (fitting & -fitting).bit_length() - 1 + size
            chosen = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
            bins[chosen].append(i)
        else:
            room, chosen = capacity, len(bins)
            bins.append([i])
        if room > size:
            stacks[room - size].append(chosen)
            rooms |= 1 << (room - size)
    return bins


def _as_items(pieces: DataFrame) -> DataFrame:
    """Each piece as a bin of its own, its members packed as six 64-bit numbers."""

    def items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0)
            table = np.stack(
                [
                    doc.fill_null(0).to_numpy(zero_copy_only=False),
                    *(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1, 5)),
                    doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                ],
                axis=1,
            ).astype("<i8")
            n = len(table)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(table[:, 3], pa.int32()),
                    pa.array([row.tobytes() for row in table], pa.binary()),
                    pa.array([False] * n),
                    pa.nulls(n, pa.int64()),
                ],
                names=["fill", "members", "done", "sequence_id"],
            )

    return pieces.mapInArrow(items, BINS)


def _merge(items: DataFrame, capacity: int, level: int, last: bool) -> DataFrame:
    """Packs each partition's items; the nearly full bins, or all on the last level, are final."""
    room_left = 0 if last else int(capacity * NEARLY_FULL)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills, members = [], []
        for batch in batches:
            fills.append(batch.column(0).to_numpy(zero_copy_only=False))
            members += batch.column(1).to_pylist()
        if not members:
            return
        sizes = np.concatenate(fills)
        bins = best_fit(sizes, capacity)
        first = (level << 56) + (TaskContext.get().partitionId() << 28)
        for a in range(0, len(bins), 10_000):
            part = bins[a : a + 10_000]
            total = np.array([int(sizes[b].sum()) for b in part])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(total, pa.int32()),
                    pa.array([b"".join(members[i] for i in b) for b in part], pa.binary()),
                    pa.array(last | (capacity - total <= room_left)),
                    pa.array(first + a + np.arange(len(part)), pa.int64()),
                ],
                names=["fill", "members", "done", "sequence_id"],
            )

    return items.mapInArrow(merge, BINS)


def _members(bins: DataFrame) -> DataFrame:
    """One row per piece of finished bins, with its place in the sequence."""

    def unfold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            counts = np.array([len(b) // 48 for b in blobs], np.int64)
            table = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 6)
            ends = np.cumsum(table[:, 3])
            firsts = np.cumsum(counts) - counts
            before = (ends - table[:, 3])[firsts] if len(firsts) else ends
            offset = ends - table[:, 3] - np.repeat(before, counts)
            sequence = np.repeat(batch.column(3).to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(table[:, 0], pa.int64(), mask=table[:, 5] > 0),
                    pa.array(table[:, 1], pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (table[:, 2], table[:, 3], table[:, 4], sequence, offset)),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return bins.mapInArrow(unfold, PACKED)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """Assigns pieces (``PIECES``) to sequences of at most ``capacity`` tokens."""
    full = pieces.where(F.col("length") == capacity).select(
        *pieces.columns,
        # Level 127 is never reached by the tree, so these numbers are free.
        (F.lit(127 << 56) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    rest = pieces.where(F.col("length") < capacity)
    done, waiting = [full], rest.count()
    items = _as_items(rest)
    for level in itertools.count():
        tasks = max(1, -(-waiting // items_per_task))
        bins = StoredTable(_merge(items.repartition(tasks), capacity, level, tasks == 1), "bins")
        done.append(_members(bins.df.where("done")))
        left = bins.df.where("not done")
        before, waiting = waiting, left.count()
        if waiting == 0:
            break
        if waiting > 0.9 * before:  # they no longer combine
            done.append(_members(left))
            break
        items = left
    packed = done[0]
    for df in done[1:]:
        packed = packed.unionByName(df)
    return packed


def pack_documents(
    docs: DataFrame,
    definition: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    items_per_task: int = ITEMS_PER_TASK,
) -> DataFrame:
    """Tokenizes and packs whole documents; see the module's text for the defined cases."""
    pieces = StoredTable(token_pieces(docs, definition, capacity, id_col, text_col), "pieces")
    return pack_pieces(pieces.df, capacity, items_per_task)
