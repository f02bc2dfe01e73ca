"""Hashes of words and word shingles over Arrow batches, computed on the UTF-8 bytes with NumPy.

A word's hash is a polynomial in its bytes modulo 2**64, taken from running sums over a whole piece of
the batch, then mixed. Texts are worked through in pieces of about ``PIECE`` bytes cut between words,
so that memory follows the piece and not the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalizer of a 64-bit hash; a bijection for each seed."""
    z = values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64; pieces of usual size share one table."""
    kept = _powers.get(base)
    if kept is not None and len(kept) >= n:
        return kept[:n]
    size = max(n, PIECE + 1)
    table = np.full(size, base, np.uint64)
    table[0] = 1
    np.multiply.accumulate(table, out=table)
    if size == PIECE + 1:
        _powers[base] = table
    return table[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its ``len + 1`` offsets, without a copy; nulls are empty."""
    # What earlier batches left goes back to the system, as workers outlive their tasks.
    pa.default_memory_pool().release_unused()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_classes(separators: bytes) -> np.ndarray:
    """Table from a byte to 0 (separator) or to its value plus one, with A-Z in lower case."""
    table = np.arange(256, dtype=np.uint16)
    table[ord("A") : ord("Z") + 1] += 32
    table += 1
    table[list(separators)] = 0
    return table


#: Words between ASCII white space.
SPACED = byte_classes(bytes([0x20, *range(0x09, 0x0E)]))


def _pieces(symbols: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most about ``PIECE`` bytes that end between words or texts."""
    start, n = 0, len(symbols)
    while start < n:
        end = min(start + PIECE, n)
        if end < n:
            row = offsets[np.searchsorted(offsets, end, side="right") - 1]
            if row > start:
                end = int(row)
            else:
                blanks = np.flatnonzero(symbols[start:end] == 0)
                if len(blanks):
                    end = start + int(blanks[-1]) + 1
                else:
                    limit = int(offsets[np.searchsorted(offsets, end, side="right")])
                    blanks = np.flatnonzero(symbols[end:limit] == 0)
                    end = end + int(blanks[0]) + 1 if len(blanks) else limit
        yield start, end
        start = end


def hash_words(
    data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = SPACED
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the word offsets of the texts (``len + 1``), and where each word starts in ``data``."""
    hashes, starts = [], []
    symbols_all = classes[data] if len(data) <= 4 * PIECE else None
    begins = offsets[:-1]
    for a, b in _pieces(symbols_all if symbols_all is not None else (classes[data] > 0).view(np.uint8), offsets):
        symbols = symbols_all[a:b] if symbols_all is not None else classes[data[a:b]]
        inside = symbols > 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = begins[np.searchsorted(begins, a, "left") : np.searchsorted(begins, b, "left")] - a
        first[cuts] |= inside[cuts]
        last[cuts[cuts > 0] - 1] |= inside[cuts[cuts > 0] - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        sums = np.cumsum(symbols.astype(np.uint64) * powers(_BASE, b - a))
        value = sums[e]
        value -= np.where(s > 0, sums[np.maximum(s, 1) - 1], np.uint64(0))
        hashes.append(mix(value * powers(_BASE_INVERSE, b - a)[s]))
        starts.append(s + a)
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    places = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return words, np.searchsorted(places, offsets), places


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct sorted hashes of the runs of ``size`` words of one text; a shorter text is one run."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total += mix(words[k : n - width + 1 + k], k + 1)
    return np.unique(mix(total))


def row_groups(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``limit`` bytes; a longer text has a range of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, end
        row = end
