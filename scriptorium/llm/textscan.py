"""Vectorised scanning of UTF-8 text inside Arrow batches.

Shared by the operators of this subpackage that look at words. A word is a
maximal run of bytes outside ``\\x20\\x09-\\x0D`` after lower-casing A-Z only,
so that no locale or Unicode table is involved. Rows are worked through in
slices of about a megabyte, which keeps the temporary arrays small however many
rows a batch has; one very long text is a slice of its own, at some 60 bytes of
temporary memory per byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from scriptorium.llm.shared import lean

SLICE_BYTES, SLICE_ROWS = 1 << 20, 4096
SHINGLE_WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, target: int = SLICE_BYTES, most: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of up to ``most`` rows that hold about ``target`` bytes together, one row at least."""
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + target, "right")) - 1
        hi = min(rows, max(hi, lo + 1), lo + most)
        yield lo, hi
        lo = hi


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of consecutive rows, and how many words each row has.

    ``offsets`` counts from 0 over ``data``; no word crosses a row's end. ``letters`` says for each byte whether words have it.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    word = letters[data]
    before = np.empty(len(word) + 1, bool)
    before[0], before[1:] = False, word
    after = np.empty(len(word) + 1, bool)
    after[:-1], after[-1] = word, False
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    first = word & ~before[:-1]
    after_next = after[1:].copy()
    after_next[edges - 1] = False
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(word & ~after_next) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse. Those for a common slice are kept; longer tables, for very long texts, go again."""
    found, size = _powers, SLICE_BYTES + 4096
    if len(found[0]) < n:
        found = []
        for base in (_BASE, _INVERSE):
            table = np.full(max(n, size), base, np.uint64)
            table[0] = 1
            found.append(np.multiply.accumulate(table))
        if n <= size:
            _powers[:] = found
    return found[0][:n], found[1][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word: a polynomial in a fixed odd base, finalised with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M2)


def hash_word(word: str) -> int:
    """The hash that :func:`word_hashes` gives one word."""
    data = lower(np.frombuffer(word.encode(), np.uint8))
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def hashed_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows: its first and last row, the hashes of its words, and the words in each row."""
    lean()
    data, offsets = utf8(column)
    for lo, hi in slices(offsets):
        part = lower(data[offsets[lo] : offsets[hi]])
        starts, ends, counts = word_spans(part, offsets[lo : hi + 1] - offsets[lo])
        yield lo, hi, word_hashes(part, starts, ends), counts


def ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each row, for rows of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The hash of each run of SHINGLE_WORDS words of one text; of all its words, if there are fewer; none without words."""
    n = min(SHINGLE_WORDS, len(hashes))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out + hashes[k : len(hashes) - n + 1 + k])
    return out


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of so many words of consecutive rows, sorted within each row, and the size of each row's set."""
    ends = np.cumsum(counts)
    values, rows = [], []
    full = np.flatnonzero(counts >= words)
    if len(full):
        size = counts[full] - words + 1
        at = np.repeat((ends - counts)[full], size) + ragged(size)
        out = np.zeros(len(at), np.uint64)
        for k in range(words):
            out = mix(out + hashes[at + k])
        values.append(out)
        rows.append(np.repeat(full, size))
    for n in range(1, words):
        few = np.flatnonzero(counts == n)
        if len(few):
            out = np.zeros(len(few), np.uint64)
            for k in range(n):
                out = mix(out + hashes[(ends - counts)[few] + k])
            values.append(out)
            rows.append(few)
    if not values:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.argsort(value)
    order = order[np.argsort(row[order], kind="stable")]
    value, row = value[order], row[order]
    keep = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])
    return value[keep], np.bincount(row[keep], minlength=len(counts))
