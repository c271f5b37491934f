"""Text columns as byte arrays: bounded slices, words and their hashes, for code inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: true for the bytes in the ranges, both ends included."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words of letters and digits; every byte beyond ASCII is part of a word.
ALPHANUMERIC = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Words between white space.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes, and where each begins (one more entry: the end).

    A null is an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + len(column) + 1)
    offsets = offsets[column.offset :]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes of text each, or of a single row."""
    ends = utf8(texts)[1][1:]
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, last - first
        first = last


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    for first, rows in _cuts(texts, limit):
        yield texts.slice(first, rows)


def bounded(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has at most ``limit`` bytes of text, or is a single row.

    What a task holds beside its batch then depends on the limit, not on how long texts are.
    """
    for batch in batches:
        for first, rows in _cuts(batch.column(column), limit):
            yield batch.slice(first, rows)


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, kept: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end; a word is a longest run of kept bytes inside one text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = kept[data]
    filled = np.flatnonzero(np.diff(offsets))
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cut = offsets[filled]
    opens[cut] = inside[cut]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    cut = offsets[filled + 1] - 1
    closes[cut] = inside[cut]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values spread evenly (a bijection)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def powers(count: int, step: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(count, step, dtype=np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, equal for equal bytes anywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(lengths.sum()) - np.repeat(first, lengths)
    taken = data[within + np.repeat(starts, lengths)]
    values = _BYTE_VALUES[taken] * powers(int(lengths.max()))[within]
    return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of ``word_hashes`` in a step per span, also where spans overlap."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[data] * powers(len(data)))])
    back = powers(len(data) + 1, np.uint64(pow(int(_STEP), -1, 1 << 64)))
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)
