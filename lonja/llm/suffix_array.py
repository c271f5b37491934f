"""Suffix arrays by two-stage sorting, in numpy.

A suffix is of type B if it is smaller than the suffix that follows it, else of type A. Only B
suffixes are sorted by their bytes. The A suffixes follow by scanning the buckets of first bytes in
rising order: the predecessors of what a bucket holds, taken in the bucket's order, are in order in
their own buckets, where A suffixes stand before B suffixes.
"""

from __future__ import annotations

import numpy as np

_WORD = 8


def key_words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, with zeros behind the end."""
    words = np.append(text, np.zeros(2 * _WORD, np.uint8)).astype(np.uint64)
    for width in (1, 2, 4):
        words = words[:-width] << np.uint64(8 * width) | words[width:]
    return words[: len(text) + _WORD]


def is_smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that follows; the last is not."""
    if not len(text):
        return np.zeros(0, bool)
    step = np.diff(text.astype(np.int16), append=-1)
    place = np.where(step != 0, np.arange(len(text)), len(text) - 1)
    return step[np.minimum.accumulate(place[::-1])[::-1]] > 0


def _sort_directly(positions: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the ``depth`` bytes from there on, ties as they come."""
    last = len(words) - 1
    keys = words[positions]
    order = np.argsort(keys)
    positions, keys = positions[order], keys[order]
    fresh = np.diff(keys, prepend=keys[:1] + np.uint64(1)) != 0
    for at in range(_WORD, depth, _WORD):
        group = np.cumsum(fresh)
        tied = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))
        if not len(tied):
            break
        keys = words[np.minimum(positions[tied] + at, last)]
        order = np.lexsort((keys, group[tied]))
        positions[tied] = positions[tied][order]
        keys, group = keys[order], group[tied]
        fresh[tied] = (np.diff(group, prepend=-1) != 0) | (np.diff(keys, prepend=keys[:1]) != 0)
    return positions


def suffix_array(text: np.ndarray, wanted: np.ndarray | None = None, depth: int | None = None) -> np.ndarray:
    """The wanted suffixes of a byte array in order.

    With ``depth``, suffixes that agree in so many bytes stand in any order. Suffixes that are not
    wanted are sorted only where a wanted one is induced from them.
    """
    size = len(text)
    if not size:
        return np.zeros(0, np.int64)
    wanted = np.ones(size, bool) if wanted is None else wanted
    depth = size if depth is None else depth
    smaller = is_smaller_than_next(text)
    # a wanted A suffix needs all that follow it up to the next B suffix, or to the end
    stop = np.minimum.accumulate(np.where(smaller, np.arange(size), size - 1)[::-1])[::-1]
    asked = np.flatnonzero(wanted)
    edges = np.bincount(asked, minlength=size + 1) - np.bincount(stop[asked] + 1, minlength=size + 1)
    needed = np.cumsum(edges)[:size] > 0
    induced = needed & ~smaller
    direct = _sort_directly(np.flatnonzero(needed & smaller), key_words(text), depth)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if induced[size - 1]:
        waiting[text[size - 1]].append(np.array([size - 1]))
    out = []
    for byte in range(256):
        level = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        held = []
        while len(level):  # runs of the same byte, the shorter ones first
            held.append(level)
            before = level[level > 0] - 1
            level = before[induced[before] & (text[before] == byte)]
        held.append(direct[bounds[byte] : bounds[byte + 1]])
        bucket = np.concatenate(held)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (text[before] > byte)]
        if len(before):
            letters = text[before]
            order = np.argsort(letters, kind="stable")
            before, letters = before[order], letters[order]
            cuts = np.flatnonzero(np.diff(letters)) + 1
            for part in np.split(before, cuts):
                waiting[text[part[0]]].append(part)
    order = np.concatenate(out)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """How many bytes, up to ``limit``, each suffix in order shares with the one before it."""
    shared = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return shared
    words = key_words(text)
    last = len(words) - 1
    pairs = np.arange(1, len(order))
    for at in range(0, limit, _WORD):
        left, right = order[pairs - 1] + at, order[pairs] + at
        differ = words[np.minimum(left, last)] ^ words[np.minimum(right, last)]
        same = np.zeros(len(pairs), np.int64)
        for byte in range(_WORD):
            same += differ < np.uint64(1) << np.uint64(8 * (_WORD - 1 - byte))
        same = np.where(differ == 0, _WORD, same)
        shared[pairs] += np.minimum(same, np.maximum(len(text) - np.maximum(left, right), 0))
        pairs = pairs[same == _WORD]
        if not len(pairs):
            break
    return np.minimum(shared, limit)
