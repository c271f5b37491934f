"""Byte-level BPE encoding and decoding by speculation and verification.

A task cuts its texts into words with array operations, and encodes each distinct word once:

1. Speculate: a greedy longest match proposes tokens, for all words at a time.
2. Verify: a proposal is right if every two neighbours are compatible, that is, if merging the
   bytes of the two gives these two tokens again. Each distinct pair is tested once.
3. Only words with an incompatible pair undergo the exact merges, again all at a time.

Ids are those of the ``tokenizers`` library with the same file, without its post-processing:
strings of special tokens in a text become the special token, as there. A worker keeps the words
it has met, by a 64-bit hash of their bytes, and the pairs it has tested; past ``KEPT_WORDS`` words
it begins anew.

Defined results: a null text is an empty one and has no tokens; null ids decode to an empty text,
as do ids outside the vocabulary; bytes that are not UTF-8 decode to U+FFFD. Rows stay one by one,
with whatever other columns they have; columns named like the results are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lonja.llm.text import bounded, ragged, utf8, word_hashes

KEPT_WORDS = 1 << 20
#: Words of more bytes are merged one by one, by a queue.
LONG_WORD = 512
SLICE_BYTES = 2 << 20

_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
_NO_MERGE = np.iinfo(np.int64).max


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    for pattern, number in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\p{White_Space}+", _SPACE)):
        for found in regex.finditer(pattern, text):
            table[points[found.start()] : points[found.end() - 1] + 1] = number
    return table


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def _starts(points: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Flags of the code points that begin a word. ``parts`` flags where an own text begins.

    Words are a contraction ('s 't 're 've 'm 'll 'd), or letters, numbers or other characters with
    one space before them, or white space; of white space before a word, the last character is a
    word of its own unless it is the space that belongs to the next word.
    """
    count = len(points)
    kind = _classes()[points]
    space = kind == _SPACE
    start = np.ones(count, dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    # a space directly before other things opens their word
    start[1:] &= ~((points[:-1] == 0x20) & ~space[1:])
    # the last of several white-space characters, before something else of the same text
    last = np.zeros(count, dtype=bool)
    last[:-1] = space[:-1] & ~space[1:] & ~parts[1:count]
    start |= last
    start |= parts[:count]
    quotes = np.flatnonzero((points == 0x27) & start)
    if len(quotes):
        ends = np.append(parts, [True, True, True])
        ahead = np.append(points, [0, 0, 0])
        one, two = ahead[quotes + 1], ahead[quotes + 2]
        joined = ~ends[quotes + 1]
        short = quotes[joined & np.isin(one, [ord(c) for c in "stmd"])]
        pairs = [(ord(p[0]), ord(p[1])) for p in ("re", "ve", "ll")]
        matches = np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])
        long = quotes[joined & ~ends[quotes + 2] & matches]
        start[np.concatenate([short + 1, long + 1, long + 2])] = False
        after = np.concatenate([short + 2, long + 3])
        start[after[after < count]] = True
    return start


class _Vocabulary:
    """The tokens and merges of a tokenizer file, and the words already encoded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, symbols = content["model"], _byte_symbols()
        vocabulary = model["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.size = max([*vocabulary.values(), *self.special.values()]) + 1
        spelled = [b""] * self.size
        for token, number in vocabulary.items():
            spelled[number] = bytes(symbols[c] for c in token)
        for token, number in self.special.items():
            spelled[number] = token.encode()
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.array([len(b) for b in spelled], dtype=np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.of_byte = np.array([vocabulary[c] for c in sorted(symbols, key=symbols.get)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        if self.special:
            self.pattern = re.compile(b"|".join(re.escape(t.encode()) for t in sorted(self.special, key=len, reverse=True)))
        self._forget()
        self._build_trie(spelled, set(vocabulary.values()))

    def _build_trie(self, spelled: list[bytes], ordinary: set[int]) -> None:
        """Edges (node, byte) -> node, for tokens that their own bytes merge to."""
        numbers = np.array(sorted(ordinary))
        lengths = self.lengths[numbers]
        ids, counts = self.merge(self.bytes[ragged(self.first[numbers], lengths)], lengths)
        own = counts == 1
        own[own] = ids[(np.cumsum(counts) - counts)[own]] == numbers[own]
        nodes: dict[bytes, int] = {b"": 0}
        edges, token_at = [], [-1]
        for number in numbers[own].tolist():
            token = spelled[number]
            for end in range(1, len(token) + 1):
                if token[:end] not in nodes:
                    nodes[token[:end]] = len(token_at)
                    edges.append((nodes[token[: end - 1]] << 8 | token[end - 1], len(token_at)))
                    token_at.append(-1)
            token_at[nodes[token]] = number
        edges.sort()
        self.edges = np.array([e for e, _ in edges], np.int64)
        self.child = np.array([n for _, n in edges], np.int64)
        self.token_at = np.array(token_at, np.int64)

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_at = np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)
        self.store_first = np.zeros(0, np.int64)
        self.store_length = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.compatible = np.zeros(0, bool)

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merges of many words: the ids, and how many each word has.

        The pair that was learned first is merged first, wherever it stands in a word.
        """
        long = np.flatnonzero(lengths > LONG_WORD)
        if len(long):
            first = np.cumsum(lengths) - lengths
            short = np.flatnonzero(lengths <= LONG_WORD)
            ids, counts = self.merge(data[ragged(first[short], lengths[short])], lengths[short])
            alone = [self._merge_long(data[first[n] : first[n] + lengths[n]]) for n in long]
            word = np.concatenate([np.repeat(short, counts), np.repeat(long, [len(a) for a in alone])])
            ids = np.concatenate([ids, *alone])
            return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(lengths))
        symbols = self.of_byte[data]
        word = np.repeat(np.arange(len(lengths)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), _NO_MERGE)
            if len(symbols) > 1:
                keys = symbols[:-1] * self.size + symbols[1:]
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                found = (self.keys[at] == keys) & (word[:-1] == word[1:])
                rank[:-1] = np.where(found, self.ranks[at], _NO_MERGE)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(word)))
            over = least == _NO_MERGE
            done.append((symbols[over], word[over]))
            chosen = np.flatnonzero((rank == least) & ~over)
            if len(chosen):  # of overlapping pairs in a row, every other one
                run = np.diff(chosen, prepend=-2) != 1
                place = np.arange(len(chosen))
                chosen = chosen[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
                symbols[chosen] = self.merged[rank[chosen]]
            stays = ~over
            stays[chosen + 1] = False
            symbols, word = symbols[stays], word[stays]
        ids = np.concatenate([s for s, _ in done]) if done else symbols
        word = np.concatenate([w for _, w in done]) if done else word
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(lengths))

    def _merge_long(self, data: np.ndarray) -> np.ndarray:
        """Exact merges of one word, by a queue of its pairs in the order of their ranks."""
        ranks = self.rank_of
        symbols = self.of_byte[data].tolist()
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]

        def pair(at: int) -> tuple[int, int, int] | None:
            key = symbols[at] * self.size + symbols[after[at]] if after[at] >= 0 else -1
            return (ranks[key], at, key) if key in ranks else None

        queue = [p for p in map(pair, range(len(symbols))) if p]
        heapq.heapify(queue)
        while queue:
            rank, at, key = heapq.heappop(queue)
            following = after[at]
            if symbols[at] < 0 or following < 0 or symbols[at] * self.size + symbols[following] != key:
                continue
            symbols[at], symbols[following] = int(self.merged[rank]), -1
            after[at] = after[following]
            if after[at] >= 0:
                before[after[at]] = at
            for place in (before[at], at):
                if place >= 0 and (found := pair(place)):
                    heapq.heappush(queue, found)
        return np.array([s for s in symbols if s >= 0], np.int64)

    def _speculate(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches: the ids, and how many each word has."""
        ends = np.repeat(np.cumsum(lengths), lengths)
        longest, token = np.zeros(len(data), np.int64), np.full(len(data), -1)
        place, node, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        while len(place):
            keys = node << 8 | data[place + depth]
            at = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
            goes = self.edges[at] == keys
            place, node, depth = place[goes], self.child[at[goes]], depth + 1
            here = self.token_at[node]
            full = here >= 0
            longest[place[full]], token[place[full]] = depth, here[full]
            more = place + depth < ends[place]
            place, node = place[more], node[more]
        first = np.cumsum(lengths) - lengths
        proposed = np.zeros(len(data), dtype=bool)
        place, stop = first, first + lengths
        while len(place):
            proposed[place] = True
            place = place + longest[place]
            more = place < stop
            place, stop = place[more], stop[more]
        counts = np.add.reduceat(proposed, first, dtype=np.int64) if len(first) else lengths
        return token[proposed], counts

    def _agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the pairs of tokens stay as they are when their bytes are merged."""
        pairs, which = np.unique(left * self.size + right, return_inverse=True)
        new = pairs[~np.isin(pairs, self.pairs, assume_unique=True)]
        if len(new):
            both = np.stack([new // self.size, new % self.size], axis=1)
            spans = self.lengths[both]
            data = self.bytes[ragged(self.first[both].ravel(), spans.ravel())]
            ids, counts = self.merge(data, spans.sum(axis=1))
            same = counts == 2
            begin = (np.cumsum(counts) - counts)[same]
            same[same] = (ids[begin] == both[same, 0]) & (ids[begin + 1] == both[same, 1])
            every, verdicts = np.append(self.pairs, new), np.append(self.compatible, same)
            order = np.argsort(every)
            self.pairs, self.compatible = every[order], verdicts[order]
        return self.compatible[np.searchsorted(self.pairs, pairs)][which]

    def encode_words(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that are not empty, and how many each word has."""
        ids, counts = self._speculate(data, lengths)
        word = np.repeat(np.arange(len(counts)), counts)
        neighbours = np.flatnonzero(word[1:] == word[:-1])
        wrong = np.zeros(len(counts), dtype=bool)
        if len(neighbours):
            agree = self._agree(ids[neighbours], ids[neighbours + 1])
            wrong[word[neighbours[~agree]]] = True
        if wrong.any():
            first = np.cumsum(lengths) - lengths
            exact, n_exact = self.merge(data[ragged(first[wrong], lengths[wrong])], lengths[wrong])
            stays = ~wrong[word]
            ids = np.concatenate([ids[stays], exact])
            word = np.concatenate([word[stays], np.repeat(np.flatnonzero(wrong), n_exact)])
            ids, counts = ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(counts))
        return ids, counts

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the ids of each word are kept; words not met before are encoded."""
        hashes, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        met = self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        if not met.all():
            if len(self.known) > KEPT_WORDS:
                self._forget()
                met[:] = False
            new = first[~met]
            lengths = (ends - starts)[new]
            ids, counts = self.encode_words(data[ragged(starts[new], lengths)], lengths)
            begin = len(self.store) + np.cumsum(counts) - counts
            every = np.append(self.known, hashes[~met])
            order = np.argsort(every)
            self.known = every[order]
            self.known_at = np.append(self.known_at, len(self.store_first) + np.arange(len(new)))[order]
            self.store_first = np.append(self.store_first, begin)
            self.store_length = np.append(self.store_length, counts)
            self.store = np.append(self.store, ids.astype(np.int32))
            at = np.searchsorted(self.known, hashes)
        return self.known_at[at][which]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids begin (one more entry: the end)."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        whole = data.tobytes()
        at = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
        parts = np.zeros(len(points) + 1, dtype=bool)
        parts[np.searchsorted(at, offsets)] = True
        own = []
        if self.special:
            for found in self.pattern.finditer(whole):
                if np.searchsorted(offsets, found.start(), "right") == np.searchsorted(offsets, found.end() - 1, "right"):
                    own.append((found.start(), found.end(), self.special[found.group().decode()]))
                    parts[np.searchsorted(at, [found.start(), found.end()])] = True
        starts = at[_starts(points, parts)]
        ends = np.append(starts[1:], len(data))
        if own:
            # what a special token covers is one word, set apart from the others
            begin, end = np.array([b for b, _, _ in own]), np.array([e for _, e, _ in own])
            covered = np.searchsorted(begin, starts, "right") - 1
            inside = (covered >= 0) & (starts < end[covered])
            lead = inside & np.isin(starts, begin)
            ends[lead] = end[covered[lead]]
            stays = ~inside | lead
            starts, ends, lead = starts[stays], ends[stays], lead[stays]
            lengths, flat_at = np.ones(len(starts), np.int64), np.zeros(len(starts), np.int64)
            kept = self._words(data, starts[~lead], ends[~lead]) if (~lead).any() else np.zeros(0, int)
            lengths[~lead], flat_at[~lead] = self.store_length[kept], self.store_first[kept]
            flat_at[lead] = len(self.store) + np.arange(len(own))
            store = np.append(self.store, np.array([i for _, _, i in own], np.int32))
        else:
            kept = self._words(data, starts, ends)
            lengths, flat_at, store = self.store_length[kept], self.store_first[kept], self.store
        before = np.concatenate([[0], np.cumsum(lengths)])
        return store[ragged(flat_at, lengths)], before[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ranges of ids."""
        known = (ids >= 0) & (ids < self.size)
        ids = np.where(known, ids, 0)
        lengths = np.where(known, self.lengths[ids], 0)
        data = self.bytes[ragged(self.first[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> _Vocabulary:
    """One per worker and file. The file must be at this path on every machine."""
    return _Vocabulary(path)


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), values], names=[*names, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of a text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in bounded(batches, text, SLICE_BYTES):
            flat, offsets = words.encode(*utf8(batch.column(text)))
            lists = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(flat))
            yield _with_column(batch, ids, lists)

    return df.mapInArrow(run, _schema(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of a column of token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                lists = part.column(ids)
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = words.decode(flat, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]))
                yield _with_column(part, text, pa.array(texts, pa.string()))

    return df.mapInArrow(run, _schema(df, text, T.StringType()))


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and the text that they decode to."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return decode(encode(texts, path).drop("text"), path)
