"""Benchmark decontamination by a distributed positional inverted index.

Documents are indexed in segments of bounded size, as many as the corpus needs. A segment holds
the hashed terms of its documents in order, and for each term the positions of its words. The
segments are written to the shared folder, so that searches for any number of benchmarks read
the postings and not the texts.

A search deals the phrases into blocks of bounded size and takes one after the other: the driver
sends a block to the executors, and its matches are written before the next one is read. In each
segment a search drops the phrases that have a term the segment lacks, takes the postings of each
remaining phrase's rarest term, moves them back by the term's place in the phrase, and intersects
them with the postings of the other terms at their places. What is left are the exact occurrences.
With ``slack`` over 0 a term may stand up to that many words beside its place (proximity).

Terms are hashes of 64 bits less those that number the words of a segment (44 bits are left of
the default segment), so a wrong match needs a word that differs and yet has the same hash.

Defined results: a null text is an empty one, which has no words and no matches; an item without
words has no windows; rows that repeat a doc_id are judged one by one, and a null doc_id is
carried along; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.text import (
    ALPHANUMERIC,
    ASCII_LOWER,
    bounded,
    ragged,
    utf8,
    word_bounds,
    word_hashes,
)
from lonja.runtime import release, releases_staged, stage

WINDOW = 13
SEGMENT_BYTES = 4 << 20
#: Words of phrases that one pass over the index looks for.
PHRASE_BLOCK = 1 << 21

_SEGMENT = "doc_ids array<bigint>, starts binary, terms binary, firsts binary, places binary"


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and how many words stand before each text (and in all)."""
    data, offsets = utf8(texts)
    starts, ends = word_bounds(data, offsets, ALPHANUMERIC)
    return word_hashes(ASCII_LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def _index_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, limit=SEGMENT_BYTES):
        hashes, starts = _terms(batch.column("text"))
        bits = np.uint64(max(20, int(len(hashes)).bit_length()))
        packed = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
        packed.sort()
        terms = packed >> bits
        firsts = np.flatnonzero(np.diff(terms, prepend=~terms[:1])) if len(terms) else np.zeros(0, int)
        places = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([starts.astype(np.uint32).tobytes()]),
                pa.array([(terms[firsts] << bits).tobytes()]),
                pa.array([firsts.astype(np.uint32).tobytes()]),
                pa.array([places.tobytes()]),
            ],
            names=["doc_ids", "starts", "terms", "firsts", "places"],
        )


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of all texts, written to the shared folder: one row per segment."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    segments = texts.mapInArrow(_index_segments, _SEGMENT)
    return stage(segments.withColumn("segment", F.monotonically_increasing_id()), "positional-index")


def phrase_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct windows of each item: ``item_id`` and the hashed ``terms`` in order.

    A window is ``window`` consecutive words; an item with fewer, but not none, is one window.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, limit=SEGMENT_BYTES // 16):
            hashes, starts = _terms(batch.column("text"))
            counts = np.diff(starts)
            windows = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
            item = np.repeat(np.arange(len(counts)), windows)
            lengths = np.minimum(counts, window)[item]
            begin = ragged(starts[:-1], windows)
            terms = hashes[ragged(begin, lengths)].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(item)), pa.ListArray.from_arrays(ends, terms)],
                names=["item_id", "terms"],
            )

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(cut, "item_id bigint, terms array<bigint>").distinct()


class _Phrases:
    """A block of phrases, as padded rows of hashed terms."""

    def __init__(self, block: pa.Table):
        self.items = block["item_id"].to_pylist()
        terms = block["terms"].combine_chunks()
        self.lengths = terms.value_lengths().to_numpy().astype(np.int64)
        longest = int(self.lengths.max())
        flat = terms.flatten().to_numpy().view(np.uint64)
        self.distinct, which = np.unique(flat, return_inverse=True)
        self.terms = np.full((len(self.items), longest), -1, dtype=np.int64)
        self.terms[np.arange(longest) < self.lengths[:, None]] = which


def _deal(phrases: DataFrame) -> tuple[DataFrame, int]:
    """The phrases that have terms, staged by number of ``block``, and how many blocks there are.

    A phrase's hash decides its block, so blocks have ``PHRASE_BLOCK`` words, give or take the
    chance of the hash.
    """
    held = stage(phrases.select("item_id", "terms").where(F.size("terms") > 0), "phrases")
    words = held.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-words // PHRASE_BLOCK))
    block = F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)).cast("int")
    # in order of the blocks, so that reading one skips the others' row groups
    numbered = held.withColumn("block", block).repartitionByRange("block").sortWithinPartitions("block")
    dealt = stage(numbered, "phrase-blocks")
    release(held)
    return dealt, blocks


def _search_blocks(index: DataFrame, phrases: DataFrame, search: Callable, schema: str) -> DataFrame:
    """The rows of ``search(block, batches)`` over the index, for each block of the phrases.

    A block's rows are written before the next block is read, so that the driver and the executors
    hold one block at a time.
    """
    spark = index.sparkSession
    found = spark.createDataFrame([], schema)
    dealt, blocks = _deal(phrases)
    for number in range(blocks):
        block = dealt.where(F.col("block") == number).select("item_id", "terms").toArrow()
        if not block.num_rows:
            continue
        held = spark.sparkContext.broadcast(_Phrases(block))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            return search(held.value, batches)

        found = found.union(stage(index.mapInArrow(run, schema), "matches"))
        held.destroy()
    release(dealt)
    return found


class _Segment:
    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.starts = np.frombuffer(row["starts"], np.uint32).astype(np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        firsts = np.frombuffer(row["firsts"], np.uint32).astype(np.int64)
        self.places = np.frombuffer(row["places"], np.uint32).astype(np.int64)
        self.firsts = firsts
        self.counts = np.diff(firsts, append=len(self.places))
        self.bits = np.uint64(max(20, int(len(self.places)).bit_length()))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each term in this segment, or -1."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        wanted = hashes >> self.bits << self.bits
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, at, -1)

    def term_at(self) -> np.ndarray:
        """The term at each position: the postings turned round."""
        out = np.empty(len(self.places), np.int64)
        out[self.places] = np.repeat(np.arange(len(self.terms)), self.counts)
        return out

    def search(self, phrases: _Phrases, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase and first position of each match, and whether it is exact."""
        numbers = np.append(self.lookup(phrases.distinct), -2)
        terms = numbers[phrases.terms]
        alive = np.flatnonzero((terms != -1).all(axis=1))
        nothing = np.zeros(0, np.int64)
        if not len(alive):
            return nothing, nothing, nothing.astype(bool)
        terms, lengths = terms[alive], phrases.lengths[alive]
        counts = np.where(terms >= 0, np.append(self.counts, 0)[terms], np.iinfo(np.int64).max)
        rarest = counts.argmin(axis=1)
        term = terms[np.arange(len(terms)), rarest]
        listed = self.counts[term]
        which = np.repeat(np.arange(len(terms)), listed)
        begin = self.places[ragged(self.firsts[term], listed)] - rarest[which]
        exact = np.ones(len(which), bool)
        text = np.searchsorted(self.starts, begin + rarest[which], side="right") - 1
        fits = (begin >= self.starts[text]) & (begin + lengths[which] <= self.starts[text + 1])
        which, begin, exact, text = which[fits], begin[fits], exact[fits], text[fits]
        here = self.term_at()
        for place in np.argsort(np.where(counts == np.iinfo(np.int64).max, 0, counts).sum(axis=0)):
            wanted = terms[which, place]
            unused = wanted == -2
            spot = np.where(unused, begin, begin + place)
            at_place = unused | (here[spot] == wanted)
            found = at_place.copy()
            for shift in [s for n in range(1, slack + 1) for s in (-n, n)]:
                moved = spot + shift
                inside = (moved >= self.starts[text]) & (moved < self.starts[text + 1])
                found |= inside & (here[np.where(inside, moved, 0)] == wanted)
            which, begin, text = which[found], begin[found], text[found]
            exact = exact[found] & at_place[found]
        return alive[which], begin, exact


_MATCHES = "doc_id bigint, item_id bigint, first_word bigint, n_words bigint, exact boolean"


def phrase_matches(index: DataFrame, phrases: DataFrame, slack: int = 0) -> DataFrame:
    """Where each phrase (``item_id``, ``terms``) occurs in the indexed documents.

    One row per match; ``exact`` tells a phrase from words that only stand near their places. A
    phrase without terms has no matches.
    """

    def search(block: _Phrases, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment = _Segment(batch.slice(row, 1).to_pylist()[0])
                which, begin, exact = segment.search(block, slack)
                text = np.searchsorted(segment.starts, begin, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([segment.doc_ids[t] for t in text], pa.int64()),
                        pa.array([block.items[w] for w in which], pa.int64()),
                        pa.array(begin - segment.starts[text]),
                        pa.array(block.lengths[which]),
                        pa.array(exact),
                    ],
                    names=["doc_id", "item_id", "first_word", "n_words", "exact"],
                )

    return _search_blocks(index, phrases, search, _MATCHES)


_HITS = "segment bigint, place int, hits array<bigint>, items array<bigint>"


def _document_hits(block: _Phrases, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words hit in each document that has some, and the items that hit them."""
    for batch in batches:
        for row in range(batch.num_rows):
            values = batch.slice(row, 1).to_pylist()[0]
            segment = _Segment(values)
            which, begin, _ = segment.search(block, 0)
            text = np.searchsorted(segment.starts, begin, side="right") - 1
            hit = np.unique(text)
            hits, items = [], []
            for t in hit:
                mine = text == t
                words = np.unique(ragged(begin[mine], block.lengths[which[mine]]))
                hits.append((words - segment.starts[t]).tolist())
                items.append(sorted({block.items[w] for w in which[mine]} - {None}))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([values["segment"]] * len(hit), pa.int64()),
                    pa.array(hit.astype(np.int32)),
                    pa.array(hits, pa.list_(pa.int64())),
                    pa.array(items, pa.list_(pa.int64())),
                ],
                names=["segment", "place", "hits", "items"],
            )


_DOCUMENTS = "segment bigint, place int, doc_id bigint, n_words bigint"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for values in batch.to_pylist():
            n_words = np.diff(np.frombuffer(values["starts"], np.uint32).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([values["segment"]] * len(n_words), pa.int64()),
                    pa.array(np.arange(len(n_words), dtype=np.int32)),
                    pa.array(values["doc_ids"], pa.int64()),
                    pa.array(n_words),
                ],
                names=["segment", "place", "doc_id", "n_words"],
            )


@releases_staged
def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: ``n_words``, ``n_hit`` words inside occurrences of a window, and ``item_ids``.

    A document is ``contaminated`` when at least one word in twenty is hit.
    """
    index = build_index(docs)
    found = (
        _search_blocks(index, phrase_windows(items, window), _document_hits, _HITS)
        .groupBy("segment", "place")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    )
    listed = index.select("segment", "doc_ids", "starts").mapInArrow(_documents, _DOCUMENTS)
    n_hit = F.coalesce(F.array_size("hits"), F.lit(0)).cast("long")
    return listed.join(found, ["segment", "place"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )
