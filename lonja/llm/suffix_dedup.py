"""Suffix-array dedup: repeated byte strings are removed, at any size.

A suffix array needs its text in one place, so the work is dealt out first, in a way that keeps
equal strings together. Every string of ``WIDTH`` bytes names one of its substrings of ``GRAM``
bytes: the one with the least hash. Strings at consecutive places that name the same form a
segment. Equal strings name the same substring wherever they stand, so a bucket of names holds all
equal strings.

1. Blocks of documents send the names' hashes to buckets, which answer with one bit each: whether
   another block has it too. Names within one document are never sent on.
2. Blocks send each distinct segment under a shared name once, with the places where it stands.
3. A bucket sorts the suffixes of its distinct segments by two-stage sorting, compares neighbours,
   and thereby finds for every string of ``WIDTH`` bytes the smallest document that has it. It
   answers with the ranges that documents with larger ids lose.
4. Blocks cut those ranges out.

The documents are shuffled once, into blocks, and that shuffle is read three times. A passage that
very many documents share reaches a bucket once for each block and not once for each document, and
buckets sort in parts of bounded size.

Defined results: a null text is an empty one; rows that repeat a doc_id are judged one by one and
take nothing from each other; rows without a doc_id stay whole and take nothing from others; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.shared_hashes import ANSWERED, ASKED, HASH_BYTES, answer, answers_for, ask, binary, bucket_bounds
from lonja.llm.suffix_array import common_prefixes, suffix_array
from lonja.llm.text import _BYTE_VALUES, _STEP, mixed, ragged, utf8, word_hashes

WIDTH = 50
GRAM = 20
BLOCK_BYTES = 4 << 20
#: What a bucket holds on the average, in bytes of hashes or of segments.
BUCKET_BYTES = 16 << 20
#: What is sorted at a time.
PART_BYTES = 2 << 20

_CHUNK = 1 << 20

_SENT = (
    "block bigint, bucket bigint, texts binary, lengths binary, parts binary,"
    " segment binary, row binary, doc_id binary, start binary"
)
_RANGES = "block bigint, row binary, start binary, stop binary"
_RESULT = "doc_id bigint, n_bytes bigint, starts array<bigint>, stops array<bigint>, kept binary"


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on where there are so many."""
    out, held = None, 0
    power, step, width, rest = _BYTE_VALUES[data], _STEP, 1, GRAM
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if out is None:
                    out, held = power, width
                else:
                    shared = len(power) - held
                    out = out[:shared] * step + power[held : held + shared]
                    held += width
            rest >>= 1
            if rest:
                power = power[:-width] * step + power[width:]
                step, width = step * step, width * 2
    return mixed(out[: max(len(data) - GRAM + 1, 0)])


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length, hash of the name, and text number of each segment of some texts."""
    grams = WIDTH - GRAM + 1
    found = []
    for first in range(0, len(data) - WIDTH + 1, _CHUNK):
        last = min(first + _CHUNK, len(data) - WIDTH + 1)
        least, width = _gram_hashes(data[first : last + WIDTH - 1]), 1
        while 2 * width <= grams:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if grams > width:
            least = np.minimum(least[: last - first], least[grams - width : grams - width + last - first])
        places = np.arange(first, last)
        row = np.searchsorted(offsets, places, side="right") - 1
        valid = places + WIDTH <= offsets[row + 1]
        edge = np.ones(last - first, bool)
        edge[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])
        edges = np.flatnonzero(edge)
        spans = np.diff(edges, append=last - first)
        used = valid[edges]
        edges, spans = edges[used], spans[used]
        found.append((first + edges, spans + WIDTH - 1, mixed(least[edges] + np.uint64(1)), row[edges]))
    if not found:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing.astype(np.uint64), nothing
    return tuple(np.concatenate(column) for column in zip(*found))


class _Block:
    """The documents of a block in the order of their ids."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.doc_ids = table["doc_id"].to_numpy()
        self.data, self.offsets = utf8(table["text"])
        self.number = table["block"][0].as_py() if table.num_rows else None

    def names(self) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
        """The segments, their distinct names, each segment's name, and names of two documents."""
        found = segments(self.data, self.offsets)
        names, which = np.unique(found[2], return_inverse=True)
        ids = self.doc_ids[found[3]]
        low, high = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
        np.minimum.at(low, which, ids)
        np.maximum.at(high, which, ids)
        return found, names, which, low < high


def _ask(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = _Block(table)
        return ask(block.number, block.names()[1], buckets)

    return run


def _distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct byte string, and which of these each string is.

    Strings of equal hash are compared byte by byte.
    """
    hashes = word_hashes(data, starts, starts + lengths)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    like = first[which]
    same = lengths == lengths[like]
    check = np.flatnonzero(same & (like != np.arange(len(like))))
    if len(check):
        unequal = data[ragged(starts[check], lengths[check])] != data[ragged(starts[like[check]], lengths[check])]
        begin = np.cumsum(lengths[check]) - lengths[check]
        same[check] = np.add.reduceat(unequal, begin, dtype=np.int64) == 0
    odd = np.flatnonzero(~same)
    which[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), which


def _send(buckets: int, sorters: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _sent_schema().empty_table()
        block = _Block(table)
        (starts, lengths, hashes, rows), names, which, shared = block.names()
        shared |= answers_for(names, buckets, answers)
        used = np.flatnonzero(shared[which])
        used = used[np.argsort(hashes[used], kind="stable")]
        cuts = np.append(bucket_bounds(hashes[used], sorters), len(used))
        out: list[list] = []
        for bucket in np.flatnonzero(np.diff(cuts)):
            mine = used[cuts[bucket] : cuts[bucket + 1]]
            first, segment = _distinct(block.data, starts[mine], lengths[mine])
            kept = mine[first]
            out.append(
                [
                    block.number,
                    int(bucket),
                    block.data[ragged(starts[kept], lengths[kept])].tobytes(),
                    lengths[kept].astype(np.uint32).tobytes(),
                    (hashes[kept] & np.uint64(0xFFFF)).astype(np.uint16).tobytes(),
                    segment.astype(np.uint32).tobytes(),
                    rows[mine].astype(np.uint32).tobytes(),
                    block.doc_ids[rows[mine]].astype(np.int64).tobytes(),
                    (starts[mine] - block.offsets[rows[mine]]).astype(np.int64).tobytes(),
                ]
            )
        schema = _sent_schema()
        columns = list(zip(*out)) if out else [[] for _ in schema]
        return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _sent_schema() -> pa.Schema:
    names = [f.split()[0] for f in _SENT.split(",")]
    return pa.schema([(n, pa.int64() if n in ("block", "bucket") else pa.binary()) for n in names])


def smallest_holders(
    data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray
) -> np.ndarray:
    """For each string of ``WIDTH`` bytes of some segments, the smallest document with an equal one.

    ``doc_ids`` are the segments' smallest documents. The results of a segment follow each other.
    """
    wanted = np.zeros(len(data), bool)
    places = ragged(starts, lengths - WIDTH + 1)
    wanted[places] = True
    order = suffix_array(data, wanted, depth=WIDTH + 6)
    fresh = common_prefixes(data, order, WIDTH) < WIDTH
    holder = np.empty(len(data), np.int64)
    holder[places] = np.repeat(doc_ids, lengths - WIDTH + 1)
    least = np.minimum.reduceat(holder[order], np.flatnonzero(fresh))
    holder[order] = least[np.cumsum(fresh) - 1]
    return holder[places]


def _sort(table: pa.Table) -> pa.Table:
    """The ranges of each block's documents that a document with a smaller id has too."""

    def column(name: str, kind) -> list[np.ndarray]:
        return [np.frombuffer(b, kind).astype(np.int64) for b in table[name].to_pylist()]

    lengths, segment = column("lengths", np.uint32), column("segment", np.uint32)
    before = np.cumsum([0, *map(len, lengths)])
    origin = np.repeat(np.arange(table.num_rows), [len(s) for s in segment])
    segment = np.concatenate([s + b for s, b in zip(segment, before)])
    lengths, part = np.concatenate(lengths), np.concatenate(column("parts", np.uint16))
    row, doc_id = np.concatenate(column("row", np.uint32)), np.concatenate(column("doc_id", np.int64))
    start = np.concatenate(column("start", np.int64))
    data = np.frombuffer(b"".join(table["texts"].to_pylist()), np.uint8)
    begin = np.cumsum(lengths) - lengths

    parts = min(math.ceil(len(data) / PART_BYTES), 1 << 16)
    part = part * parts >> 16
    found = []
    for number in range(parts):
        mine = np.flatnonzero(part == number)
        if not len(mine):
            continue
        first, which = _distinct(data, begin[mine], lengths[mine])
        kept = mine[first]
        alike = np.full(len(lengths), -1)
        alike[mine] = which
        places = np.flatnonzero(alike[segment] >= 0)
        which = alike[segment[places]]
        smallest = np.full(len(kept), np.iinfo(np.int64).max)
        np.minimum.at(smallest, which, doc_id[places])
        spans = lengths[kept]
        text = data[ragged(begin[kept], spans)]
        holders = smallest_holders(text, np.cumsum(spans) - spans, spans, smallest)
        strings = spans - WIDTH + 1
        edges = np.cumsum(strings) - strings
        all_before = np.maximum.reduceat(holders, edges)[which] < doc_id[places]
        some_before = np.minimum.reduceat(holders, edges)[which] < doc_id[places]
        whole = places[all_before]
        found.append((whole, start[whole], start[whole] + spans[which[all_before]]))
        mixed_ones = np.flatnonzero(some_before & ~all_before)
        if len(mixed_ones):
            held, counts = which[mixed_ones], strings[which[mixed_ones]]
            place = np.repeat(places[mixed_ones], counts)
            gone = holders[ragged(edges[held], counts)] < doc_id[place]
            inside = ragged(np.zeros(len(counts), np.int64), counts)
            opens = gone & ~(np.append(False, gone[:-1]) & (inside > 0))
            closes = gone & ~(np.append(gone[1:], False) & np.append(inside[1:] > 0, False))
            at = start[place]
            found.append((place[opens], (at + inside)[opens], (at + inside)[closes] + WIDTH))
    place, start, stop = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, int)] * 3
    order = np.argsort(origin[place], kind="stable")
    place, start, stop = place[order], start[order], stop[order]
    cuts = np.searchsorted(origin[place], np.arange(table.num_rows + 1))
    used = np.flatnonzero(np.diff(cuts))
    pieces = [slice(cuts[n], cuts[n + 1]) for n in used]
    return pa.table(
        {
            "block": table["block"].combine_chunks().take(pa.array(used)),
            "row": binary([row[place[p]].astype(np.uint32) for p in pieces]),
            "start": binary([start[p].astype(np.int64) for p in pieces]),
            "stop": binary([stop[p].astype(np.int64) for p in pieces]),
        }
    )


def _cut(table: pa.Table, ranges: pa.Table) -> pa.Table:
    """The block's documents without the ranges."""
    block = _Block(table)

    def column(name: str, kind) -> np.ndarray:
        blobs = ranges[name].to_pylist()
        return np.concatenate([np.frombuffer(b, kind) for b in blobs] or [np.zeros(0, kind)]).astype(np.int64)

    row = column("row", np.uint32)
    begin = block.offsets[row] if len(row) else row
    depth = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(depth, begin + column("start", np.int64), 1)
    np.add.at(depth, begin + column("stop", np.int64), -1)
    gone = np.cumsum(depth)[:-1] > 0
    lengths = np.diff(block.offsets)
    edge = np.zeros(len(gone) + 1, bool)
    edge[block.offsets] = True
    opens = np.flatnonzero(gone & (np.append(True, ~gone[:-1])[: len(gone)] | edge[:-1]))
    closes = np.flatnonzero(gone & (np.append(~gone[1:], True)[: len(gone)] | edge[1:])) + 1
    before = np.searchsorted(opens, block.offsets)
    owner = np.repeat(np.arange(len(lengths)), np.diff(before))
    kept = block.data[~gone].tobytes()
    kept_ends = np.concatenate([[0], np.cumsum(~gone)])[block.offsets]
    lists = before.astype(np.int32)
    return pa.table(
        {
            "doc_id": pa.array(block.doc_ids, pa.int64()),
            "n_bytes": pa.array(lengths),
            "starts": pa.ListArray.from_arrays(lists, pa.array(opens - block.offsets[owner])),
            "stops": pa.ListArray.from_arrays(lists, pa.array(closes - block.offsets[owner])),
            "kept": pa.array([kept[a:b] for a, b in zip(kept_ends, kept_ends[1:])], pa.binary()),
        }
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without bytes that a document with a smaller id has in a string of 50 bytes.

    Returns ``doc_id``, ``n_bytes``, the ``starts`` and ``stops`` of the removed runs (bytes of the
    original) and the ``kept`` bytes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    numbered, others = texts.where(F.col("doc_id").isNotNull()), texts.where(F.col("doc_id").isNull())
    size = numbered.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 1
    blocks = math.ceil(size / BLOCK_BYTES)
    least = min(blocks, 256)
    askers = max(least, math.ceil(size * 2 * HASH_BYTES / (WIDTH - GRAM + 2) / BUCKET_BYTES))
    sorters = max(least, math.ceil(size / BUCKET_BYTES))

    in_blocks = numbered.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    asked = in_blocks.groupBy("block").applyInArrow(_ask(askers), ASKED)
    answered = asked.groupBy("bucket").applyInArrow(answer, ANSWERED)
    sent = in_blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_send(askers, sorters), _SENT)
    ranges = sent.groupBy("bucket").applyInArrow(_sort, _RANGES)
    cut = in_blocks.groupBy("block").cogroup(ranges.groupBy("block")).applyInArrow(_cut, _RESULT)
    nothing = F.array().cast("array<bigint>")
    return cut.union(
        others.select(
            "doc_id",
            F.octet_length("text").cast("long"),
            nothing,
            nothing,
            F.encode("text", "utf-8"),
        )
    )
