"""Substring dedup by hashing lines and sentences.

A unit is a line, or a sentence of a line that has several. Units are normalised to their letters
and digits (A-Z lowered, every character beyond ASCII kept) and grouped by a 128-bit digest over
the whole corpus. Of each group of at least ``MIN_BYTES`` normalised bytes the occurrence with the
smallest (doc_id, start) stays; the others are removed, with their places in the original kept.

``remove_repeated_units`` cuts single units and nothing else, as its SQL says, so a passage of
sentences that are all too short stays in every copy. ``remove_repeated_passages`` cuts those too:
its units are whole lines and, from each sentence on and up to each sentence, the shortest group of
adjacent sentences that reaches the limit, over line breaks too. All places of a repeated passage
lie in such groups; what they cover together goes. A repeat that overlaps its own first occurrence
is cut behind it.

Digests are reduced to the first occurrence and a count before they are shuffled, so a unit that
very many documents hold is a row per task. The repeated ones are staged, which removes that
shuffle, and what is removed joins back by digest: a join of plain exchanges, which adaptive
execution splits where a digest is hot.

Defined results: a null text is an empty one without units; shorter units always stay; rows that
repeat a doc_id count as one document, whose equal places are one occurrence; rows without a doc_id
stay whole and are not compared; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.text import ALPHANUMERIC, ASCII_LOWER, bounded, span_hashes, utf8
from lonja.runtime import stage

MIN_BYTES = 40
UNIT_SLICE = 1 << 20  # a hash of a span takes some 60 bytes per byte of text while it is made

_UNITS = "doc_id bigint, text_key bigint, start bigint, stop bigint, low bigint, high bigint"


def _unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin: at texts, behind line breaks, and behind the space that ends a sentence."""
    opens = np.zeros(len(data) + 1, bool)
    opens[1:] = data == 0x0A
    sentence = np.flatnonzero((data[1:] == 0x20) & np.isin(data[:-1], [0x21, 0x2E, 0x3F])) + 2
    opens[sentence] = True
    opens[offsets] = True
    return np.flatnonzero(opens[: len(data)])


def _groups(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last unit of the lines and shortest groups of units that reach the limit."""
    filled = np.flatnonzero(lengths)
    ends = np.concatenate([[0], np.cumsum(lengths[filled])])
    row = np.searchsorted(offsets, starts[filled], side="right")
    count = len(filled)
    if not count:
        return filled, filled
    each = np.arange(count)
    onward = np.searchsorted(ends, ends[:-1] + MIN_BYTES) - 1
    back = np.searchsorted(ends, ends[1:] - MIN_BYTES, side="right") - 1
    opens = np.isin(starts, offsets) | (data[starts - 1] == 0x0A)
    line = np.cumsum(opens)[filled]
    heads = np.flatnonzero(np.diff(line, prepend=-1))
    tails = np.append(heads[1:], count) - 1
    long = ends[tails + 1] - ends[heads] >= MIN_BYTES
    first = np.concatenate([each, back, heads[long]])
    last = np.concatenate([onward, each, tails[long]])
    inside = (first >= 0) & (last < count)
    first, last = first[inside], last[inside]
    same = row[first] == row[last]
    first, last = np.divmod(np.unique(first[same] * count + last[same]), count)
    return filled[first], filled[last]


def _long_units(passages: bool):
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, limit=UNIT_SLICE):
            data, offsets = utf8(batch.column("text"))
            starts = _unit_starts(data, offsets)
            stops = np.append(starts[1:], len(data))
            kept = ALPHANUMERIC[data]
            plain = ASCII_LOWER[data[kept]]
            before = np.concatenate([[0], np.cumsum(kept)])
            lengths = before[stops] - before[starts]
            if passages:
                first, last = _groups(data, offsets, starts, lengths)
            else:
                first = last = np.flatnonzero(lengths >= MIN_BYTES)
            starts, stops = starts[first], stops[last]
            low = span_hashes(plain, before[starts], before[stops])
            turned = (plain.astype(np.uint16) * 167 + 13 & 0xFF).astype(np.uint8)
            high = span_hashes(turned, before[starts], before[stops])
            row = np.searchsorted(offsets, starts, side="right") - 1
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    batch.column("text_key").take(pa.array(row)),
                    pa.array(points[starts] - points[offsets[row]]),
                    pa.array(points[stops] - points[offsets[row]]),
                    pa.array(low.view(np.int64)),
                    pa.array(high.view(np.int64)),
                ],
                names=["doc_id", "text_key", "start", "stop", "low", "high"],
            )

    return spans


def _united(spans: list[dict]) -> list[dict]:
    """Sorted spans, those that touch or overlap as one."""
    out: list[dict] = []
    for span in spans:
        if out and span["start"] <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], span["stop"])
        else:
            out.append(dict(span))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        texts = batch.column("text").fill_null("").to_pylist()
        kept = []
        data, offsets = utf8(batch.column("text"))
        units = np.diff(np.searchsorted(_unit_starts(data, offsets), offsets))
        for text, gone in zip(texts, batch.column("gone").to_pylist()):
            at, parts = 0, []
            for span in gone or ():
                parts.append(text[at : span["start"]])
                at = span["stop"]
            kept.append("".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(units), batch.column("gone"), pa.array(kept, pa.string())],
            names=["doc_id", "n_units", "gone", "kept"],
        )


def _cut_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, limit=UNIT_SLICE):
        place = batch.schema.get_field_index("gone")
        field = batch.schema.field(place)
        gone = [spans and _united(spans) for spans in batch.column("gone").to_pylist()]
        yield from _cut(iter([batch.set_column(place, field, pa.array(gone, field.type))]))


def _remove(docs: DataFrame, passages: bool) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    units = texts.where(F.col("doc_id").isNotNull()).mapInArrow(_long_units(passages), _UNITS)
    order = ["doc_id", "start", *(["text_key", "stop"] if passages else [])]
    groups = units.groupBy("low", "high").agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("held"))
    repeated = stage(groups.where("held > 1").select("low", "high", "first"), "repeated-units")
    found = units.join(repeated, ["low", "high"]).where(
        (F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))
    )
    if passages:  # a repeat that begins inside its first occurrence leaves that one whole
        own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
        behind = F.when(own, F.greatest("start", "first.stop")).otherwise(F.col("start"))
        found = found.withColumn("start", behind).where("start < stop")
    removed = found.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("gone")
    )
    same = (F.col("doc_id") == F.col("gone_id")) & (F.col("text_key") == F.col("gone_key"))
    joined = texts.join(removed, same, "left").select("doc_id", "text", "gone")
    spans = "array<struct<start:bigint,stop:bigint>>"
    cutter = _cut_passages if passages else _cut
    cut = joined.mapInArrow(cutter, f"doc_id bigint, n_units bigint, gone {spans}, kept string")
    return cut.withColumn("removed", F.coalesce("gone", F.array().cast(spans))).drop("gone")


def remove_repeated_units(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_units``, the ``removed`` spans (code points of the original) and ``kept``."""
    return _remove(docs, passages=False)


def remove_repeated_passages(docs: DataFrame) -> DataFrame:
    """The same columns; short sentences go with the passage or line that repeats."""
    return _remove(docs, passages=True)
