"""Secrets in texts: fixed patterns, and a randomness test battery with false-discovery control.

Base spans are what the fixed patterns find; they always stay. Every other token of at least
``LENGTHS[0]`` characters is a candidate. Its encoding is the smallest alphabet that holds it, and
three tests ask whether it could be random in that alphabet:

* uniformity: chi-squared over equal stretches of the alphabet, more of them for longer tokens, and
  over the kinds of character (capital, small letter, digit or sign),
* runs: whether the kind of character changes as often as by chance,
* serial correlation: whether a symbol tells something about the next.

Their normal scores are added as squares, so a small sum looks random. A token whose sum is beyond
``RANDOM`` is none. How often ordinary text looks as random by chance is not assumed but counted:
all other text, reduced to the same alphabet and cut into pieces as long as the shortest token of
the band, gives for every encoding and band of lengths the distribution of the sum. A token's
p-value is the share of pieces that look at least as random. Over all candidates of the corpus the
false-discovery rate is held at ``RATE`` by the step-up rule, for each encoding and band of lengths
by itself (a short token proves little); tokens that pass become spans of kind ``random``.

Two passes: one finds spans and counts, one keeps what passed. What reaches the driver are counts
for each encoding, band and bin of the sum: bounded, whatever the number of documents.

Defined results: a null text is an empty one and has no spans; rows are judged one by one, also
those that repeat an id or have none; a token that touches a letter beyond ASCII is not a candidate;
tokens of digits alone are numbers, not secrets; candidates that overlap a base span go; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.text import ASCII_LOWER, bounded, byte_set, ragged, utf8, word_bounds
from lonja.runtime import releases_staged, stage

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "random")
#: The bands of lengths begin here.
LENGTHS = (16, 20, 24, 32, 48, 64)
#: The sum of squared scores that a random token exceeds less than once in a thousand (simulated).
RANDOM = 24.0
RATE = 0.01
_BINS = 64
_PER_CELL = 5
_MOST_CELLS = 16
_LEAST_ASSIGNED, _LEAST_ACCESS, _LEAST_HEX = 6, 20, 24

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ASSIGNED = re.compile(rb"password|passwd|secret|token|api_?key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets in the order of their symbols' values, smaller ones first.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "hex_upper": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "base36_upper": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_HEX = byte_set((0x30, 0x39), (0x61, 0x66))
_DIGIT = byte_set((0x30, 0x39))
_LETTER_OR_DIGIT = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
#: Bytes of a token; those beyond ASCII make it an ordinary word.
_TOKEN = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF), (0x2B, 0x2B), (0x2D, 0x2D), (0x2F, 0x2F), (0x5F, 0x5F))
_CHARACTER_KINDS = np.zeros(256, np.uint8)
_CHARACTER_KINDS[0x41:0x5B], _CHARACTER_KINDS[0x61:0x7B] = 1, 2


#: Alphabets of one case are compared with text in that case; the tests treat both cases alike.
_AS_IT_IS = np.arange(256, dtype=np.uint8)
_ASCII_UPPER = np.where((_AS_IT_IS >= 0x61) & (_AS_IT_IS <= 0x7A), _AS_IT_IS - 32, _AS_IT_IS).astype(np.uint8)
_CASES = {"hex": ASCII_LOWER, "base36": ASCII_LOWER, "base32": _ASCII_UPPER}
_SAME_PIECES = {"hex_upper": "hex", "base36_upper": "base36"}


def _values(alphabet: str) -> np.ndarray:
    """The value of each byte in an alphabet, 255 for others."""
    values = np.full(256, 255, np.uint8)
    values[np.frombuffer(alphabet.encode(), np.uint8)] = np.arange(len(alphabet))
    return values


_VALUES = [_values(alphabet) for alphabet in ENCODINGS.values()]
_ALPHABETS = [np.frombuffer(alphabet.encode(), np.uint8) for alphabet in ENCODINGS.values()]


def _uneven(seen: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Chi-squared of each row of counts as a normal score (Wilson and Hilferty), none below 0."""
    freedom = np.maximum((wanted > 0).sum(axis=1) - 1, 1)
    distance = np.divide((seen - wanted) ** 2, wanted, out=np.zeros_like(wanted), where=wanted > 0).sum(axis=1)
    spread = 2 / (9 * freedom)
    return np.maximum((np.cbrt(distance / freedom) - 1 + spread) / np.sqrt(spread), 0)


def battery(data: np.ndarray, lengths: np.ndarray, encoding: int) -> np.ndarray:
    """For tokens of an encoding, written one after the other: the sum of the squared scores."""
    count = len(lengths)
    if not count:
        return np.zeros(0)
    symbols, kinds, size = _VALUES[encoding][data], _CHARACTER_KINDS[data], len(_ALPHABETS[encoding])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    token = np.repeat(np.arange(count), lengths)
    n = lengths.astype(np.float64)

    cells = np.clip(lengths // _PER_CELL, 2, min(size, _MOST_CELLS))
    share = np.zeros((_MOST_CELLS + 1, _MOST_CELLS))
    for g in np.unique(cells).tolist():
        share[g, :g] = np.bincount(np.arange(size) * g // size, minlength=g) / size
    seen = np.bincount(token * _MOST_CELLS + symbols.astype(np.int64) * cells[token] // size, minlength=count * _MOST_CELLS)
    uneven = _uneven(seen.reshape(count, -1), share[cells] * n[:, None])
    of_kind = np.bincount(token * 3 + kinds, minlength=count * 3).reshape(count, 3).astype(np.float64)
    one_sided = _uneven(of_kind, np.bincount(_CHARACTER_KINDS[_ALPHABETS[encoding]], minlength=3) / size * n[:, None])

    changed = np.zeros(len(symbols), np.int64)
    changed[1:] = kinds[1:] != kinds[:-1]
    changed[starts] = 1
    runs = np.add.reduceat(changed, starts)
    squares, cubes = (of_kind**2).sum(axis=1), (of_kind**3).sum(axis=1)
    variance = (squares * (squares + n * (n + 1)) - 2 * n * cubes - n**3) / (n**2 * (n - 1))
    certain = variance <= 1e-9
    uneasy = np.where(certain, 0, (runs - (n + 1 - squares / n)) / np.sqrt(np.where(certain, 1, variance)))

    values = symbols.astype(np.float64)
    values -= (np.add.reduceat(values, starts) / n)[token]
    follows = values.copy()
    follows[:-1] *= values[1:]
    follows[ends - 1] = 0
    power = np.add.reduceat(values**2, starts)
    constant = power <= 1e-9
    related = np.where(constant, n, np.add.reduceat(follows, starts) / np.where(constant, 1, power) + 1 / n) * np.sqrt(n)
    return uneven**2 + one_sided**2 + uneasy**2 + related**2


def score_bin(score: np.ndarray) -> np.ndarray:
    """Bins of equal width up to ``RANDOM``; the last one holds all beyond."""
    return np.minimum(np.ceil(score * ((_BINS - 1) / RANDOM)), _BINS).astype(np.int64)


def band(lengths: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(LENGTHS), lengths, side="right") - 1


def _alone(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens without the signs at their ends, if they are still long enough."""
    if not len(starts):
        return starts, ends
    places, first = ragged(starts, ends - starts), np.cumsum(ends - starts) - (ends - starts)
    inner = _LETTER_OR_DIGIT[data[places]] | (data[places] >= 0x80)
    starts = np.minimum.reduceat(np.where(inner, places, len(data)), first)
    ends = np.maximum.reduceat(np.where(inner, places, -1), first) + 1
    long = ends - starts >= LENGTHS[0]
    return starts[long], ends[long]


def _candidates(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Of some tokens those written in an encoding: starts, ends, encodings and bins of scores."""
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
    lengths = ends - starts
    if len(starts):
        held, first = data[ragged(starts, lengths)], np.cumsum(lengths) - lengths
        left = ~np.logical_and.reduceat(_DIGIT[held], first)
        for number, values in enumerate(_VALUES):
            fits = left & (np.maximum.reduceat(values[held], first) < 255)
            left &= ~fits
            if fits.any():
                score = battery(data[ragged(starts[fits], lengths[fits])], lengths[fits], number)
                for column, more in zip(found, (starts[fits], ends[fits], np.full(len(score), number), score_bin(score))):
                    column.append(more)
    return [np.concatenate(column) for column in found]


def _ordinary(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often pieces of the text outside some ranges have which score: encoding, band, bin."""
    counts = np.zeros((len(ENCODINGS), len(LENGTHS), _BINS + 1), np.int64)
    outside = np.ones(len(data), bool)
    outside[ragged(starts, ends - starts)] = False
    cycle = np.cumsum(LENGTHS)
    for number, name in enumerate(ENCODINGS):
        if name in _SAME_PIECES:
            counts[number] = counts[list(ENCODINGS).index(_SAME_PIECES[name])]
            continue
        as_written = _CASES.get(name, _AS_IT_IS)[data]
        places = np.flatnonzero((_VALUES[number][as_written] < 255) & outside)
        held = np.searchsorted(places, offsets)
        before = np.repeat(held[:-1], np.diff(held))
        at = np.arange(len(places)) - before
        piece = np.searchsorted(cycle, at % cycle[-1], side="right")
        left = np.repeat(held[1:], np.diff(held)) - np.arange(len(places))
        begins = np.flatnonzero((at % cycle[-1] == (cycle - LENGTHS)[piece]) & (left >= np.array(LENGTHS)[piece]))
        lengths = np.array(LENGTHS)[piece[begins]]
        score = battery(as_written[places[ragged(begins, lengths)]], lengths, number)
        np.add.at(counts[number], (piece[begins], score_bin(score)), 1)
    return counts


def base_spans(text: str, may_assign: bool = True) -> list[tuple[str, int, int]]:
    """What the fixed patterns ``assign`` and ``access`` find, in code points."""
    found = []
    if may_assign:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= _LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m.group()) >= _LEAST_ACCESS]
    return found


def _of_text(offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The number of the text that holds each place."""
    return np.searchsorted(offsets, places, side="right") - 1


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_CANDIDATE = pa.struct(
    [("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.int32()), ("band", pa.int32()), ("bin", pa.int32())]
)
_SCHEMA = (
    "doc_id {}, is_row boolean, base array<struct<kind:string,start:int,end:int>>, "
    "candidates array<struct<start:int,end:int,encoding:int,band:int,bin:int>>, "
    "encoding int, band int, bin int, ordinary bigint"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document with its spans and candidates, and rows that count pieces of text."""
    totals = np.zeros((len(ENCODINGS), len(LENGTHS), _BINS + 1), np.int64)
    kind = None
    for batch in bounded(batches):
        kind = batch.column("doc_id").type
        data, offsets = utf8(batch.column("text"))
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
        base: list[list] = [[] for _ in range(batch.num_rows)]
        covered: list[tuple[int, int]] = []

        may_assign = {int(r) for r in _of_text(offsets, np.array([m.start() for m in _ASSIGNED.finditer(ASCII_LOWER[data].tobytes())], np.int64))}
        may_access = {int(r) for r in _of_text(offsets, np.array([m.start() for m in re.finditer(b"AKIA", data.tobytes())], np.int64))}
        for row in may_assign | may_access:
            raw = data[offsets[row] : offsets[row + 1]].tobytes()
            text = raw.decode("utf-8")
            base[row] = base_spans(text, row in may_assign)
            for _, start, end in base[row]:
                first = len(text[:start].encode())
                covered.append((offsets[row] + first, offsets[row] + first + len(text[start:end].encode())))

        starts, ends = word_bounds(data, offsets, _HEX)
        long = ends - starts >= _LEAST_HEX
        for start, end, row in zip(starts[long].tolist(), ends[long].tolist(), _of_text(offsets, starts[long]).tolist()):
            base[row].append(("hex", int(points[start] - points[offsets[row]]), int(points[end] - points[offsets[row]])))
            covered.append((start, end))

        starts, ends = word_bounds(data, offsets, _TOKEN)
        long = ends - starts >= LENGTHS[0]
        starts, ends = starts[long], ends[long]
        taken = np.zeros(len(data) + 1, np.int64)
        for start, end in covered:
            taken[start] += 1
            taken[end] -= 1
        taken = np.concatenate([[0], np.cumsum(np.cumsum(taken[:-1]) > 0)])  # covered bytes before each byte
        free_starts, free_ends = _alone(starts, ends, data)
        free = taken[free_ends] == taken[free_starts]
        found = _candidates(data, free_starts[free], free_ends[free])

        pairs = np.array(covered, np.int64).reshape(-1, 2)
        totals += _ordinary(data, offsets, *_merged(np.append(starts, pairs[:, 0]), np.append(ends, pairs[:, 1])))

        candidates: list[list] = [[] for _ in range(batch.num_rows)]
        rows = _of_text(offsets, found[0])
        shifts = points[offsets[rows]] if len(rows) else rows
        bands = band(found[1] - found[0])
        for start, end, number, length, score, row, shift, stop in zip(
            *(column.tolist() for column in (*found[:3], bands, found[3], rows, shifts, offsets[rows + 1]))
        ):
            padded = end
            while padded < min(stop, end + 2) and data[padded] == 0x3D:
                padded += 1
            candidates[row].append((int(points[start] - shift), int(points[padded] - shift), number, length, score))
        yield _rows(
            batch.num_rows,
            doc_id=batch.column("doc_id"),
            is_row=pa.array([True] * batch.num_rows),
            base=pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in base], pa.list_(_SPAN)),
            candidates=pa.array([[dict(zip(("start", "end", "encoding", "band", "bin"), c)) for c in cs] for cs in candidates], pa.list_(_CANDIDATE)),
        )
    places = np.nonzero(totals)
    if len(places[0]):
        named = {name: pa.array(column.astype(np.int32)) for name, column in zip(("encoding", "band", "bin"), places)}
        count = len(places[0])
        yield _rows(count, doc_id=pa.nulls(count, kind), is_row=pa.array([False] * count), ordinary=pa.array(totals[places]), **named)


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that may overlap as ranges that don't."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    last = np.flatnonzero(new)[1:] - 1
    return starts[new], ends[np.append(last, len(ends) - 1)] if len(ends) else ends


def _rows(count: int, **columns) -> pa.RecordBatch:
    kinds = {
        "is_row": pa.bool_(),
        "base": pa.list_(_SPAN),
        "candidates": pa.list_(_CANDIDATE),
        "encoding": pa.int32(),
        "band": pa.int32(),
        "bin": pa.int32(),
        "ordinary": pa.int64(),
    }
    names = ["doc_id", *kinds]
    return pa.RecordBatch.from_arrays([columns[n] if n in columns else pa.nulls(count, kinds[n]) for n in names], names)


def accepted_bins(ordinary: dict[tuple[int, int, int], int], candidates: dict[tuple[int, int, int], int], rate: float = RATE) -> dict[tuple[int, int], int]:
    """For each encoding and band of lengths the last bin of scores that passes.

    Both arguments count by (encoding, band, bin). The step-up rule holds the rate in each encoding
    and band by itself, so short tokens, of which many look random, don't spoil the case of long
    ones. Scores beyond ``RANDOM`` never pass.
    """
    passed: dict[tuple[int, int], int] = {}
    for key in {(encoding, length) for encoding, length, _ in candidates}:
        mine = sorted((score, n) for (*k, score), n in candidates.items() if tuple(k) == key)
        pieces = [(score, n) for (*k, score), n in ordinary.items() if tuple(k) == key]
        total, of_pieces = sum(n for _, n in mine), sum(n for _, n in pieces)
        rank = 0
        for score, n in mine:
            rank += n
            p_value = (1 + sum(c for s, c in pieces if s <= score)) / (1 + of_pieces)
            if score < _BINS and p_value <= rate * rank / total:
                passed[key] = score
    return passed


def _counts(rows: DataFrame, amount) -> dict[tuple[int, int, int], int]:
    found = rows.groupBy("encoding", "band", "bin").agg(amount.alias("n")).collect()
    return {(r["encoding"], r["band"], r["bin"]): r["n"] for r in found}


@releases_staged
def secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id`` and ``spans``: kind, start, end (exclusive; code points) and whether it is base.

    Spans are in the order of their starts, then of the kinds.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    scanned = stage(texts.mapInArrow(_scan, _SCHEMA.format(kind)), "secret-scan")
    ordinary = _counts(scanned.where(~F.col("is_row")), F.sum("ordinary"))
    listed = scanned.where("is_row").select(F.explode("candidates").alias("c")).select("c.encoding", "c.band", "c.bin")
    passed = accepted_bins(ordinary, _counts(listed, F.count(F.lit(1))), rate)
    last = [passed.get((e, b), -1) for e in range(len(ENCODINGS)) for b in range(len(LENGTHS))]
    limits = F.array(*[F.lit(bin) for bin in last])
    chosen = F.filter("candidates", lambda c: c["bin"] <= F.get(limits, c["encoding"] * len(LENGTHS) + c["band"]))
    rank = F.array(*map(F.lit, KINDS))

    def span(kind, start, end, base):
        return F.struct(start.alias("start"), F.array_position(rank, kind).alias("rank"), end.alias("end"), kind.alias("kind"), F.lit(base).alias("base"))

    found = F.concat(
        F.transform("base", lambda s: span(s["kind"], s["start"], s["end"], True)),
        F.transform(chosen, lambda c: span(F.lit("random"), c["start"], c["end"], False)),
    )
    return scanned.where("is_row").select("doc_id", F.array_sort(found).alias("spans"))
