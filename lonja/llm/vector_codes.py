"""Product codes of vectors: each part of a vector becomes the number of its nearest codebook entry.

Parts are integer vectors and distances exact, so the result depends on neither partitioning nor
order. Equal parts are counted once, and what the distinct parts of a task have in common at their
beginning is computed once: sorted, they are the leaves of a trie whose levels are the dimensions.
A depth-first traversal carries for every node the vector of distances to all entries over the
dimensions so far, and children add theirs to the one of their parent. A leaf takes the smallest
and adds its part, times its count, to the sums of that entry. Distinct parts are dealt by range, so
a task's trie is one stretch of the order and shares long prefixes.

A round is one pass over the distinct parts; sums per entry are added up in the tasks before they
meet. The driver holds the codebooks: ``PARTS * ENTRIES`` entries. Codes are given in a pass over
the vectors, each task over the trie of its own parts, so no vector is shuffled.

Defined results: rows whose vector is null, not of ``dims`` components, or has a null, NaN or
infinite component are left out; rows that repeat an id are coded one by one, and among equal ids
the smaller vector comes first in the codebook's start; a row without an id comes after all others;
with fewer vectors than entries the codebooks are shorter; an empty table gives an empty result;
null labels are one group; other columns are ignored. Components beyond ``vectors.LARGEST`` are an
error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.vectors import exact_means, integer_vectors, lists, matrix
from lonja.runtime import release, releases_staged, stage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
DIMS = 64
#: Children of a node that are looked at together.
CHILDREN = 1024


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, and the number of each row's equal among them."""
    order = np.lexsort(rows.T[::-1])
    held = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (held[1:] != held[:-1]).any(axis=1)
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(new) - 1
    return held[new], number


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct parts in lexicographic order the nearest entry (ties: the first) and its squared
    distance, by a depth-first traversal of their trie."""
    count, dims = parts.shape
    entry, distance = np.zeros(count, np.int64), np.zeros(count, np.int64)
    nodes = [(0, 0, count, np.zeros(len(entries), np.int64))] if count else []
    while nodes:
        depth, first, last, shared = nodes.pop()
        values = parts[first:last, depth]
        begins = first + np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1])
        ends = np.append(begins[1:], last)
        for some in range(0, len(begins), CHILDREN):
            begin, end = begins[some : some + CHILDREN], ends[some : some + CHILDREN]
            summed = shared + (parts[begin, depth][:, None] - entries[:, depth]) ** 2
            alone = (end - begin == 1) if depth + 1 < dims else np.ones(len(begin), bool)
            leaves, below = begin[alone], summed[alone]
            for rest in range(depth + 1, dims):  # nothing below is shared any more
                below += (parts[leaves, rest][:, None] - entries[:, rest]) ** 2
            entry[leaves] = below.argmin(axis=1)
            distance[leaves] = below[np.arange(len(leaves)), entry[leaves]]
            for child in np.flatnonzero(~alone)[::-1].tolist():
                nodes.append((depth + 1, int(begin[child]), int(end[child]), summed[child]))
    return entry, distance


def _sums(codebooks: list[np.ndarray]):
    """Per task: for each part position and entry the number of parts and their sum."""
    width = codebooks[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(book), np.int64) for book in codebooks]
        sums = [np.zeros(book.shape, np.int64) for book in codebooks]
        for batch in batches:
            position = batch.column("position").to_numpy()
            parts, weight = matrix(batch.column("part"), width), batch.column("n").to_numpy()
            for p, book in enumerate(codebooks):
                mine = np.flatnonzero(position == p)
                mine = mine[np.lexsort(parts[mine].T[::-1])]
                entry, _ = nearest_entries(parts[mine], book)
                np.add.at(counts[p], entry, weight[mine])
                np.add.at(sums[p], entry, parts[mine] * weight[mine, None])
        for p, count in enumerate(counts):
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used), p, np.int32)),
                    pa.array(used.astype(np.int32)),
                    pa.array(count[used]),
                    lists(sums[p][used]),
                ],
                ["position", "entry", "n", "sums"],
            )

    return run


def _codes(codebooks: list[np.ndarray]):
    width = codebooks[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width * len(codebooks))
            code, error = np.zeros((len(x), len(codebooks)), np.uint8), np.zeros(len(x), np.int64)
            for p, book in enumerate(codebooks):
                parts, number = distinct_rows(x[:, p * width : (p + 1) * width])
                entry, distance = nearest_entries(parts, book)
                code[:, p] = entry[number]
                error += distance[number]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([row.tobytes() for row in code], pa.binary()), pa.array(error)],
                ["vec_id", "label", "code", "error"],
            )

    return run


def distinct_parts(vectors: DataFrame, parts: int, dims: int) -> DataFrame:
    """``position``, ``part`` and ``n``, how often; dealt by range and sorted."""
    width = dims // parts
    cut = F.array(*[F.slice("x", p * width + 1, width) for p in range(parts)])
    counted = vectors.select(F.posexplode(cut).alias("position", "part")).groupBy("position", "part")
    counted = counted.agg(F.count(F.lit(1)).alias("n"))
    return counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part")


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids."""
    chosen = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries)
    rows = np.array([row["x"] for row in chosen.select("x").collect()], np.int64)
    return [np.ascontiguousarray(book) for book in np.split(rows, parts, axis=1)] if len(rows) else []


def codebooks_sha256(codebooks: list[np.ndarray]) -> str:
    numbers = (str(value) for book in codebooks for value in book.reshape(-1).tolist())
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, dims: int = DIMS) -> list[np.ndarray]:
    """The codebooks of integer vectors ``x`` after some rounds, one for each part position."""
    codebooks = first_codebooks(vectors, parts, entries)
    if not codebooks:
        return codebooks
    distinct = stage(distinct_parts(vectors, parts, dims), "distinct-parts")
    for _ in range(rounds):
        rows = distinct.mapInArrow(_sums(codebooks), "position int, entry int, n bigint, sums array<bigint>")
        codebooks = [book.copy() for book in codebooks]
        for (position, entry), mean in exact_means(rows, "position", "entry").items():
            codebooks[position][entry] = mean
    release(distinct)
    return codebooks


@releases_staged
def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, column: str = "embedding"
) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (a byte for each part), ``error``, ``label_error`` (added up
    over equal labels) and ``codebooks_sha256``; ``entries`` are at most 256."""
    if dims % parts or entries > 256:
        raise ValueError("parts must divide dims, and an entry's number must fit a byte")
    kept = integer_vectors(vectors.select("vec_id", "label", column), scale, dims, column)
    kept = stage(kept.select("vec_id", "label", "x"), "vectors")
    codebooks = train(kept, parts, entries, rounds, dims)
    kinds = {name: kept.schema[name].dataType.simpleString() for name in ("vec_id", "label")}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error bigint"
    if not codebooks:
        return vectors.sparkSession.createDataFrame([], f"{schema}, label_error bigint, codebooks_sha256 string")
    found = stage(kept.mapInArrow(_codes(codebooks), schema), "vector-codes")
    summed = F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error")
    # written, so that the planner knows whether there are few enough labels to broadcast
    totals = stage(found.groupBy(F.col("label").alias("of_label")).agg(summed), "label-errors")
    joined = found.join(totals, F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")
    return joined.withColumn("codebooks_sha256", F.lit(codebooks_sha256(codebooks)))
