"""Centroid clustering with bounds that survive rounds (ns-bounds: the norm of the sum).

Vectors are integers and distances exact, so the result depends on neither partitioning nor order.
For every vector and centroid the last exactly evaluated distance is kept, with the round in which
it was evaluated, and all earlier centroids are kept too. In a later round the centroid has moved
by one vector in total, from where it was at that evaluation to where it is now; the norm of that
vector loosens the distance into an upper bound (own centroid) or a lower bound (another one). The
norm of the total is never more than the sum of the norms of the rounds' moves, so the bounds stay
tighter than those that add up drifts. Where a lower bound is not above the upper one, the own
distance is evaluated again, and what still fails is rescanned exactly, ties going to the smaller
number.

A round is one pass: the state is a table of the vectors with their distances and rounds, the next
state replaces it on disk, and sums per centroid are added up in the tasks before they meet. The
driver holds the centroids of all rounds: ``k * (rounds + 1)`` vectors.

Defined results: rows whose vector is null, of another length, or has a null, NaN or infinite
component are left out; rows that repeat an id are clustered one by one; among equal ids the smaller
vector comes first as a start; a row without an id is clustered and becomes a start only after all
others; with fewer than ``k`` vectors there are as many centroids as vectors, and an empty table
gives an empty result; other columns are ignored. Components beyond ``vectors.LARGEST`` are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.vectors import exact_means, integer_vectors, lists, matrix
from lonja.runtime import release, releases_staged, stage

K = 16
ROUNDS = 3
SCALE = 64
DIMS = 64
#: Vectors a task looks at together.
SLICE_ROWS = 2048
#: More than what single precision and square roots can be off, as a share of the value.
_MARGIN = 1e-6

_STATE = "x array<int>, cluster int, near array<float>, seen array<tinyint>, evaluated int"


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` from rows of ``centroids``, one to one."""
    moved = x - centroids
    return np.einsum("ij,ij->i", moved, moved)


class _Bounds:
    """The distances a slice of vectors remembers, and what they say about the latest centroids."""

    def __init__(self, x: np.ndarray, history: np.ndarray):
        self.x, self.history = x, history
        self.now = len(history) - 1
        self.rows = np.arange(len(x))

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every distance, evaluated."""
        k = self.history.shape[1]
        exact = np.stack([squared(self.x, self.history[0][j]) for j in range(k)], axis=1)
        seen = np.zeros((len(self.x), k), np.int8)
        return exact.argmin(axis=1), np.sqrt(exact).astype(np.float32), seen, np.full(len(self.x), k)

    def again(self, own: np.ndarray, near: np.ndarray, seen: np.ndarray):
        """The state after this round, evaluating only what the bounds leave open."""
        own, near, seen = own.copy(), near.copy(), seen.copy()
        latest, k = self.history[self.now], self.history.shape[1]
        moved = np.sqrt(((self.history - latest) ** 2).sum(axis=2).astype(np.float64))
        drift = moved[seen, np.arange(k)]
        remembered = near.astype(np.float64)
        lower = remembered - drift - _MARGIN * (remembered + drift)
        upper = (remembered + drift)[self.rows, own] * (1 + 2 * _MARGIN)
        lower[self.rows, own] = np.inf
        open_rows = np.flatnonzero((lower <= upper[:, None]).any(axis=1))
        mine = squared(self.x[open_rows], latest[own[open_rows]])
        near[open_rows, own[open_rows]] = np.sqrt(mine)
        seen[open_rows, own[open_rows]] = self.now
        failing = lower[open_rows] <= (np.sqrt(mine) * (1 + _MARGIN))[:, None]
        row, j = np.nonzero(failing)
        exact = squared(self.x[open_rows[row]], latest[j])
        near[open_rows[row], j] = np.sqrt(exact)
        seen[open_rows[row], j] = self.now
        distances = np.full((len(open_rows), k), np.iinfo(np.int64).max)
        distances[np.arange(len(open_rows)), own[open_rows]] = mine
        distances[row, j] = exact
        evaluated = np.zeros(len(self.x), np.int64)
        evaluated[open_rows] = 1 + failing.sum(axis=1)
        own[open_rows] = distances.argmin(axis=1)
        return own, near, seen, evaluated


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(first, SLICE_ROWS)


def _assign(history: np.ndarray):
    """Each row of a state (or of plain vectors) with its nearest centroid of the last round."""
    k, dims = history.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            bounds = _Bounds(matrix(batch.column("x"), dims), history)
            if len(history) == 1:
                found = bounds.first()
            else:
                own = batch.column("cluster").to_numpy().astype(np.int64)
                found = bounds.again(own, matrix(batch.column("near"), k, np.float32), matrix(batch.column("seen"), k, np.int8))
            own, near, seen, evaluated = found
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("x"),
                    pa.array(own.astype(np.int32)),
                    lists(near),
                    lists(seen),
                    pa.array(evaluated.astype(np.int32)),
                ],
                ["vec_id", "x", "cluster", "near", "seen", "evaluated"],
            )

    return run


def _sums(k: int, dims: int):
    """Per task: each cluster's number of vectors and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in _slices(batches):
            own, x = batch.column("cluster").to_numpy(), matrix(batch.column("x"), dims)
            order = np.argsort(own, kind="stable")
            held, first = np.unique(own[order], return_index=True)
            if len(held):
                sums[held] += np.add.reduceat(x[order], first, axis=0)
                count += np.bincount(own, minlength=k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(count[used]), lists(sums[used])], ["cluster", "n", "sums"]
        )

    return run


def _distances(centroids: np.ndarray):
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            own = batch.column("cluster").to_numpy()
            found = squared(matrix(batch.column("x"), dims), centroids[own])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("cluster"), pa.array(found), batch.column("evaluated")],
                ["vec_id", "cluster", "distance", "evaluated"],
            )

    return run


def starts(vectors: DataFrame, k: int = K) -> np.ndarray:
    """The ``k`` vectors whose id hashes lowest, as rows."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.orderBy(key.asc_nulls_last(), "x").limit(k)
    return np.array([row["x"] for row in chosen.select("x").collect()], np.int64)


@releases_staged
def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, column: str = "embedding") -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid`` (the
    final one, its components joined by commas) and ``evaluated`` (distances evaluated in the last
    round)."""
    kept = integer_vectors(vectors.select("vec_id", column), scale, dims, column).select("vec_id", "x")
    kind = kept.schema["vec_id"].dataType.simpleString()
    state = stage(kept, "vectors")
    centroids = starts(state, k)
    if not len(centroids):
        none = "vec_id {}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid string, evaluated int"
        return vectors.sparkSession.createDataFrame([], none.format(kind))
    history = centroids[None]
    for number in range(rounds + 1):
        before, state = state, stage(state.mapInArrow(_assign(history), f"vec_id {kind}, {_STATE}"), "vector-state")
        release(before)
        if number == rounds:
            break
        parts = state.select("cluster", "x").mapInArrow(_sums(len(centroids), dims), "cluster int, n bigint, sums array<bigint>")
        moved = history[-1].copy()
        for (own,), mean in exact_means(parts, "cluster").items():
            moved[own] = mean
        history = np.concatenate([history, moved[None]])
    schema = f"vec_id {kind}, cluster int, distance bigint, evaluated int"
    found = stage(state.drop("near", "seen").mapInArrow(_distances(history[-1]), schema), "vector-distances")
    release(state)
    return _with_totals(found, history[-1])


def _with_totals(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    totals = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    by_cluster = {row["cluster"]: int(row["total"]) for row in totals}
    inertia = [by_cluster.get(j, 0) for j in range(len(centroids))]
    written = [",".join(map(str, row)) for row in centroids.tolist()]

    def of_cluster(values: list, kind: str):
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))

    return found.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster(inertia, "bigint").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("bigint").alias("inertia"),
        of_cluster(written, "string").alias("centroid"),
        "evaluated",
    )

