"""How many holders every two items share.

Items are hashed into tiles, and the pairs of two tiles are counted in a matrix that a task
keeps in memory. What leaves a task is one count per pair of items, never a row per pair and
holder, so neither a holder of every item nor an item of every holder makes a long group.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Executors receive this module's code with the task, so they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE_ITEMS = 2048

# A holder with more items of two tiles than this is multiplied as a matrix row.
MATRIX_ITEMS = 256
HOLDERS_PER_PRODUCT = 1024
PAIRS_PER_COUNT = 1 << 22


class _PairCounts:
    """Shared holders of the items of two tiles.

    Items of the left tile arrive as their place in it, those of a different right tile as
    ``-1 - place``; each holder's items are sorted.
    """

    def __init__(self, left: int, right: int) -> None:
        self.tiles = (left, right)
        self.counts = np.zeros((0, 0), dtype=np.int64)

    def _grow(self, items: np.ndarray) -> None:
        rows = max(self.counts.shape[0], int(items.max()) + 1)
        last = items.max() if self.tiles[0] == self.tiles[1] else -1 - items.min()
        columns = max(self.counts.shape[1], int(last) + 1)
        if (rows, columns) != self.counts.shape:
            grown = np.zeros((rows, columns), dtype=np.int64)
            grown[: self.counts.shape[0], : self.counts.shape[1]] = self.counts
            self.counts = grown

    def add(self, items: np.ndarray, lengths: np.ndarray) -> None:
        if not items.size:
            return
        self._grow(items)
        long = np.repeat(lengths > MATRIX_ITEMS, lengths)
        self._add_products(items[long], lengths[lengths > MATRIX_ITEMS])
        self._add_pairs(items[~long], lengths[lengths <= MATRIX_ITEMS])

    def _add_pairs(self, items: np.ndarray, lengths: np.ndarray) -> None:
        left_to_come = np.repeat(np.cumsum(lengths), lengths) - np.arange(items.size) - 1
        waiting, size = [], 0
        first = np.arange(items.size)
        for distance in range(1, int(lengths.max(initial=0))):
            first = first[left_to_come[first] >= distance]
            a, b = items[first], items[first + distance]
            if self.tiles[0] != self.tiles[1]:
                # right items sort before left ones; equal sides are another tile pair's
                across = (a < 0) & (b >= 0)
                a, b = b[across], -1 - a[across]
            waiting.append(a * self.counts.shape[1] + b)
            size += a.size
            if size >= PAIRS_PER_COUNT:
                self._count(waiting)
                waiting, size = [], 0
        self._count(waiting)

    def _count(self, pairs: list[np.ndarray]) -> None:
        if pairs:
            counted = np.bincount(np.concatenate(pairs), minlength=self.counts.size)
            self.counts += counted.reshape(self.counts.shape)

    def _add_products(self, items: np.ndarray, lengths: np.ndarray) -> None:
        holder = np.repeat(np.arange(lengths.size), lengths)
        for start in range(0, lengths.size, HOLDERS_PER_PRODUCT):
            inside = slice(*np.searchsorted(holder, (start, start + HOLDERS_PER_PRODUCT)))
            row, item = holder[inside] - start, items[inside]
            here = item >= 0
            left = np.zeros((HOLDERS_PER_PRODUCT, self.counts.shape[0]), dtype=np.float32)
            left[row[here], item[here]] = 1.0
            right = left
            if self.tiles[0] != self.tiles[1]:
                right = np.zeros((HOLDERS_PER_PRODUCT, self.counts.shape[1]), dtype=np.float32)
                right[row[~here], -1 - item[~here]] = 1.0
            # a sum of at most HOLDERS_PER_PRODUCT ones is exact in float32
            product = left.T @ right
            if right is left:
                product = np.triu(product, 1)
            self.counts += product.astype(np.int64)

    def result(self) -> pa.RecordBatch:
        a, b = np.nonzero(self.counts)
        tiles = [np.full(a.size, tile, dtype=np.int32) for tile in self.tiles]
        columns = [*tiles, a.astype(np.int32), b.astype(np.int32), self.counts[a, b]]
        return pa.RecordBatch.from_arrays(
            [pa.array(column) for column in columns],
            names=["left", "right", "place_a", "place_b", "shared"],
        )


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per pair of tiles, from one row of items per holder, sorted by tiles."""
    counts: _PairCounts | None = None
    for batch in batches:
        left, right = batch["left"].to_numpy(), batch["right"].to_numpy()
        changes = np.flatnonzero((np.diff(left) != 0) | (np.diff(right) != 0)) + 1
        bounds = [0, *changes.tolist(), batch.num_rows]
        for start, end in zip(bounds, bounds[1:]):
            if start == end:
                continue
            tiles = (int(left[start]), int(right[start]))
            if counts is None or counts.tiles != tiles:
                if counts is not None:
                    yield counts.result()
                counts = _PairCounts(*tiles)
            lists = batch["items"].slice(start, end - start)
            counts.add(
                lists.flatten().to_numpy().astype(np.int64), lists.value_lengths().to_numpy()
            )
    if counts is not None:
        yield counts.result()


def shared_holders(
    holdings: DataFrame,
    items: DataFrame,
    count: int,
    least: int = 1,
    tile_items: int = TILE_ITEMS,
) -> DataFrame:
    """``item_a < item_b`` and the number of holders of both, for pairs that share ``least``.

    ``holdings`` has distinct (holder, item) rows. ``items`` lists the ``count`` items that take
    part, each with the number of its ``holders``.
    """
    tasks = 4 * int(holdings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = max(1, -(-count // tile_items))
    tile = F.pmod(F.xxhash64("item"), F.lit(tiles)).cast("int")
    # a tile is a bounded share of the items, so numbering within tiles is spread over tasks
    sized = items.select("item", "holders", tile.alias("tile"))
    placed_items = sized.select(
        "item",
        "tile",
        (F.row_number().over(Window.partitionBy("tile").orderBy("item")) - 1).alias("place"),
    )
    placed = holdings.join(placed_items, "item").select("holder", "tile", "place")
    # rows per tile, one entry each: a pair of tiles is split by holder over as many tasks as
    # its share of all rows, so that a tile with a hot item fills no single task
    weights = (
        sized.groupBy("tile")
        .agg(F.sum("holders").cast("double").alias("rows"))
        .agg(
            F.struct(
                F.map_from_entries(F.collect_list(F.struct("tile", "rows"))).alias("rows"),
                F.sum("rows").alias("total"),
            )
        )
        .scalar()
    )
    # a holder is sent only to the tiles that it has items in
    present = placed.groupBy("holder").agg(F.collect_set("tile").alias("present"))
    mine, other = F.col("tile"), F.col("other")
    share = (weights["rows"][mine] + weights["rows"][other]) / (weights["total"] * tiles)
    parts = F.greatest(F.ceil(share * tasks), F.lit(1)).cast("int")
    baskets = (
        placed.join(present, "holder")
        .withColumn("other", F.explode("present"))
        .select(
            F.least(mine, other).alias("left"),
            F.greatest(mine, other).alias("right"),
            F.pmod(F.xxhash64("holder"), parts).cast("int").alias("part"),
            "holder",
            F.when(mine > other, -1 - F.col("place")).otherwise(F.col("place")).alias("item"),
        )
        .repartition("left", "right", "part")
        .groupBy("left", "right", "part", "holder")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
        .where(F.size("items") > 1)
        .select("left", "right", "items")
        .sortWithinPartitions("left", "right")
    )
    counted = (
        baskets.mapInArrow(
            _count_pairs, "left int, right int, place_a int, place_b int, shared bigint"
        )
        .groupBy("left", "right", "place_a", "place_b")
        .agg(F.sum("shared").alias("shared"))
        .where(F.col("shared") >= least)
    )
    first = placed_items.toDF("first", "left", "place_a")
    second = placed_items.toDF("second", "right", "place_b")
    return (
        counted.join(first, ["left", "place_a"])
        .join(second, ["right", "place_b"])
        .select(
            F.least("first", "second").alias("item_a"),
            F.greatest("first", "second").alias("item_b"),
            "shared",
        )
    )
