"""Betweenness of the nodes of an undirected, unweighted graph.

Breadth-first search from many nodes at once, one join per level, counting shortest paths; then each
level hands its dependency back to the one before. Every level is a table, so a round's plan does
not grow with the depth of the graph. A round searches from a part of the nodes and ends as one row
per node; its levels are dropped before the next one begins, so rounds bound what is kept.

The search may begin from a sample of the nodes. Its sums are scaled up, and as the sample comes by
hash from all nodes, they come with a standard error: the spread of the sampled dependencies, less
the share of the nodes that has been sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.runtime import release, releases_staged, stage

# Neighbours of one node that are joined as one key; a larger hub is split.
NEIGHBOURS_PER_SLOT = 10_000


def _adjacency(edges: DataFrame, per_slot: int) -> DataFrame:
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).unionByName(
        edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"))
    )
    slots = both.groupBy("node").agg(F.ceil(F.count("*") / per_slot).cast("int").alias("slots"))
    return (
        both.join(slots, "node")
        .withColumn("slot", F.pmod(F.xxhash64("neighbour"), F.col("slots")).cast("int"))
        .join(slots.toDF("neighbour", "neighbour_slots"), "neighbour")
        .select("node", "slots", "slot", "neighbour", "neighbour_slots")
    )


def _to_neighbours(level: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Each (source, node) row once per neighbour of the node."""
    slotted = level.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    return slotted.drop("slots").join(adjacency.drop("slots"), ["node", "slot"])


def _search(start: DataFrame, adjacency: DataFrame) -> list[DataFrame]:
    """Levels of (source, node, slots, paths), the start first."""
    levels = [stage(start, "level")]
    while True:
        reached = (
            _to_neighbours(levels[-1], adjacency)
            .groupBy("source", F.col("neighbour").alias("node"))
            .agg(F.max("neighbour_slots").alias("slots"), F.sum("paths").alias("paths"))
        )
        # a neighbour lies on the level before, the same level or the next one
        for seen in levels[-2:]:
            reached = reached.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        level = stage(reached, "level")
        if level.isEmpty():
            return levels
        levels.append(level)


def _dependencies(levels: list[DataFrame], adjacency: DataFrame) -> DataFrame:
    """(node, dependency, square) of a round: sums over its sources; staged."""
    below = levels[-1].withColumn("dependency", F.lit(0.0))
    tables = [below]
    for level in reversed(levels[1:-1]):
        handed = below.withColumn("share", (F.col("dependency") + 1) / F.col("paths"))
        received = (
            _to_neighbours(handed, adjacency)
            .groupBy("source", F.col("neighbour").alias("node"))
            .agg(F.sum("share").alias("share"))
        )
        below = stage(
            level.join(received, ["source", "node"], "left").select(
                *level.columns,
                (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("dependency"),
            ),
            "dependency",
        )
        tables.append(below)
    rows = tables[0].select("node", "dependency")
    for table in tables[1:]:
        rows = rows.unionByName(table.select("node", "dependency"))
    # a source is no node between others: its own level has no dependency
    return stage(rows.groupBy("node").agg(*_sums()), "round")


def _sums(dependency: str = "dependency", square: str | None = None) -> list:
    squared = F.col(square) if square else F.col(dependency) * F.col(dependency)
    return [F.sum(dependency).alias("dependency"), F.sum(squared).alias("square")]


@releases_staged
def _round(chosen: DataFrame, adjacency: DataFrame) -> DataFrame | None:
    """What the search from some nodes gives; only that stays staged."""
    levels = _search(chosen, adjacency)
    return _dependencies(levels, adjacency) if len(levels) > 1 else None


@releases_staged
def betweenness(
    edges: DataFrame,
    rounds: int = 1,
    per_slot: int = NEIGHBOURS_PER_SLOT,
    sources: int | None = None,
) -> DataFrame:
    """(node, betweenness, standard_error), normalised, for ``edges(src, dst)`` without repeats.

    No rows for graphs of two nodes or fewer. The search keeps one row per source and node that it
    reaches; with ``rounds`` over 1 it runs from a part of the sources at a time, to the same end.
    With ``sources`` it runs from so many nodes only and estimates: unbiased, and exact, with an
    error of zero, if there are no more nodes than that.
    """
    adjacency = stage(_adjacency(edges, per_slot), "adjacency")
    nodes = stage(adjacency.groupBy("node").agg(F.max("slots").alias("slots")), "nodes")
    start = nodes.select(F.col("node").alias("source"), "node", "slots", F.lit(1.0).alias("paths"))
    n = nodes.count()
    k = n if sources is None else min(sources, n)
    if k < 1 and n > 2:
        raise ValueError("a search needs a source")
    if k < n:
        start = stage(start.orderBy(F.xxhash64("source"), "source").limit(k), "sources")
    done: DataFrame | None = None
    for turn in range(rounds):
        found = _round(start.where(F.pmod(F.xxhash64("source", F.lit(1)), F.lit(rounds)) == turn), adjacency)
        if found is not None:
            before, so_far = done, found if done is None else done.unionByName(found)
            done = found if before is None else stage(so_far.groupBy("node").agg(*_sums(square="square")), "rounds")
            if before is not None:
                release(before, found)
    none = nodes.select("node", F.lit(0.0).alias("dependency"), F.lit(0.0).alias("square"))
    total = (none if done is None else none.unionByName(done)).groupBy("node").agg(*_sums(square="square"))
    mean = F.col("dependency") / max(k, 1)
    spread = F.greatest(F.col("square") - mean * F.col("dependency"), F.lit(0.0)) / max(k - 1, 1)
    error = n * F.sqrt(spread / max(k, 1) * (1 - k / max(n, 1)))
    pairs = max((n - 1) * (n - 2), 1)
    return total.where(F.lit(n > 2)).select(
        "node",
        (mean * (n / pairs)).alias("betweenness"),
        (error / pairs).alias("standard_error"),
    )
