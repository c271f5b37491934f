"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.runtime import release, releases_staged, stage


@releases_staged
def connected_components(links: DataFrame) -> DataFrame:
    """``doc_id`` and ``component``, the smallest id of its component, for every id in a link.

    Links are columns ``a`` and ``b``. Every round hangs all neighbours of a node on the smallest
    of them, first the larger neighbours and then the smaller ones, until every node hangs on the
    smallest of its component; rounds grow with the logarithm of the longest path. Each round is
    written, so the plan does not grow. Null ids and links of a node with itself are ignored.
    """
    links = links.where("a <> b")
    edges = stage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    state = _state(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        larger = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        larger = larger.where("u <> v").distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("least"))
        hung = larger.join(least, "u")
        smaller = hung.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        replaced, edges = edges, stage(smaller.union(least.toDF("u", "v")).distinct(), "links")
        release(replaced)
        before, state = state, _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).collect()[0]
    return tuple(row)
