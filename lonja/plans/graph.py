"""The graph of sellers and buyers whose edges are the pairs that trade.

``network_edges`` builds it; the other functions take its result, which the caller may stage
when several of them follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions import measures as m
from lonja.labels import ENGLISH, Labels
from lonja.operators.betweenness import betweenness
from lonja.operators.filters import OpsFilter
from lonja.plans.network import trading_pairs


def network_edges(
    ops: DataFrame, f: OpsFilter | None = None, *, n: int | None = 30
) -> DataFrame:
    """Pairs with the most commission; ``n=None`` keeps the whole graph."""
    edges = (
        trading_pairs(ops, f)
        .groupBy(F.col("seller_name").alias("seller"), F.col("buyer_name").alias("buyer"))
        .agg(m.rows().alias("transactions"), m.sum_commission().alias("commission"))
    )
    if n is None:
        return edges
    return edges.orderBy(F.desc_nulls_last("commission"), "seller", "buyer").limit(n)


def _seller_node() -> Column:
    return F.concat(F.lit("S:"), F.col("seller"))


def _buyer_node() -> Column:
    return F.concat(F.lit("B:"), F.col("buyer"))


def _with_type_and_name(nodes: DataFrame, labels: Labels) -> DataFrame:
    node = F.col("node_id")
    kind = F.when(node.startswith("S:"), labels.seller).otherwise(labels.buyer)
    return nodes.select("node_id", kind.alias("node_type"), F.expr("substring(node_id, 3)").alias("node_name"), *nodes.columns[1:])


def _nodes(edges: DataFrame, labels: Labels) -> DataFrame:
    ends = F.explode(F.array(_seller_node(), _buyer_node())).alias("node_id")
    nodes = (
        edges.select(ends, "commission")
        .groupBy("node_id")
        .agg(m.exact_sum(F.col("commission")).alias("commission"), m.rows().alias("degree"))
    )
    return _with_type_and_name(nodes, labels)


def network_nodes(edges: DataFrame, *, labels: Labels = ENGLISH) -> DataFrame:
    """Commission and degree per node, and each as a share of the largest."""
    nodes = _nodes(edges, labels)
    largest = nodes.agg(
        F.struct(F.max("commission").alias("commission"), F.max("degree").alias("degree"))
    ).scalar()

    def share(measure: str) -> Column:
        most = largest[measure]
        return F.when(most > 0, F.col(measure) / most).otherwise(0.5).alias(f"{measure}_share")

    return nodes.select("*", share("commission"), share("degree"))


def edge_scaling(edges: DataFrame) -> DataFrame:
    """Each edge's operations and commission as a share of the largest."""
    largest = edges.agg(
        F.struct(
            F.max("transactions").alias("transactions"), F.max("commission").alias("commission")
        )
    ).scalar()
    return edges.select(
        "seller",
        "buyer",
        (F.col("transactions") / largest["transactions"]).alias("weight_share"),
        F.try_divide(F.col("commission"), largest["commission"]).alias("commission_share"),
    )


def _different(edges: DataFrame, column: str) -> Column:
    """How many values a column has, as a subquery that reads and shuffles that column alone."""
    return edges.select(column).distinct().agg(F.count(column)).scalar()


def network_size(edges: DataFrame) -> DataFrame:
    """The numbers of nodes, sellers and buyers."""
    counts = [_different(edges, name).alias(f"{name}s") for name in ("seller", "buyer")]
    return edges.sparkSession.range(1).select(*counts).select(
        (F.col("sellers") + F.col("buyers")).alias("nodes"), "sellers", "buyers"
    )


def most_connected(edges: DataFrame, *, labels: Labels = ENGLISH) -> DataFrame:
    """The node with the highest degree, the first by id among equals."""
    return (
        _nodes(edges, labels)
        .orderBy(F.desc("degree"), "node_id")
        .limit(1)
        .select("node_id", "node_type", "node_name", "degree")
    )


def network_health(edges: DataFrame) -> DataFrame:
    """Density, commission and mean operations per pair."""
    nodes = F.col("sellers") + F.col("buyers")
    counts = {f"{name}s": _different(edges, name) for name in ("seller", "buyer")}
    return edges.agg(
        m.rows().alias("edges"),
        F.coalesce(m.exact_sum(F.col("commission")), F.lit(0.0)).alias("total_commission"),
        F.avg("transactions").alias("avg_transactions_per_pair"),
    ).withColumns(counts).select(
        F.coalesce(
            F.try_divide(F.lit(2) * F.col("edges"), nodes * (nodes - 1)), F.lit(0.0)
        ).alias("density"),
        "total_commission",
        "avg_transactions_per_pair",
    )


def node_betweenness(
    edges: DataFrame, *, rounds: int = 1, sources: int | None = None, labels: Labels = ENGLISH
) -> DataFrame:
    """Normalised betweenness, to ten decimals so that equal nodes compare equal.

    With ``sources`` it is estimated from so many nodes, and comes with its ``standard_error``.
    """
    links = edges.select(_seller_node().alias("src"), _buyer_node().alias("dst"))
    scored = betweenness(links, rounds=rounds, sources=sources).select(
        F.col("node").alias("node_id"),
        F.round("betweenness", 10).alias("betweenness"),
        *([] if sources is None else [F.round("standard_error", 10).alias("standard_error")]),
    )
    return _with_type_and_name(scored, labels)


def bridge_node(
    edges: DataFrame, *, rounds: int = 1, sources: int | None = None, labels: Labels = ENGLISH
) -> DataFrame:
    """The node with the highest betweenness, the first by id among equals."""
    return (
        node_betweenness(edges, rounds=rounds, sources=sources, labels=labels)
        .orderBy(F.desc("betweenness"), "node_id")
        .limit(1)
    )


def top_network_hubs(edges: DataFrame, *, n: int = 10, labels: Labels = ENGLISH) -> DataFrame:
    """Nodes by degree."""
    return (
        _nodes(edges, labels)
        .select("node_id", "node_type", "node_name", "degree", "commission")
        .orderBy(F.desc("degree"), F.desc_nulls_last("commission"), "node_id")
        .limit(n)
    )
