"""Concentration of commission, unusually low rates and the spread of operation sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions import measures as m
from lonja.labels import ENGLISH, Labels
from lonja.operators.filters import OpsFilter, apply_filter
from lonja.runtime import stage

# Upper ends of the first three size bands.
SIZE_BANDS = (1_000_000.0, 10_000_000.0, 50_000_000.0)


def pareto(ops: DataFrame, f: OpsFilter | None = None, *, n: int = 50) -> DataFrame:
    """Top clients with their running total, as a percent of the listed clients' total.

    The window is not partitioned, but it sees at most ``n`` rows.
    """
    order = [F.desc_nulls_last("commission"), F.asc_nulls_last("client_name")]
    listed = (
        apply_filter(ops, f)
        .groupBy("client_name")
        .agg(m.sum_commission().alias("commission"))
        .orderBy(*order)
        .limit(n)
    )
    everything = Window.partitionBy(F.lit(0))
    so_far = everything.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = m.exact_sum_over(F.col("commission"), so_far)
    total = m.exact_sum_over(F.col("commission"), everything)
    return listed.select(
        "client_name",
        "commission",
        running.alias("cumulative_commission"),
        (F.try_divide(running, total) * 100).alias("cumulative_pct"),
    ).orderBy(*order)


def concentration(
    ops: DataFrame,
    f: OpsFilter | None = None,
    *,
    n: int = 50,
    fraction: float = 0.2,
    high: float = 80.0,
) -> DataFrame:
    """Percent of the listed commission earned by the first ``fraction`` of listed clients."""
    listed = pareto(ops, f, n=n)
    everything = Window.partitionBy(F.lit(0))
    order = [F.desc_nulls_last("commission"), F.asc_nulls_last("client_name")]
    first = F.floor(F.count(F.lit(1)).over(everything) * F.lit(fraction))
    placed = listed.select(
        "commission",
        F.row_number().over(everything.orderBy(*order)).alias("place"),
        first.alias("first"),
    )
    in_first = F.when(F.col("place") <= F.col("first"), F.col("commission"))
    share = F.try_divide(F.col("top_commission"), F.col("total")) * 100
    return (
        placed.agg(
            F.coalesce(F.max("first"), F.lit(0)).alias("top_clients"),
            F.coalesce(m.exact_sum(in_first), F.lit(0.0)).alias("top_commission"),
            m.exact_sum(F.col("commission")).alias("total"),
        )
        .select("top_clients", share.alias("top_percentage"))
        .withColumn("high_risk", F.coalesce(F.col("top_percentage") > high, F.lit(False)))
    )


def pricing_anomalies(
    ops: DataFrame, f: OpsFilter | None = None, *, factor: float = 0.7, n: int = 20
) -> DataFrame:
    """Operations charged under ``factor`` of their product's mean rate.

    Products whose mean rate is not positive are left out. The rates are staged: with their true
    size known, the operations are only scanned as long as the rates are small.
    """
    facts = apply_filter(ops, f)
    products = stage(
        facts.groupBy("product")
        .agg(m.avg_rate().alias("market_avg_rate"))
        .where(F.col("market_avg_rate") > 0),
        "product-rates",
    )
    actual, market = F.col("actual_rate"), F.col("market_avg_rate")
    return (
        facts.select(
            "operation_id",
            "client_name",
            "product",
            F.col("business_value").alias("transaction_value"),
            (m.operation_rate() * 100).alias("actual_rate"),
        )
        .join(products, "product")
        .where(actual < market * factor)
        .select(
            "operation_id",
            "client_name",
            "product",
            "transaction_value",
            "actual_rate",
            "market_avg_rate",
            F.round((market - actual) / market * 100, 1).alias("discount_pct"),
        )
        .orderBy(
            F.desc("discount_pct"),
            F.asc_nulls_last("operation_id"),
            "product",
            F.asc_nulls_last("client_name"),
            F.asc_nulls_last("transaction_value"),
            "actual_rate",
        )
        .limit(n)
    )


def anomaly_count(
    ops: DataFrame, f: OpsFilter | None = None, *, factor: float = 0.7, n: int = 20
) -> DataFrame:
    """How many operations ``pricing_anomalies`` lists."""
    return pricing_anomalies(ops, f, factor=factor, n=n).agg(m.rows().alias("anomalies"))


def size_distribution(
    ops: DataFrame,
    f: OpsFilter | None = None,
    *,
    bands: Sequence[float] = SIZE_BANDS,
    labels: Labels = ENGLISH,
) -> DataFrame:
    """Operations by size, smallest band first; a NULL value falls in the last band."""
    value = F.col("business_value")
    band = F.lit(len(bands))
    for rank in reversed(range(len(bands))):
        band = F.when(value < bands[rank], rank).otherwise(band)
    return (
        apply_filter(ops, f)
        .groupBy(band.alias("band"))
        .agg(
            m.rows().alias("transaction_count"),
            m.sum_commission().alias("total_commission"),
            m.avg_rate().alias("avg_commission_rate"),
        )
        .orderBy("band")
        .select(
            F.get(F.lit(list(labels.bands)), F.col("band")).alias("size_band"),
            "transaction_count",
            "total_commission",
            "avg_commission_rate",
        )
    )
