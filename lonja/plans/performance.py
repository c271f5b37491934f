"""Totals, trends and rankings of what operations earned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions import measures as m
from lonja.functions.calendar import month_rank
from lonja.operators.filters import OpsFilter, apply_filter


def total_records(ops: DataFrame, f: OpsFilter | None = None) -> DataFrame:
    return apply_filter(ops, f).agg(m.rows().alias("total_records"))


def overview(ops: DataFrame, f: OpsFilter | None = None) -> DataFrame:
    """Distinct clients and products, total value and commission, count and mean rate."""
    facts = apply_filter(ops, f)

    # counted apart, each distinct column is one narrow scan that shuffles only its own values;
    # beside the sums they would copy every row three times
    def distinct(column: str) -> Column:
        return facts.select(column).distinct().agg(F.count(column)).scalar()

    return facts.agg(
        m.sum_value().alias("total_volume"),
        m.sum_commission().alias("total_commission"),
        m.rows().alias("total_operations"),
        m.avg_rate().alias("avg_commission_rate"),
    ).select(
        distinct("client_name").alias("unique_clients"),
        distinct("product").alias("unique_products"),
        "*",
    )


def monthly_trend(ops: DataFrame, f: OpsFilter | None = None) -> DataFrame:
    """Commission, value and count per month label, in calendar order over all years."""
    return (
        apply_filter(ops, f)
        .groupBy("month_name")
        .agg(
            m.sum_commission().alias("commission"),
            m.sum_value().alias("volume"),
            m.rows().alias("operations"),
        )
        .orderBy(month_rank(F.col("month_name")), F.asc_nulls_last("month_name"))
    )


def _top_by_commission(facts: DataFrame, key: str, n: int) -> DataFrame:
    return (
        facts.groupBy(key)
        .agg(
            m.sum_commission().alias("commission"),
            m.rows().alias("transactions"),
            m.sum_value().alias("volume"),
            m.avg_rate().alias("avg_commission_rate"),
        )
        .orderBy(F.desc_nulls_last("commission"), F.asc_nulls_last(key))
        .limit(n)
    )


def top_clients(ops: DataFrame, f: OpsFilter | None = None, n: int = 10) -> DataFrame:
    return _top_by_commission(apply_filter(ops, f), "client_name", n)


def top_products(ops: DataFrame, f: OpsFilter | None = None, n: int = 10) -> DataFrame:
    return _top_by_commission(apply_filter(ops, f), "product", n)


def referrers(ops: DataFrame, f: OpsFilter | None = None) -> DataFrame:
    """Per referrer: activity, and earnings from both percentages (NULL if one has no value)."""
    commission = F.col("commission")
    earned_on_sale = m.exact_sum(commission * (F.col("pct_ref_sale") / 100.0))
    earned_on_purchase = m.exact_sum(commission * (F.col("pct_ref_purchase") / 100.0))
    return (
        apply_filter(ops, f)
        .where(F.col("referrer").isNotNull() & (F.col("referrer") != 0))
        .groupBy("referrer")
        .agg(
            m.rows().alias("total_operations"),
            m.sum_commission().alias("total_commission"),
            m.sum_value().alias("total_volume"),
            m.avg_commission().alias("avg_commission_per_op"),
            (earned_on_sale + earned_on_purchase).alias("referrer_earnings"),
        )
        .orderBy(F.desc_nulls_last("total_commission"), "referrer")
    )


def top_referrers(ops: DataFrame, f: OpsFilter | None = None, n: int = 10) -> DataFrame:
    return referrers(ops, f).limit(n)


def referrer_summary(ops: DataFrame, f: OpsFilter | None = None) -> DataFrame:
    return referrers(ops, f).agg(
        m.rows().alias("total_referrers"),
        F.coalesce(m.exact_sum(F.col("total_commission")), F.lit(0.0)).alias("total_commission"),
        F.coalesce(m.exact_sum(F.col("referrer_earnings")), F.lit(0.0)).alias("total_earnings"),
    )
