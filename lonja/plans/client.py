"""One client's activity, partners and costs, and its rates against the market.

``client_id`` is a value or a one-row subquery column. Only ``client_list`` and
``market_comparison`` follow the shared filter; the others cover all of the client's operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions import measures as m
from lonja.functions.calendar import month_rank
from lonja.labels import ENGLISH, Labels
from lonja.operators.filters import OpsFilter, apply_filter
from lonja.plans.network import current_clients

# Fixed value: the share of an operation's value that counts as tax benefit.
TAX_BENEFIT = 0.15


def client_list(ops: DataFrame, f: OpsFilter | None = None) -> DataFrame:
    """Clients by name."""
    return current_clients(ops, f).select("client_name", "client_id").orderBy(
        "client_name", "client_id"
    )


def _of_client(ops: DataFrame, client_id: str | Column) -> DataFrame:
    return ops.where(F.col("client_id") == client_id)


def client_stats(ops: DataFrame, client_id: str | Column) -> DataFrame:
    """Totals, first and last date, and the partners met as payer."""
    return _of_client(ops, client_id).agg(
        m.rows().alias("total_transactions"),
        m.sum_value().alias("total_volume"),
        m.sum_commission().alias("total_commission_paid"),
        F.min("registered_on").alias("first_transaction"),
        F.max("registered_on").alias("last_transaction"),
        F.count_distinct(F.when(F.col("principal") == "V", F.col("buyer_id"))).alias(
            "unique_buyers"
        ),
        F.count_distinct(F.when(F.col("principal") == "C", F.col("seller_id"))).alias(
            "unique_sellers"
        ),
        m.avg_rate().alias("avg_commission_rate"),
    )


def market_comparison(
    ops: DataFrame,
    client_id: str | Column,
    f: OpsFilter | None = None,
    *,
    n: int = 10,
    own_transactions: bool = False,
    labels: Labels = ENGLISH,
) -> DataFrame:
    """Products the client trades: its mean rate against everyone's.

    ``client_transactions`` counts the product's operations by all clients;
    ``own_transactions`` adds a count of the client's own.
    """
    own = F.col("client_id") == client_id
    own_value = F.when(own, F.col("business_value")).otherwise(0.0)
    client_rate, market_rate = F.col("client_rate"), F.col("market_avg_rate")
    against_market = (
        F.when(client_rate < market_rate, labels.below_market)
        .when(client_rate > market_rate, labels.above_market)
        .otherwise(labels.at_market)
    )
    compared = (
        apply_filter(ops, f)
        .groupBy("product")
        .agg(
            m.rows().alias("client_transactions"),
            m.mean_rate(F.when(own, m.operation_rate())).alias("client_rate"),
            m.avg_rate().alias("market_avg_rate"),
            m.exact_sum(own_value).alias("client_volume"),
            F.count_if(own).alias("client_only_transactions"),
        )
        .where(F.col("client_only_transactions") > 0)
        .orderBy(F.desc_nulls_last("client_volume"), F.asc_nulls_last("product"))
        .limit(n)
        .withColumn("vs_market", against_market)
    )
    return compared if own_transactions else compared.drop("client_only_transactions")


def client_trend(ops: DataFrame, client_id: str | Column) -> DataFrame:
    """Per month label, in calendar order."""
    return (
        _of_client(ops, client_id)
        .groupBy("month_name")
        .agg(
            m.rows().alias("transactions"),
            m.sum_value().alias("volume"),
            m.sum_commission().alias("commission_paid"),
        )
        .orderBy(month_rank(F.col("month_name")), F.asc_nulls_last("month_name"))
    )


def _partners(
    ops: DataFrame, client_id: str | Column, payer: str, partner: str, n: int
) -> DataFrame:
    return (
        _of_client(ops, client_id)
        .where(F.col("principal") == payer)
        .groupBy(F.col(partner).alias("partner"))
        .agg(
            m.rows().alias("transactions"),
            m.sum_value().alias("total_volume"),
            F.max("registered_on").alias("last_transaction"),
        )
        .orderBy(F.desc_nulls_last("total_volume"), F.asc_nulls_last("partner"))
        .limit(n)
    )


def client_top_buyers(ops: DataFrame, client_id: str | Column, *, n: int = 10) -> DataFrame:
    """Buyers of a client that pays as seller."""
    return _partners(ops, client_id, "V", "buyer_name", n)


def client_top_suppliers(ops: DataFrame, client_id: str | Column, *, n: int = 10) -> DataFrame:
    """Sellers to a client that pays as buyer."""
    return _partners(ops, client_id, "C", "seller_name", n)


def client_costs(ops: DataFrame, client_id: str | Column) -> DataFrame:
    """Per year, newest first."""
    return (
        _of_client(ops, client_id)
        .groupBy("year")
        .agg(
            m.sum_commission().alias("commission_paid"),
            m.sum_value().alias("volume"),
            m.rows().alias("transactions"),
            m.avg_rate().alias("effective_rate"),
        )
        .orderBy(F.desc_nulls_last("year"))
    )


def client_tax_benefit(ops: DataFrame, client_id: str | Column) -> DataFrame:
    """Estimated tax benefit less commission, and that as a percent of commission."""
    paid, net = F.col("total_commission"), F.col("net_benefit")
    return (
        _of_client(ops, client_id)
        .agg(m.sum_commission().alias("total_commission"), m.sum_value().alias("total_volume"))
        .withColumn("estimated_tax_benefit", F.col("total_volume") * TAX_BENEFIT)
        .withColumn("net_benefit", F.col("estimated_tax_benefit") - paid)
        .withColumn("roi_percentage", F.try_divide(net, paid) * 100)
    )
