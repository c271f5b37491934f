"""Buyers and sellers: hubs, who pays, prospects next to our clients, and pairs that trade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.functions import measures as m
from lonja.labels import ENGLISH, Labels
from lonja.operators.filters import OpsFilter, apply_filter
from lonja.runtime import stage


def _hubs(facts: DataFrame, name: str, partner_id: str, least: int, n: int) -> DataFrame:
    return (
        facts.where(F.col(name).isNotNull() & F.col(partner_id).isNotNull())
        .groupBy(F.col(name).alias("hub"))
        .agg(
            F.count_distinct(partner_id).alias("partners"),
            m.sum_commission().alias("total_commission"),
            m.rows().alias("total_transactions"),
            m.sum_value().alias("total_volume"),
        )
        .where(F.col("partners") >= least)
        .orderBy(F.desc("partners"), F.desc_nulls_last("total_commission"), "hub")
        .limit(n)
    )


def seller_hubs(
    ops: DataFrame, f: OpsFilter | None = None, *, least: int = 2, n: int = 10
) -> DataFrame:
    """Sellers by the number of distinct buyers."""
    hubs = _hubs(apply_filter(ops, f), "seller_name", "buyer_id", least, n)
    return hubs.withColumnsRenamed({"hub": "seller", "partners": "unique_buyers"})


def buyer_hubs(
    ops: DataFrame, f: OpsFilter | None = None, *, least: int = 2, n: int = 10
) -> DataFrame:
    """Buyers by the number of distinct sellers."""
    hubs = _hubs(apply_filter(ops, f), "buyer_name", "seller_id", least, n)
    return hubs.withColumnsRenamed({"hub": "buyer", "partners": "unique_sellers"})


def principal_split(
    ops: DataFrame, f: OpsFilter | None = None, *, labels: Labels = ENGLISH
) -> DataFrame:
    """Activity by who pays: ``V`` the seller, ``C`` the buyer, other codes unknown."""
    payer = (
        F.when(F.col("principal") == "V", labels.seller_pays)
        .when(F.col("principal") == "C", labels.buyer_pays)
        .otherwise(labels.unknown_payer)
    )
    return (
        apply_filter(ops, f)
        .where(F.col("principal").isNotNull())
        .groupBy(payer.alias("principal_type"))
        .agg(
            m.rows().alias("transactions"),
            m.sum_commission().alias("total_commission"),
            m.avg_commission().alias("avg_commission"),
            m.sum_value().alias("total_volume"),
            m.avg_rate().alias("avg_commission_rate"),
        )
        .orderBy(F.desc_nulls_last("total_commission"), "principal_type")
    )


def principal_share(
    ops: DataFrame, f: OpsFilter | None = None, *, labels: Labels = ENGLISH
) -> DataFrame:
    """Each side's percent of what both sides pay; unknown payers are left out."""
    commission = F.col("total_commission")

    def paid(payer: str):
        of_payer = F.when(F.col("principal_type") == payer, commission)
        return F.coalesce(m.exact_sum(of_payer), F.lit(0.0))

    both = F.col("seller_commission") + F.col("buyer_commission")
    return (
        principal_split(ops, f, labels=labels)
        .agg(
            paid(labels.seller_pays).alias("seller_commission"),
            paid(labels.buyer_pays).alias("buyer_commission"),
        )
        .select(
            "*",
            (F.try_divide("seller_commission", both) * 100).alias("seller_percentage"),
            (F.try_divide("buyer_commission", both) * 100).alias("buyer_percentage"),
        )
    )


def _named_clients(ops: DataFrame, f: OpsFilter | None) -> DataFrame:
    return apply_filter(ops, f).where(
        F.col("client_id").isNotNull() & F.col("client_name").isNotNull()
    )


def current_clients(ops: DataFrame, f: OpsFilter | None = None) -> DataFrame:
    return _named_clients(ops, f).select("client_id", "client_name").distinct()


def _prospects(
    ops: DataFrame, f: OpsFilter | None, side: str, partner: str, payer: str, n: int
) -> DataFrame:
    """Traders of one side that deal with partners who paid us.

    The filter narrows who counts as our partner or client, not the dealings that are added
    up, and current clients are removed after the limit, so fewer than ``n`` may remain.
    """
    partner_id = f"{partner}_id"
    ours = (
        apply_filter(ops, f)
        .where((F.col("principal") == payer) & F.col(partner_id).isNotNull())
        .select(partner_id)
        .distinct()
    )
    # staged, so that the planner knows how few they are and need not shuffle the dealings to them
    ours = stage(ours, "partners")
    # one row per trader and partner before the join: the operations of a hot partner never
    # meet in one task, and counting rows then counts distinct partners
    dealings = (
        ops.where(F.col(f"{side}_id").isNotNull() & F.col(f"{side}_name").isNotNull())
        .groupBy(f"{side}_id", f"{side}_name", partner_id)
        .agg(
            *m.subtotal(F.col("business_value"), "value"),
            *m.subtotal(m.operation_rate(), "rate"),
            F.count(m.operation_rate()).alias("rated"),
            m.rows().alias("operations"),
        )
    )
    rate = F.try_divide(m.sum_of_subtotals("rate"), F.sum("rated")) * 100
    listed = (
        dealings.join(ours, partner_id, "left_semi")
        .groupBy(
            F.col(f"{side}_id").alias("prospect_id"), F.col(f"{side}_name").alias("prospect_name")
        )
        .agg(
            m.rows().alias("connections"),
            m.sum_of_subtotals("value").alias("total_volume"),
            F.sum("operations").alias("total_transactions"),
            rate.alias("avg_commission_rate"),
        )
        .withColumn(
            "commission_opportunity",
            F.round(F.col("total_volume") * (F.col("avg_commission_rate") / 100), 0),
        )
        .orderBy(
            F.desc("connections"),
            F.desc_nulls_last("total_volume"),
            "prospect_id",
            "prospect_name",
        )
        .limit(n)
    )
    known = _named_clients(ops, f).select("client_id").distinct()
    return listed.join(known, F.col("prospect_id") == F.col("client_id"), "left_anti")


def potential_buyers(ops: DataFrame, f: OpsFilter | None = None, *, n: int = 20) -> DataFrame:
    """Buyers who trade with sellers that paid us, without our current clients."""
    return _prospects(ops, f, "buyer", "seller", "V", n)


def potential_sellers(ops: DataFrame, f: OpsFilter | None = None, *, n: int = 20) -> DataFrame:
    """Sellers who trade with buyers that paid us, without our current clients."""
    return _prospects(ops, f, "seller", "buyer", "C", n)


def _both_sides(ops: DataFrame, f: OpsFilter | None, n: int, labels: Labels) -> DataFrame:
    buyers = potential_buyers(ops, f, n=n).withColumn("side", F.lit(labels.buyer))
    sellers = potential_sellers(ops, f, n=n).withColumn("side", F.lit(labels.seller))
    return buyers.unionByName(sellers)


def prospect_opportunity(
    ops: DataFrame, f: OpsFilter | None = None, *, n: int = 20, labels: Labels = ENGLISH
) -> DataFrame:
    """Prospects and their summed opportunity on each side; a side without any has no row."""
    return (
        _both_sides(ops, f, n, labels)
        .groupBy("side")
        .agg(
            m.rows().alias("prospects"),
            m.exact_sum(F.col("commission_opportunity")).alias("total_opportunity"),
        )
    )


def best_prospect(prospects: DataFrame) -> DataFrame:
    """The first row of either prospect list."""
    return prospects.orderBy(
        F.desc("connections"), F.desc_nulls_last("total_volume"), "prospect_id", "prospect_name"
    ).limit(1)


def priority_prospects(
    ops: DataFrame,
    f: OpsFilter | None = None,
    *,
    n: int = 10,
    per_side: int = 20,
    labels: Labels = ENGLISH,
) -> DataFrame:
    """The prospects of both sides with the most connections."""
    return (
        _both_sides(ops, f, per_side, labels)
        .select(
            "prospect_id",
            "prospect_name",
            "side",
            "connections",
            "commission_opportunity",
            "total_volume",
        )
        .orderBy(
            F.desc("connections"), F.desc_nulls_last("total_volume"), "side", "prospect_id",
            "prospect_name",
        )
        .limit(n)
    )


def trading_pairs(ops: DataFrame, f: OpsFilter | None = None) -> DataFrame:
    """The operations that name both a seller and a buyer."""
    return apply_filter(ops, f).where(
        F.col("seller_name").isNotNull() & F.col("buyer_name").isNotNull()
    )


def relationships(
    ops: DataFrame,
    f: OpsFilter | None = None,
    *,
    least: int = 3,
    n: int = 20,
    labels: Labels = ENGLISH,
) -> DataFrame:
    """Pairs with at least ``least`` operations, and which side pays.

    A pair that neither side ever paid is labelled as one where the buyer pays.
    """
    kind = (
        F.when((F.col("seller_paid") > 0) & (F.col("buyer_paid") > 0), labels.mutual)
        .when(F.col("seller_paid") > 0, labels.seller_pays)
        .otherwise(labels.buyer_pays)
    )
    return (
        trading_pairs(ops, f)
        .groupBy(F.col("seller_name").alias("seller"), F.col("buyer_name").alias("buyer"))
        .agg(
            m.rows().alias("transactions"),
            m.sum_commission().alias("total_commission"),
            m.sum_value().alias("total_volume"),
            F.count_if(F.col("principal") == "V").alias("seller_paid"),
            F.count_if(F.col("principal") == "C").alias("buyer_paid"),
        )
        .where(F.col("transactions") >= least)
        .orderBy(F.desc_nulls_last("total_commission"), "seller", "buyer")
        .limit(n)
        .withColumn("relationship_type", kind)
    )


def relationship_summary(
    ops: DataFrame,
    f: OpsFilter | None = None,
    *,
    least: int = 3,
    n: int = 20,
    labels: Labels = ENGLISH,
) -> DataFrame:
    """Counts and commission of the listed pairs."""
    mutual = F.col("relationship_type") == labels.mutual
    return relationships(ops, f, least=least, n=n, labels=labels).agg(
        m.rows().alias("total_relationships"),
        F.count_if(mutual).alias("mutual_relationships"),
        F.count_if(~mutual).alias("one_sided_relationships"),
        m.exact_sum(F.col("total_commission")).alias("total_commission"),
    )


def network_metrics(ops: DataFrame, f: OpsFilter | None = None) -> DataFrame:
    """Distinct sellers, buyers and pairs, and the mean operations per pair.

    Pairs are told apart by their joined text, so two that read the same count once.
    """
    facts = trading_pairs(ops, f)

    def different(value: Column) -> Column:
        """A subquery of its own, so that rows are not copied for each count."""
        return facts.select(value.alias("value")).distinct().agg(F.count("value")).scalar()

    pairs = facts.groupBy("seller_name", "buyer_name").agg(m.rows().alias("transactions"))
    return pairs.agg(F.avg("transactions").alias("avg_transactions_per_relationship")).select(
        different(F.col("seller_name")).alias("unique_sellers"),
        different(F.col("buyer_name")).alias("unique_buyers"),
        different(F.concat("seller_name", F.lit("-"), "buyer_name")).alias("unique_relationships"),
        "avg_transactions_per_relationship",
    )
