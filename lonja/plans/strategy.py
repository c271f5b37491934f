"""Who may leave, what sells together, and what each class of clients is worth."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.functions import measures as m
from lonja.functions.calendar import valid_date
from lonja.labels import ENGLISH, Labels
from lonja.operators.cooccurrence import TILE_ITEMS, shared_holders
from lonja.operators.filters import OpsFilter, apply_filter
from lonja.operators.quantiles import percentiles
from lonja.runtime import releases_staged, stage

# Products whose pairs are counted first, to learn how many buyers a listed pair must share.
LEADING_PRODUCTS = 64

# Where commission per client is cut into segments.
SEGMENT_CUTS = (0.8, 0.5, 0.2)


def churn_risk(
    ops: DataFrame,
    f: OpsFilter | None = None,
    *,
    as_of: dt.date,
    days: int = 60,
    n: int = 15,
) -> DataFrame:
    """Clients idle for more than ``days`` at ``as_of``, by what they earned us.

    A client without any valid date is not listed; a text that is no date is no valid date.
    """
    return (
        apply_filter(ops, f)
        .groupBy("client_name")
        .agg(
            F.max(valid_date(F.col("registered_on"))).alias("last_transaction"),
            m.sum_commission().alias("lifetime_commission"),
            m.rows().alias("total_transactions"),
        )
        .withColumn("days_inactive", F.datediff(F.lit(as_of), "last_transaction"))
        .where(F.col("days_inactive") > days)
        .select(
            "client_name",
            "last_transaction",
            F.col("days_inactive").cast("bigint").alias("days_inactive"),
            "lifetime_commission",
            "total_transactions",
        )
        .orderBy(F.desc_nulls_last("lifetime_commission"), F.asc_nulls_last("client_name"))
        .limit(n)
    )


def churn_at_risk(
    ops: DataFrame,
    f: OpsFilter | None = None,
    *,
    as_of: dt.date,
    days: int = 60,
    n: int = 15,
) -> DataFrame:
    """Count and lifetime commission of the listed clients."""
    return churn_risk(ops, f, as_of=as_of, days=days, n=n).agg(
        m.rows().alias("clients_at_risk"),
        F.coalesce(m.exact_sum(F.col("lifetime_commission")), F.lit(0.0)).alias(
            "commission_at_risk"
        ),
    )


@releases_staged
def cross_sell(
    ops: DataFrame,
    f: OpsFilter | None = None,
    *,
    min_shared: int = 3,
    n: int | None = 10,
    leading: int = LEADING_PRODUCTS,
    tile_items: int = TILE_ITEMS,
) -> DataFrame:
    """Product pairs bought by the same buyers; ``n=None`` lists every pair.

    A pair shares no more buyers than its rarer product has. The pairs of the ``leading`` products
    with most buyers are counted first. A product with fewer buyers than the n-th best of those
    pairs shares can be in no listed pair, so only the products above that are counted together,
    and nothing more is when all of them were leading ones. Runs jobs to size the counts.
    """
    bought = stage(
        apply_filter(ops, f)
        .where(F.col("buyer_id").isNotNull())
        .select(F.col("buyer_id").alias("holder"), F.col("product").alias("item"))
        .distinct(),
        "bought",
    )
    holdings = bought.where(F.col("item").isNotNull())
    products = stage(
        holdings.groupBy("item").agg(m.rows().alias("holders")).where(F.col("holders") >= min_shared),
        "products",
    )

    if n is None:
        found = shared_holders(holdings, products, products.count(), min_shared, tile_items)
    else:
        first = products.orderBy(F.desc("holders"), "item").limit(leading)
        found = stage(shared_holders(holdings, first, leading, min_shared, tile_items), "pairs")
        best = found.orderBy(F.desc("shared")).limit(n).agg(F.min("shared"), m.rows()).first()
        least = best[0] if best[1] == n else min_shared
        chosen = products.where(F.col("holders") >= least)
        count = chosen.count()
        if count > leading:
            found = shared_holders(holdings, chosen, count, least, tile_items)
    buyers = bought.agg(F.count_distinct("holder")).scalar()
    pairs = found.select(
        F.col("item_a").alias("product_a"),
        F.col("item_b").alias("product_b"),
        F.col("shared").alias("shared_buyers"),
        F.round(F.col("shared") * 100.0 / buyers, 2).alias("market_penetration"),
    )
    order = [F.desc("shared_buyers"), "product_a", "product_b"]
    return pairs.orderBy(*order) if n is None else pairs.orderBy(*order).limit(n)


def client_segments(
    ops: DataFrame, f: OpsFilter | None = None, *, labels: Labels = ENGLISH
) -> DataFrame:
    """Clients cut at the 80th, 50th and 20th percentile of their commission.

    A client without any commission falls in the lowest segment. The totals per client are
    staged, since the percentiles and the segments both read them.
    """
    clients = stage(
        apply_filter(ops, f)
        .groupBy("client_name")
        .agg(
            m.sum_commission().alias("total"),
            m.rows().alias("transactions"),
            m.avg_commission().alias("mean"),
        ),
        "clients",
    )
    cuts = [F.lit(cut).cast("double") for cut in percentiles(clients, "total", SEGMENT_CUTS)]
    total = F.col("total")
    vip, high, medium, low = labels.segments
    segment = (
        F.when(total >= cuts[0], vip)
        .when(total >= cuts[1], high)
        .when(total >= cuts[2], medium)
        .otherwise(low)
    )
    return (
        clients.groupBy(segment.alias("segment"))
        .agg(
            m.rows().alias("client_count"),
            m.exact_sum(total).alias("segment_commission"),
            F.avg("transactions").alias("avg_transactions"),
            F.try_divide(m.exact_sum(F.col("mean")), F.count("mean")).alias(
                "avg_commission_per_deal"
            ),
        )
        .orderBy(F.desc_nulls_last("segment_commission"), "segment")
    )


def vip_share(
    ops: DataFrame, f: OpsFilter | None = None, *, labels: Labels = ENGLISH
) -> DataFrame:
    """Commission of the top segment, and its percent of all; 0 where all is not positive."""
    commission = F.col("segment_commission")
    top = F.when(F.col("segment") == labels.segments[0], commission)
    return (
        client_segments(ops, f, labels=labels)
        .agg(
            F.coalesce(m.exact_sum(top), F.lit(0.0)).alias("vip_commission"),
            m.exact_sum(commission).alias("total"),
        )
        .select(
            "vip_commission",
            F.when(F.col("total") > 0, F.col("vip_commission") / F.col("total") * 100)
            .otherwise(0.0)
            .alias("vip_percentage"),
        )
    )
