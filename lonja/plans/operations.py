"""When, what kind and where: weekday, operation type and city patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.functions import measures as m
from lonja.functions.calendar import valid_date, weekday_label, weekday_name, weekday_number
from lonja.operators.filters import OpsFilter, apply_filter


def by_weekday(ops: DataFrame, f: OpsFilter | None = None) -> DataFrame:
    """Monday first; operations without a valid date last."""
    return (
        apply_filter(ops, f)
        .groupBy(weekday_number(valid_date(F.col("registered_on"))).alias("day_number"))
        .agg(
            m.rows().alias("operations"),
            m.sum_commission().alias("commission"),
            m.avg_commission().alias("avg_commission"),
        )
        .select(
            "day_number",
            weekday_name(F.col("day_number")).alias("day_of_week"),
            "operations",
            "commission",
            "avg_commission",
        )
        .orderBy(F.asc_nulls_last("day_number"))
    )


def weekday_labels(weekdays: DataFrame) -> DataFrame:
    """``by_weekday`` with Spanish day names."""
    return weekdays.withColumn("day_of_week", weekday_label(F.col("day_of_week")))


def by_operation_type(ops: DataFrame, f: OpsFilter | None = None) -> DataFrame:
    return (
        apply_filter(ops, f)
        .groupBy("operation_type")
        .agg(
            m.rows().alias("operations"),
            m.sum_commission().alias("commission"),
            m.sum_value().alias("volume"),
        )
        .orderBy(F.desc("operations"), F.asc_nulls_last("operation_type"))
    )


def _cities(facts: DataFrame, column: str, n: int) -> DataFrame:
    return (
        facts.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("city"))
        .agg(m.rows().alias("operations"), m.sum_commission().alias("commission"))
        .orderBy(F.desc_nulls_last("commission"), "city")
        .limit(n)
    )


def buyer_cities(ops: DataFrame, f: OpsFilter | None = None, *, n: int = 10) -> DataFrame:
    return _cities(apply_filter(ops, f), "buyer_city", n)


def seller_cities(ops: DataFrame, f: OpsFilter | None = None, *, n: int = 10) -> DataFrame:
    return _cities(apply_filter(ops, f), "seller_city", n)
