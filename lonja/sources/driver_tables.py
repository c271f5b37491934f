"""The operations table derived from a star schema of order lines.

``lineitem`` is the fact side; a dimension is joined only when a wanted column lives in it.
Every key is a non-null foreign key, so leaving a dimension out never changes the rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.schema import OPERATIONS_SCHEMA

# Which dimensions hold each column; a column not named here is in lineitem alone.
_NEEDS = {
    "client_id": {"orders"},
    "client_name": {"orders", "customer", "supplier"},
    "buyer_id": {"orders"},
    "buyer_name": {"orders", "customer"},
    "buyer_city": {"orders", "customer", "buyer_nation"},
    "seller_name": {"supplier"},
    "seller_city": {"supplier", "seller_nation"},
    "product": {"part"},
    "principal": {"orders"},
    "month_name": {"orders"},
    "year": {"orders"},
    "registered_on": {"orders"},
}


def _expressions() -> dict:
    buyer, seller = F.col("o_custkey"), F.col("l_suppkey")
    ordered_on = F.col("o_orderdate").cast("date")
    principal = (
        F.when((F.col("l_linestatus") == "O") & (seller % 5 != 0), "V")
        .when((F.col("l_linestatus") == "F") & (buyer % 3 == 0), "C")
        .when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), "X")
    )
    buyer_id = F.concat(F.lit("B"), buyer)
    seller_id = F.concat(F.lit("S"), seller)
    value = F.col("l_extendedprice") * 1000
    line_key = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    months = "enefebmarabrmayjunjulagosepoctnovdic"
    return {
        "operation_id": F.concat_ws("-", *[F.col(c).cast("string") for c in line_key]),
        "client_id": F.when(principal == "V", seller_id).when(principal == "C", buyer_id),
        "client_name": F.when(principal == "V", F.col("s_name")).when(
            principal == "C", F.col("c_name")
        ),
        "buyer_id": buyer_id,
        "buyer_name": F.col("c_name"),
        "buyer_city": F.col("buyer_city"),
        "seller_id": seller_id,
        "seller_name": F.col("s_name"),
        "seller_city": F.col("seller_city"),
        "product": F.col("p_name"),
        "business_value": value,
        "commission": value * F.col("l_discount"),
        "referrer": F.col("l_orderkey") % 20,
        "pct_ref_sale": F.col("l_tax") * 100,
        "pct_ref_purchase": F.col("l_linenumber").cast("double"),
        "principal": principal,
        "operation_type": F.when(F.col("l_returnflag") == "N", "RSG")
        .when(F.col("l_returnflag") == "R", "REX")
        .otherwise("RGC"),
        "month_name": F.substring(F.lit(months), F.month(ordered_on) * 3 - 2, F.lit(3)),
        "year": F.year(ordered_on),
        "registered_on": ordered_on,
    }


def operations(
    spark: SparkSession, folder: str, columns: Iterable[str] | None = None
) -> DataFrame:
    """The operations over the tables in ``folder``, with ``columns`` or with all of them."""
    wanted = list(columns) if columns is not None else OPERATIONS_SCHEMA.fieldNames()
    needed = set().union(*[_NEEDS.get(name, set()) for name in wanted])

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    def city(alias: str, key: str) -> DataFrame:
        return table("nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias(alias))

    # Every shuffle of the facts carries what was joined before it, so the dimensions that add least
    # come first. Nations are joined last: behind a join of two tables the planner knows no size, and
    # suppliers and customers that are small enough would not be broadcast.
    facts = table("lineitem")
    if "part" in needed:
        facts = facts.join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    if "supplier" in needed:
        facts = facts.join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    if "orders" in needed:
        orders = table("orders")
        if "customer" in needed:
            orders = orders.join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        facts = facts.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "seller_nation" in needed:
        facts = facts.join(city("seller_city", "s_nationkey"), "s_nationkey")
    if "buyer_nation" in needed:
        facts = facts.join(city("buyer_city", "c_nationkey"), "c_nationkey")
    expressions = _expressions()
    return facts.select(*[expressions[name].alias(name) for name in wanted])
