
from __future__ import annotations

import datetime as dt
import os
import sys
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_queries  # noqa: E402
from lonja.functions.calendar import month_rank  # noqa: E402
from lonja.operators import filters  # noqa: E402
from lonja.operators.filters import OpsFilter, apply_filter  # noqa: E402
from lonja.plans import client, graph, network, operations, performance, risk, strategy  # noqa: E402
from lonja.runtime import release, shuffles_dropped, stage, staging_root  # noqa: E402
from lonja.schema import OPERATIONS_SCHEMA, SOURCE_COLUMNS  # noqa: E402
from lonja.sources import csv_files, driver_tables, store, upsert  # noqa: E402

try:  # the operators for training text come as a package of their own, which may be left out
    import corpus_pipeline
    import lonja.llm.oracle as llm_oracle
    import lonja.llm.queries as llm_queries
except ModuleNotFoundError as error:
    if not (error.name or "").startswith(("corpus_pipeline", "lonja.llm")):
        raise
    llm_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"
AS_OF = dt.date(2001, 8, 2)
FILTER = OpsFilter(
    months=("ene", "feb", "mar"), years=(1996, 1997), operation_types=("RSG", "REX")
)

_MONEY = ("business_value", "commission")
_FILTER_COLUMNS = ("month_name", "year", "operation_type")
_PARTIES = ("buyer_id", "buyer_name", "seller_id", "seller_name")
_ALL = tuple(OPERATIONS_SCHEMA.fieldNames())

# Tables stored by ``store_operations``, by application and folder.
_stored: dict[tuple[str, str], DataFrame] = {}


def store_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the operations table once; queries of this application then read it."""
    folder = _scratch(spark, "operations")
    table = store.create_operations(driver_tables.operations(spark, sf_dir), folder, buckets=8).rows()
    _stored[spark.sparkContext.applicationId, sf_dir] = table
    return table


def _operations(spark: SparkSession, sf_dir: str, columns: Iterable[str]) -> DataFrame:
    table = _stored.get((spark.sparkContext.applicationId, sf_dir))
    if table is not None:
        return table.select(*columns)
    return driver_tables.operations(spark, sf_dir, columns)


def _derived_once(spark: SparkSession, sf_dir: str, columns: Iterable[str]) -> DataFrame:
    """The operations for a query that reads them more than once, or writes much beside them: their
    joins run once, and what these have shuffled is gone when the query begins."""
    ops = _operations(spark, sf_dir, columns)
    stored = (spark.sparkContext.applicationId, sf_dir) in _stored
    return ops if stored else stage(ops, "operations", store.CODEC)


def _scratch(spark: SparkSession, name: str) -> str:
    application = spark.sparkContext.applicationId
    return f"{staging_root(spark)}/lonja-{application}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class _Query:
    """What a query computes and the operation columns it needs."""

    build: Callable
    columns: tuple[str, ...]
    filtered: bool = True
    operations: Callable = _operations

    def unfiltered_run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        ops = self.operations(spark, sf_dir, self.columns)
        return self.build(ops, None) if self.filtered else self.build(ops)

    def filtered_run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = dict.fromkeys(self.columns + _FILTER_COLUMNS)
        return self.build(self.operations(spark, sf_dir, columns), FILTER)


def _first_client(ops: DataFrame):
    return ops.agg(F.min("client_id")).scalar()


def _first_seller_client(ops: DataFrame):
    return ops.where(F.col("principal") == "V").agg(F.min("client_id")).scalar()


def _graph_queries() -> dict[str, _Query]:
    columns = ("seller_name", "buyer_name", "commission")
    parts = {
        "q27_network_nodes": graph.network_nodes,
        "q28_edge_scaling": graph.edge_scaling,
        "q29_network_size": graph.network_size,
        "q30_most_connected": graph.most_connected,
        "q31_network_health": graph.network_health,
        "q33_top_network_hubs": graph.top_network_hubs,
    }
    found = {"q26_network_edges": _Query(graph.network_edges, columns)}
    found["q26_network_edges_whole"] = _Query(
        lambda o, f: graph.network_edges(o, f, n=None), columns
    )
    for name, part in parts.items():
        found[name] = _Query(lambda o, f, part=part: part(graph.network_edges(o, f)), columns)
        found[f"{name}_whole"] = _Query(
            lambda o, f, part=part: part(graph.network_edges(o, f, n=None)), columns
        )
    for name, part in {
        "q32_betweenness": graph.node_betweenness,
        "q32_bridge_node": graph.bridge_node,
    }.items():
        found[name] = _Query(lambda o, f, part=part: part(graph.network_edges(o, f)), columns)
    # the largest graph that the dashboard draws, in rounds; and a sample that takes every node
    found["q32_betweenness_100_pairs"] = _Query(
        lambda o, f: graph.node_betweenness(graph.network_edges(o, f, n=100), rounds=3), columns
    )
    found["q32_betweenness_all_sources"] = _Query(
        lambda o: graph.node_betweenness(graph.network_edges(o), sources=1000), columns, False
    )
    return found


def _client_queries() -> dict[str, _Query]:
    def of_first(part: Callable, *columns: str) -> _Query:
        return _Query(lambda o: part(o, _first_client(o)), ("client_id", *columns), False)

    return {
        "q35_client_list": _Query(client.client_list, ("client_id", "client_name")),
        "q36_client_stats": of_first(
            client.client_stats, *_MONEY, "registered_on", "principal", "buyer_id", "seller_id"
        ),
        "q37_market_comparison": _Query(
            lambda o, f: client.market_comparison(o, _first_client(apply_filter(o, f)), f),
            ("client_id", "product", *_MONEY),
        ),
        "q37_market_comparison_own": _Query(
            lambda o, f: client.market_comparison(
                o, _first_client(apply_filter(o, f)), f, own_transactions=True
            ),
            ("client_id", "product", *_MONEY),
        ),
        "q38_client_trend": of_first(client.client_trend, *_MONEY, "month_name"),
        "q39_client_top_buyers": _Query(
            lambda o: client.client_top_buyers(o, _first_seller_client(o)),
            ("client_id", "principal", "buyer_name", "business_value", "registered_on"),
            False,
        ),
        "q40_client_top_suppliers": of_first(
            client.client_top_suppliers,
            "principal", "seller_name", "business_value", "registered_on",
        ),
        "q41_client_costs": of_first(client.client_costs, *_MONEY, "year"),
        "q42_client_tax_benefit": of_first(client.client_tax_benefit, *_MONEY),
    }


def _text_dates(ops: DataFrame) -> DataFrame:
    """Dates as a table without a schema holds them, some of them invalid."""
    text = F.date_format("registered_on", "yyyy-MM-dd")
    bad = F.col("operation_id").endswith("1")
    return ops.withColumn("registered_on", F.when(bad, "31/31/2025").otherwise(text))


def _fractional_percents(ops: DataFrame) -> DataFrame:
    shares = {name: F.col(name) / 7 for name in ("pct_ref_sale", "pct_ref_purchase")}
    return ops.withColumns(shares)


def _catalogue() -> dict[str, _Query]:
    referrer = ("referrer", *_MONEY, "pct_ref_sale", "pct_ref_purchase")
    churn = ("client_name", "registered_on", "commission")
    bought = ("buyer_id", "product")
    segments = ("client_name", "commission")
    payer = ("principal", *_MONEY)
    pairs = ("seller_name", "buyer_name", *payer)
    prospects = (*_PARTIES, "client_id", "client_name", *payer)
    priced = ("operation_id", "client_name", "product", *_MONEY)
    days = ("registered_on", "commission")
    text_days = ("operation_id", *days)
    return {
        "f03_list_months": _Query(filters.list_months, ("month_name",), False),
        "f04_list_years": _Query(filters.list_years, ("year",), False),
        "f05_list_operation_types": _Query(
            filters.list_operation_types, ("operation_type",), False
        ),
        "f06_month_rank": _Query(
            lambda o: o.groupBy("month_name", month_rank(F.col("month_name")).alias("rank")).agg(
                F.count(F.lit(1)).alias("operations")
            ),
            ("month_name",),
            False,
        ),
        "q00_total_records": _Query(performance.total_records, ("operation_id",)),
        "q01_overview": _Query(performance.overview, ("client_name", "product", *_MONEY)),
        "q02_monthly_trend": _Query(performance.monthly_trend, ("month_name", *_MONEY)),
        "q03_top_clients": _Query(performance.top_clients, ("client_name", *_MONEY)),
        "q04_referrers": _Query(performance.referrers, referrer),
        "q04_referrers_fractional": _Query(
            lambda o, f: performance.referrers(_fractional_percents(o), f), referrer
        ),
        "q05_top_referrers": _Query(performance.top_referrers, referrer),
        "q06_referrer_summary": _Query(performance.referrer_summary, referrer),
        "q07_top_products": _Query(performance.top_products, ("product", *_MONEY)),
        "q08_churn_risk": _Query(lambda o, f: strategy.churn_risk(o, f, as_of=AS_OF), churn),
        "q09_churn_at_risk": _Query(lambda o, f: strategy.churn_at_risk(o, f, as_of=AS_OF), churn),
        "q08_churn_risk_text_dates": _Query(
            lambda o, f: strategy.churn_risk(_text_dates(o), f, as_of=AS_OF),
            ("operation_id", *churn),
        ),
        "q09_churn_at_risk_text_dates": _Query(
            lambda o, f: strategy.churn_at_risk(_text_dates(o), f, as_of=AS_OF),
            ("operation_id", *churn),
        ),
        "q10_cross_sell": _Query(strategy.cross_sell, bought),
        "q10_cross_sell_all_pairs": _Query(
            lambda o, f: strategy.cross_sell(o, f, n=None), bought
        ),
        # few leading products and small tiles, so that the rest is counted too, and across tiles
        "q10_cross_sell_tiles": _Query(
            lambda o, f: strategy.cross_sell(o, f, n=40, leading=16, tile_items=8), bought
        ),
        "q11_client_segments": _Query(strategy.client_segments, segments),
        "q12_vip_share": _Query(strategy.vip_share, segments),
        "q13_seller_hubs": _Query(network.seller_hubs, ("seller_name", "buyer_id", *_MONEY)),
        "q14_buyer_hubs": _Query(network.buyer_hubs, ("buyer_name", "seller_id", *_MONEY)),
        "q15_principal_split": _Query(network.principal_split, payer),
        "q16_principal_share": _Query(network.principal_share, payer),
        "q17_current_clients": _Query(network.current_clients, ("client_id", "client_name")),
        "q18_potential_buyers": _Query(network.potential_buyers, prospects),
        "q19_potential_sellers": _Query(network.potential_sellers, prospects),
        "q20_prospect_opportunity": _Query(
            network.prospect_opportunity, prospects, operations=_derived_once
        ),
        "q21_best_prospect_buyer": _Query(
            lambda o, f: network.best_prospect(network.potential_buyers(o, f)), prospects
        ),
        "q21_best_prospect_seller": _Query(
            lambda o, f: network.best_prospect(network.potential_sellers(o, f)), prospects
        ),
        "q22_priority_prospects": _Query(
            network.priority_prospects, prospects, operations=_derived_once
        ),
        "q23_relationships": _Query(
            lambda o, f: network.relationships(o, f).drop("relationship_type"), pairs
        ),
        "q24_relationship_type": _Query(network.relationships, pairs),
        "q25_relationship_summary": _Query(network.relationship_summary, pairs),
        **_graph_queries(),
        "q34_network_metrics": _Query(network.network_metrics, ("seller_name", "buyer_name")),
        **_client_queries(),
        "q43_by_weekday": _Query(operations.by_weekday, days),
        "q44_weekday_labels": _Query(
            lambda o, f: operations.weekday_labels(operations.by_weekday(o, f)), days
        ),
        "q43_by_weekday_text_dates": _Query(
            lambda o, f: operations.by_weekday(_text_dates(o), f), text_days
        ),
        "q44_weekday_labels_text_dates": _Query(
            lambda o, f: operations.weekday_labels(operations.by_weekday(_text_dates(o), f)),
            text_days,
        ),
        "q45_by_operation_type": _Query(operations.by_operation_type, ("operation_type", *_MONEY)),
        "q46_buyer_cities": _Query(operations.buyer_cities, ("buyer_city", "commission")),
        "q47_seller_cities": _Query(operations.seller_cities, ("seller_city", "commission")),
        "q48_pareto": _Query(risk.pareto, ("client_name", "commission")),
        "q49_concentration": _Query(risk.concentration, ("client_name", "commission")),
        "q50_pricing_anomalies": _Query(risk.pricing_anomalies, priced),
        "q51_anomaly_count": _Query(risk.anomaly_count, priced),
        "q52_size_distribution": _Query(risk.size_distribution, _MONEY),
    }


# --- sources and table maintenance, over the whole table ---


def _export(spark: SparkSession, table: DataFrame, ops: DataFrame, name: str = "export", **options) -> str:
    """Write ``table`` as text; the staged operations that it is made of go."""
    path = _scratch(spark, name)
    with shuffles_dropped(spark):
        table.write.csv(path, header=True, **options)
    release(ops)
    return path


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as users' exports are: semicolons, ISO-8859-1, padded headers, day-first dates."""
    ops = _derived_once(spark, sf_dir, _ALL)
    headers = {ours: theirs for theirs, ours in SOURCE_COLUMNS.items()}
    exported = ops.withColumns(
        {
            "buyer_city": F.concat(F.lit("Ñ "), "buyer_city"),
            "registered_on": F.date_format("registered_on", "d/MM/yyyy"),
        }
    ).toDF(*[f" {headers[name]} " for name in ops.columns])
    path = _export(spark, exported, ops, sep=";", encoding="ISO-8859-1")
    return csv_files.read_operations_csv(spark, path, schema=OPERATIONS_SCHEMA)


def _quoted_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some buyers' names hold line breaks, delimiters and quotes, and some cities begin with inches."""
    ops = _derived_once(spark, sf_dir, _ALL)
    broken = F.concat("buyer_name", F.lit('\n"two", '), "buyer_id", F.lit("\n\nlines;"))
    exported = ops.withColumns(
        {
            "buyer_name": F.when(F.col("referrer") % 5 == 0, broken).otherwise(F.col("buyer_name")),
            "seller_city": F.when(F.col("referrer") == 7, F.concat(F.lit('5" '), "seller_city")).otherwise(
                F.col("seller_city")
            ),
        }
    )
    path = _export(spark, exported, ops, escape='"')
    return csv_files.read_operations_csv(spark, path, schema=OPERATIONS_SCHEMA)


def _decimal_commas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as spreadsheets write them: a comma before the decimals, points between thousands."""
    ops = _operations(spark, sf_dir, ("operation_id", *_MONEY))
    written = {name: F.translate(F.format_number(F.round(name, 2), 2), ",.", ".,") for name in _MONEY}
    path = _scratch(spark, "export")
    ops.withColumns(written).write.csv(path, header=True, sep=";")
    return csv_files.read_operations_csv(spark, path, schema=OPERATIONS_SCHEMA, decimal=",")


def _schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _operations(spark, sf_dir, _ALL)
    return csv_files.schema_report(_batch(ops), ops)


def _template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upload that follows the template: its header, and all rows below."""
    ops = _derived_once(spark, sf_dir, _ALL)
    path = _scratch(spark, "template")
    csv_files.write_template(ops, path)
    header = spark.read.csv(path, header=True).columns
    filled = _export(spark, ops.select(*header), ops, "filled")
    return csv_files.read_operations_csv(spark, filled, ",", "UTF-8", OPERATIONS_SCHEMA, multi_line=False)


def _dates_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _operations(spark, sf_dir, ("operation_id", "operation_type", "registered_on"))
    text = (
        F.when(F.col("operation_type") == "RSG", F.date_format("registered_on", "d/M/yyyy"))
        .when(F.col("operation_type") == "REX", F.date_format("registered_on", "yyyy-MM-dd"))
        .otherwise(F.date_format("registered_on", "MM/31/yyyy"))
    )
    written = ops.select("operation_id", text.alias("registered_on"))
    return csv_files.coerce_dates(written, OPERATIONS_SCHEMA)


def _batch(ops: DataFrame) -> DataFrame:
    """An upload: all exports re-stated, all plain records again under new ids."""
    sent = ops.select(
        "operation_id",
        "client_name",
        (F.col("commission") * 2).alias("commission"),
        F.date_format("registered_on", "d/MM/yyyy").alias("registered_on"),
        F.lit("unknown column").alias("note"),
        "operation_type",
    )
    plain = F.col("operation_type") == "RSG"
    new = F.when(plain, F.concat(F.lit("N-"), "operation_id")).otherwise(F.col("operation_id"))
    return sent.where(plain | (F.col("operation_type") == "REX")).withColumn("operation_id", new)


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _derived_once(spark, sf_dir, _ALL)
    return upsert.upsert(ops, _batch(ops))


def _upsert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _operations(
        spark,
        sf_dir,
        ("operation_id", "client_name", "commission", "registered_on", "operation_type"),
    )
    return upsert.upsert_summary(ops, _batch(ops))


def _create(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _operations(spark, sf_dir, _ALL)
    return store.create_operations(ops, _scratch(spark, "table"), ("year",), buckets=4).rows()


def _published_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upsert written into the very table that it reads, in place."""
    folder = _scratch(spark, "table")
    table = store.create_operations(_operations(spark, sf_dir, _ALL), folder, ("year",), buckets=4)
    upsert.upsert_table(table, _batch(table.rows()))
    return store.read_table(spark, folder)


def _published_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a whole new version."""
    folder = _scratch(spark, "table")
    table = store.create_operations(_operations(spark, sf_dir, _ALL), folder, ("year",), buckets=4)
    store.publish(upsert.upsert(table.rows(), _batch(table.rows())), table)
    return store.read_table(spark, folder)


def _stored_upsert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upload would change in a stored table, from the buckets that its keys fall into."""
    ops = _operations(spark, sf_dir, _ALL)
    table = store.create_operations(ops, _scratch(spark, "table"), buckets=8)
    return upsert.upsert_table_summary(table, _batch(table.rows()))


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _operations(spark, sf_dir, _ALL)
    return csv_files.preview(ops.orderBy(*_ALL))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "snapshot")
    store.save_snapshot(_operations(spark, sf_dir, _ALL), path)
    return store.load_snapshot(spark, path)


_MAINTENANCE = {
    "s01_csv_round_trip": _csv_round_trip,
    "s01_quoted_breaks": _quoted_breaks,
    "s01_decimal_commas": _decimal_commas,
    "s05_create_operations": _create,
    "s07_schema_report": _schema_report,
    "s09_coerce_dates": _dates_from_text,
    "s10_upsert": _upsert,
    "s11_published_upsert": _published_upsert,
    "s11_published_whole": _published_whole,
    "s12_upsert_summary": _upsert_summary,
    "s12_stored_upsert_summary": _stored_upsert_summary,
    "s13_preview": _preview,
    "s14_template": _template,
    "s15_snapshot": _snapshot,
}


def entry(spark: SparkSession) -> DataFrame:
    """The clients that earned the most commission."""
    return queries()["q03_top_clients"](spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query over all operations, and those that take the filter also under a fixed one."""
    found: dict[str, Callable] = dict(_MAINTENANCE)
    for name, query in _catalogue().items():
        found[name] = query.unfiltered_run
        if query.filtered:
            found[f"{name}_filtered"] = query.filtered_run
    if llm_queries is not None:
        found.update(llm_queries.QUERIES, pipeline=corpus_pipeline.run)
    return found


def oracle_sql() -> dict[str, str]:
    """SQL for every query that SQL can express; the others are tested against plain code."""
    own = set(llm_queries.QUERIES) | {"pipeline"} if llm_queries is not None else set()
    found = oracle_queries.build({name: q for name, q in queries().items() if name not in own})
    if llm_queries is not None:
        found.update(llm_oracle.SQL)
        if corpus_pipeline.ORACLE_SQL is not None:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
