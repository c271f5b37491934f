"""Registered queries against DuckDB at the smallest scale; tools/check_oracle.py runs them all."""

import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, open_duck  # noqa: E402
from lonja.runtime import drop_staged  # noqa: E402

FOLDER = entry.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")

SAMPLE = """s01_csv_round_trip s11_published_upsert s12_upsert_summary f03_list_months q01_overview
q04_referrers_filtered q08_churn_risk q10_cross_sell q10_cross_sell_tiles q11_client_segments_filtered
q18_potential_buyers_filtered q22_priority_prospects q24_relationship_type
q27_network_nodes_whole q32_bridge_node q37_market_comparison_own_filtered q43_by_weekday_filtered
q48_pareto q50_pricing_anomalies""".split()


@pytest.fixture(scope="module")
def duck():
    return open_duck(FOLDER)


def test_every_query_has_sql():
    own = set() if entry.llm_queries is None else {*entry.llm_queries.QUERIES, "pipeline"}
    assert set(entry.queries()) - own == set(entry.oracle_sql()) - own
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    query, sql = entry.queries()[name], entry.oracle_sql()[name]
    assert compare(spark, duck, query, sql, FOLDER) is None


def test_stored_table_gives_the_same_rows(spark, duck):
    entry.store_operations(spark, FOLDER)
    try:
        name = "q52_size_distribution"
        query, sql = entry.queries()[name], entry.oracle_sql()[name]
        assert compare(spark, duck, query, sql, FOLDER) is None
    finally:
        entry._stored.clear()


@pytest.mark.parametrize("name", ["s10_upsert", "q20_prospect_opportunity", "q22_priority_prospects_filtered"])
def test_operations_that_are_read_often_are_derived_once(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan


def test_the_batch_of_an_upload_reads_the_table_once(spark, make_ops):
    kinds = ["REX", "RSG", "RGC", None]
    ops = make_ops(*[{"operation_id": f"id{n}", "operation_type": kinds[n % 4]} for n in range(8)])
    batch = entry._batch(ops)
    assert sorted(r.operation_id for r in batch.collect()) == ["N-id1", "N-id5", "id0", "id4"]
    assert "Union" not in batch._jdf.queryExecution().optimizedPlan().toString()
    null = entry._batch(make_ops({"operation_id": None, "operation_type": "RSG"}))
    assert [r.operation_id for r in null.collect()] == [None]


def test_an_export_leaves_no_staged_operations(spark, tmp_path):
    drop_staged(spark)
    for name in ("s14_template", "s01_csv_round_trip"):
        entry.queries()[name](spark, FOLDER)
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/lonja-{spark.sparkContext.applicationId}"
    assert sorted(n.split("-")[0] for n in os.listdir(folder)) == ["export", "filled", "template"]
