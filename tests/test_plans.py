import datetime as dt

import pytest
from pyspark.sql import functions as F

from lonja.labels import SPANISH
from lonja.operators.filters import OpsFilter
from lonja.plans import client, graph, network, operations, performance, risk, strategy

AS_OF = dt.date(2025, 3, 10)


def rows(df):
    return [row.asDict() for row in df.collect()]


def test_referrers_leave_out_zero_and_null(make_ops):
    ops = make_ops(
        {"referrer": None}, {"referrer": 0}, {"referrer": 7},
        {"referrer": 8, "pct_ref_sale": None, "commission": 3.0},
    )
    found = rows(performance.referrers(ops))
    assert [(r["referrer"], r["referrer_earnings"]) for r in found] == [(7, 1.5), (8, None)]
    assert rows(performance.top_referrers(ops, n=1)) == found[:1]
    assert rows(performance.referrer_summary(ops)) == [
        {"total_referrers": 2, "total_commission": 13.0, "total_earnings": 1.5}
    ]


def test_overview_and_months(make_ops):
    ops = make_ops(
        {}, {"client_name": None, "product": "rice"}, {"month_name": "dic", "year": 2024},
        {"month_name": "odd"}, {"month_name": None, "commission": None},
    )
    assert rows(performance.overview(ops))[0]["unique_clients"] == 1
    assert rows(performance.overview(ops))[0]["unique_products"] == 2
    assert performance.total_records(ops).first()[0] == 5
    months = [(r["month_name"], r["operations"]) for r in rows(performance.monthly_trend(ops))]
    assert months == [("odd", 1), (None, 1), ("enero", 2), ("dic", 1)]
    filtered = rows(performance.monthly_trend(ops, OpsFilter(years=(2024,))))
    assert [r["month_name"] for r in filtered] == ["dic"]


def test_rankings_break_ties_by_name_and_put_null_totals_last(make_ops):
    ops = make_ops(
        {"client_name": "b", "product": "z"}, {"client_name": "a", "product": "y"},
        {"client_name": "c", "commission": None},
    )
    assert [r["client_name"] for r in rows(performance.top_clients(ops))] == ["a", "b", "c"]
    assert [r["product"] for r in rows(performance.top_products(ops, n=2))] == ["y", "z"]


def test_churn_starts_after_the_limit(make_ops):
    day = dt.timedelta(days=1)
    ops = make_ops(
        {"client_name": "sixty", "registered_on": AS_OF - 60 * day},
        {"client_name": "later", "registered_on": AS_OF - 61 * day},
        {"client_name": "never", "registered_on": None},
        {"client_name": "active", "registered_on": AS_OF - 90 * day},
        {"client_name": "active", "registered_on": AS_OF - day},
    )
    found = rows(strategy.churn_risk(ops, as_of=AS_OF))
    assert [(r["client_name"], r["days_inactive"]) for r in found] == [("later", 61)]
    assert rows(strategy.churn_at_risk(ops, as_of=AS_OF)) == [
        {"clients_at_risk": 1, "commission_at_risk": 10.0}
    ]


@pytest.mark.parametrize("leading, tile_items", [(2, 2), (3, 1), (64, 2048)])
def test_cross_sell(make_ops, leading, tile_items):
    sizes = {"leading": leading, "tile_items": tile_items}
    baskets = {"b1": "xyzw", "b2": "xyzw", "b3": "xyz", "b4": "yx", "b5": "q"}
    ops = make_ops(
        *[{"buyer_id": b, "product": p} for b, items in baskets.items() for p in items * 2],
        {"buyer_id": None, "product": "x"}, {"buyer_id": "b6", "product": None},
    )
    pairs = [
        (r["product_a"], r["product_b"], r["shared_buyers"], r["market_penetration"])
        for r in rows(strategy.cross_sell(ops, **sizes))
    ]
    expected = [("x", "y", 4, 66.67), ("x", "z", 3, 50.0), ("y", "z", 3, 50.0)]
    assert pairs == expected
    assert [r["product_b"] for r in rows(strategy.cross_sell(ops, n=1, **sizes))] == ["y"]
    assert len(rows(strategy.cross_sell(ops, min_shared=2, n=None, **sizes))) == 6


def test_segments(make_ops):
    ops = make_ops(
        *[{"client_name": f"c{i}", "commission": float(i)} for i in range(1, 11)],
        {"client_name": "none", "commission": None},
    )
    found = {r["segment"]: r for r in rows(strategy.client_segments(ops))}
    counts = {name: r["client_count"] for name, r in found.items()}
    assert counts == {"VIP": 2, "High": 3, "Medium": 3, "Low": 3}
    assert found["Low"]["segment_commission"] == 3.0
    share = rows(strategy.vip_share(ops))[0]
    assert share["vip_commission"] == 19.0
    assert share["vip_percentage"] == pytest.approx(19 / 55 * 100)
    spanish = {r["segment"] for r in rows(strategy.client_segments(ops, labels=SPANISH))}
    assert spanish == set(SPANISH.segments)
    nothing = make_ops({"commission": 0.0})
    assert rows(strategy.vip_share(nothing))[0]["vip_percentage"] == 0.0


def test_principal(make_ops):
    ops = make_ops(
        {"commission": 30.0}, {"principal": "C"}, {"principal": "X"}, {"principal": None}
    )
    found = [(r["principal_type"], r["transactions"]) for r in rows(network.principal_split(ops))]
    assert found == [("seller_pays", 1), ("buyer_pays", 1), ("unknown", 1)]
    share = rows(network.principal_share(ops))[0]
    assert (share["seller_percentage"], share["buyer_percentage"]) == (75.0, 25.0)


def test_hubs_count_distinct_partners(make_ops):
    ops = make_ops(
        {"buyer_id": "B1"}, {"buyer_id": "B1"}, {"buyer_id": "B2"},
        {"seller_name": "small"}, {"buyer_id": None}, {"seller_name": None},
    )
    assert [(r["seller"], r["unique_buyers"]) for r in rows(network.seller_hubs(ops))] == [
        ("seller", 2)
    ]
    assert rows(network.buyer_hubs(ops)) == []


def test_prospects_ignore_the_filter_in_sums_and_lose_clients_after_the_limit(make_ops):
    def deal(buyer, **more):
        return {"buyer_id": buyer, "buyer_name": buyer, **more}

    ops = make_ops(
        deal("B1", client_id="S1", client_name="S1"),
        deal("B1", year=2024, client_id=None, principal=None, business_value=900.0),
        deal("B2", client_id="B1", client_name="B1"),
        deal("B2", seller_id="S2", client_id="S2"),
        deal("B3", seller_id="S3", principal="C"),
    )
    found = rows(network.potential_buyers(ops, OpsFilter(years=(2025,))))
    assert [(r["prospect_id"], r["connections"], r["total_volume"]) for r in found] == [
        ("B2", 2, 200.0)
    ]
    assert rows(network.potential_buyers(ops, OpsFilter(years=(2023,)))) == []
    everyone = rows(network.potential_buyers(ops.where("client_id is null or client_id <> 'B1'")))
    assert {r["prospect_id"]: r["total_volume"] for r in everyone} == {"B1": 1000.0, "B2": 100.0}
    # the limit comes first: B1 takes the only place and is then removed
    first = network.potential_buyers(ops.where("buyer_id <> 'B2' or client_id = 'B1'"), n=1)
    assert rows(first) == []
    both = rows(network.priority_prospects(ops))
    assert {r["side"] for r in both} == {"buyer", "seller"}
    summary = {r["side"]: r["prospects"] for r in rows(network.prospect_opportunity(ops))}
    assert summary["buyer"] == len(rows(network.potential_buyers(ops)))
    best = rows(network.best_prospect(network.potential_buyers(ops)))
    assert best == rows(network.potential_buyers(ops))[:1]


def test_relationships(make_ops):
    def pair(seller, payers):
        return [{"seller_name": seller, "principal": p} for p in payers]

    ops = make_ops(
        *pair("never", [None] * 3), *pair("both", ["V", "C", "C"]), *pair("one", ["V"] * 3),
        *pair("few", ["V"] * 2),
    )
    kinds = {r["seller"]: r["relationship_type"] for r in rows(network.relationships(ops))}
    assert kinds == {"never": "buyer_pays", "both": "mutual", "one": "seller_pays"}
    assert rows(network.relationship_summary(ops)) == [
        {
            "total_relationships": 3,
            "mutual_relationships": 1,
            "one_sided_relationships": 2,
            "total_commission": 90.0,
        }
    ]


def test_pairs_that_read_the_same_count_once(make_ops):
    ops = make_ops(
        {"seller_name": "a", "buyer_name": "b-c"}, {"seller_name": "a-b", "buyer_name": "c"}
    )
    found = rows(network.network_metrics(ops))[0]
    assert (found["unique_sellers"], found["unique_relationships"]) == (2, 1)
    assert found["avg_transactions_per_relationship"] == 1.0


def test_graph(make_ops):
    def trade(seller, buyer, commission):
        return {"seller_name": seller, "buyer_name": buyer, "commission": commission}

    ops = make_ops(
        trade("s", "x", 40.0), trade("s", "y", 10.0), trade("s", "y", 10.0),
        trade("t", "y", 10.0), trade("t", "z", 1.0), trade(None, "z", 99.0),
    )
    assert len(rows(graph.network_edges(ops, n=3))) == 3
    edges = graph.network_edges(ops, n=None)
    nodes = {r["node_id"]: r for r in rows(graph.network_nodes(edges))}
    assert nodes["S:s"]["commission"] == 60.0 and nodes["S:s"]["commission_share"] == 1.0
    assert nodes["B:y"]["degree_share"] == 1.0 and nodes["B:x"]["degree_share"] == 0.5
    assert (nodes["B:y"]["node_type"], nodes["B:y"]["node_name"]) == ("buyer", "y")
    scaled = {(r["seller"], r["buyer"]): r for r in rows(graph.edge_scaling(edges))}
    assert scaled["s", "y"]["weight_share"] == 1.0
    assert scaled["s", "y"]["commission_share"] == 0.5
    assert rows(graph.network_size(edges)) == [{"nodes": 5, "sellers": 2, "buyers": 3}]
    assert rows(graph.most_connected(edges))[0]["node_id"] == "B:y"
    health = rows(graph.network_health(edges))[0]
    assert health["density"] == pytest.approx(0.4)
    assert health["avg_transactions_per_pair"] == 1.25
    hubs = [r["node_id"] for r in rows(graph.top_network_hubs(edges, n=3))]
    assert hubs == ["S:s", "B:y", "S:t"]
    assert rows(graph.bridge_node(edges))[0]["node_id"] == "B:y"
    assert rows(graph.bridge_node(graph.network_edges(ops, n=1))) == []


def test_client(make_ops):
    ops = make_ops(
        {"business_value": 100.0, "commission": 5.0},
        {"principal": "C", "year": 2024, "seller_name": "t", "business_value": 300.0},
        {"client_id": "C2", "commission": 20.0},
        {"client_id": "C2", "product": "rice"},
        {"client_id": None},
    )
    assert [r["client_id"] for r in rows(client.client_list(ops))] == ["C1", "C2"]
    stats = rows(client.client_stats(ops, "C1"))[0]
    assert (stats["total_transactions"], stats["total_volume"]) == (2, 400.0)
    assert (stats["unique_buyers"], stats["unique_sellers"]) == (1, 1)
    market = rows(client.market_comparison(ops, "C1", own_transactions=True))
    assert len(market) == 1
    assert market[0]["client_transactions"] == 4
    assert market[0]["client_only_transactions"] == 2
    assert market[0]["vs_market"] == "below_market"
    unpriced = make_ops({"business_value": 0.0}, {"client_id": "C2"})
    assert rows(client.market_comparison(unpriced, "C1"))[0]["vs_market"] == "at_market"
    assert rows(client.client_trend(ops, "C1"))[0]["transactions"] == 2
    assert [r["partner"] for r in rows(client.client_top_buyers(ops, "C1"))] == ["buyer"]
    assert [r["partner"] for r in rows(client.client_top_suppliers(ops, "C1"))] == ["t"]
    assert [r["year"] for r in rows(client.client_costs(ops, "C1"))] == [2025, 2024]
    benefit = rows(client.client_tax_benefit(ops, "C1"))[0]
    assert (benefit["estimated_tax_benefit"], benefit["net_benefit"]) == (60.0, 45.0)
    assert benefit["roi_percentage"] == 300.0
    assert rows(client.client_tax_benefit(ops, "nobody"))[0]["roi_percentage"] is None


def test_operations(make_ops):
    ops = make_ops(
        {"registered_on": dt.date(2025, 1, 5)}, {}, {"registered_on": None},
        {"operation_type": "REX", "buyer_city": None},
    )
    days = [r["day_of_week"] for r in rows(operations.by_weekday(ops))]
    assert days == ["Monday", "Sunday", None]
    spanish = [r["day_of_week"] for r in rows(operations.weekday_labels(operations.by_weekday(ops)))]
    assert spanish == ["Lunes", "Domingo", None]
    types = [(r["operation_type"], r["operations"]) for r in rows(operations.by_operation_type(ops))]
    assert types == [("RSG", 3), ("REX", 1)]
    assert rows(operations.buyer_cities(ops)) == [
        {"city": "Cali", "operations": 3, "commission": 30.0}
    ]
    assert rows(operations.seller_cities(ops))[0]["operations"] == 4


@pytest.mark.parametrize("clients, first, share", [(7, 1, 25.0), (4, 0, 0.0)])
def test_pareto(make_ops, clients, first, share):
    ops = make_ops(*[{"client_name": f"c{i}", "commission": float(i)} for i in range(1, clients + 1)])
    listed = rows(risk.pareto(ops))
    assert listed[-1]["cumulative_pct"] == 100.0
    assert listed[1]["cumulative_commission"] == clients * 2 - 1
    assert rows(risk.concentration(ops)) == [
        {"top_clients": first, "top_percentage": share, "high_risk": False}
    ]
    assert rows(risk.pareto(ops, n=2))[-1]["cumulative_pct"] == 100.0


def test_concentration_of_one_large_client(make_ops):
    ops = make_ops(
        {"client_name": "big", "commission": 1000.0},
        *[{"client_name": f"c{i}", "commission": 1.0} for i in range(4)],
    )
    assert rows(risk.concentration(ops))[0]["high_risk"] is True


def test_anomalies_are_strictly_below(make_ops):
    def sale(name, commission, product="maize"):
        return {"operation_id": name, "commission": commission, "product": product}

    # mean rate 10: 7 is exactly at the limit
    ops = make_ops(
        sale("limit", 7.0), sale("low", 6.0), sale("high", 17.0), sale("free", 0.0, "gift")
    )
    found = rows(risk.pricing_anomalies(ops))
    assert [(r["operation_id"], r["discount_pct"]) for r in found] == [("low", 40.0)]
    assert rows(risk.anomaly_count(ops)) == [{"anomalies": 1}]


def test_sizes(make_ops):
    values = [999_999.0, 1e6, 1e7, 5e7, None]
    ops = make_ops(*[{"business_value": v} for v in values])
    found = [(r["size_band"], r["transaction_count"]) for r in rows(risk.size_distribution(ops))]
    assert found == [("Small", 1), ("Medium", 1), ("Large", 1), ("Very large", 2)]
    few = rows(risk.size_distribution(make_ops({}), labels=SPANISH))
    assert [r["size_band"] for r in few] == [SPANISH.bands[0]]


def test_running_totals_agree_with_the_totals_for_any_value(make_ops):
    def listed(*values):
        ops = make_ops(*[{"client_name": f"c{i}", "commission": v} for i, v in enumerate(values)])
        rows = risk.pareto(ops).collect()
        tops = {r.client_name: r.commission for r in performance.top_clients(ops).collect()}
        assert all(repr(r.commission) == repr(tops[r.client_name]) for r in rows)
        assert strategy.client_segments(ops).count() > 0
        return [r.cumulative_commission for r in rows]

    assert listed(1e300, 2.5) == [1e300, 1e300]
    assert listed(float("inf"), 1.0) == [float("inf"), float("inf")]
    assert [repr(v) for v in listed(float("nan"), 1.0)] == ["nan", "nan"]


def test_operations_are_not_shuffled_for_their_products_rate(make_ops):
    ops = make_ops({"product": "a"}, {"product": "b", "commission": 1.0}, {"product": "b"})
    plan = risk.pricing_anomalies(ops)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_dates_that_are_text(make_ops):
    day = dt.timedelta(days=1)
    ops = make_ops(
        {"client_name": "old", "registered_on": AS_OF - 90 * day},
        {"client_name": "bad", "registered_on": AS_OF - 90 * day},
    )
    bad = F.when(F.col("client_name") == "bad", "31/31/2025")
    ops = ops.withColumn("registered_on", bad.otherwise(F.col("registered_on").cast("string")))
    assert [r.client_name for r in strategy.churn_risk(ops, as_of=AS_OF).collect()] == ["old"]
    assert [r.operations for r in operations.by_weekday(ops).collect()] == [1, 1]


def test_distinct_counts_copy_no_rows(make_ops):
    ops = make_ops({"seller_name": "a"}, {"seller_name": "a", "buyer_name": "z"}, {"seller_name": "c-d", "buyer_name": None})
    edges = graph.network_edges(ops, n=None)
    for df in (network.network_metrics(ops), graph.network_size(edges), graph.network_health(edges)):
        assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()
    assert network.network_metrics(ops).first().asDict() == {
        "unique_sellers": 1, "unique_buyers": 2, "unique_relationships": 2, "avg_transactions_per_relationship": 1.0
    }
    assert tuple(graph.network_size(edges).first()) == (3, 1, 2)
