"""The registered queries as plain SQL over the driver's tables."""

from __future__ import annotations

from collections.abc import Iterable

OPERATIONS = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS operation_id,
       CASE WHEN p = 'V' THEN concat('S', s_suppkey) WHEN p = 'C' THEN concat('B', c_custkey) END AS client_id,
       CASE WHEN p = 'V' THEN s_name WHEN p = 'C' THEN c_name END AS client_name,
       concat('B', c_custkey) AS buyer_id, c_name AS buyer_name, b_city AS buyer_city,
       concat('S', s_suppkey) AS seller_id, s_name AS seller_name, s_city AS seller_city,
       p_name AS product,
       l_extendedprice * 1000 AS business_value,
       l_extendedprice * 1000 * l_discount AS commission,
       o_orderkey % 20 AS referrer,
       l_tax * 100 AS pct_ref_sale, CAST(l_linenumber AS DOUBLE) AS pct_ref_purchase,
       p AS principal,
       CASE l_returnflag WHEN 'N' THEN 'RSG' WHEN 'R' THEN 'REX' ELSE 'RGC' END AS operation_type,
       substring('enefebmarabrmayjunjulagosepoctnovdic', CAST(month(o_orderdate) * 3 - 2 AS INT), 3) AS month_name,
       CAST(year(o_orderdate) AS INT) AS year,
       CAST(o_orderdate AS DATE) AS registered_on
FROM (SELECT l.*, o.*, c.*, s.*, pt.p_name, bn.n_name AS b_city, sn.n_name AS s_city,
             CASE WHEN l_linestatus = 'O' AND s_suppkey % 5 <> 0 THEN 'V'
                  WHEN l_linestatus = 'F' AND c_custkey % 3 = 0 THEN 'C'
                  WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'X' END AS p
      FROM lineitem l
      JOIN orders o ON l_orderkey = o_orderkey
      JOIN customer c ON o_custkey = c_custkey
      JOIN supplier s ON l_suppkey = s_suppkey
      JOIN part pt ON l_partkey = p_partkey
      JOIN nation bn ON c_nationkey = bn.n_nationkey
      JOIN nation sn ON s_nationkey = sn.n_nationkey) j
"""

FILTER = """WHERE month_name IN ('ene', 'feb', 'mar') AND year IN (1996, 1997)
AND operation_type IN ('RSG', 'REX')"""

COLUMNS = """operation_id, client_id, client_name, buyer_id, buyer_name, buyer_city, seller_id,
seller_name, seller_city, product, business_value, commission, referrer, pct_ref_sale,
pct_ref_purchase, principal, operation_type, month_name, year, registered_on"""

MONTH_RANK = """CASE WHEN month_name LIKE 'ene%' THEN 1 WHEN month_name LIKE 'feb%' THEN 2
WHEN month_name LIKE 'mar%' THEN 3 WHEN month_name LIKE 'abr%' THEN 4
WHEN month_name LIKE 'may%' THEN 5 WHEN month_name LIKE 'jun%' THEN 6
WHEN month_name LIKE 'jul%' THEN 7 WHEN month_name LIKE 'ago%' THEN 8
WHEN month_name LIKE 'sep%' THEN 9 WHEN month_name LIKE 'oct%' THEN 10
WHEN month_name LIKE 'nov%' THEN 11 WHEN month_name LIKE 'dic%' THEN 12 ELSE 0 END"""


def exact(x: str, window: str = "") -> str:
    """Sum of whole parts and of fractions to twelve decimals."""
    return f"""(SUM(CAST(TRUNC({x}) AS DECIMAL(38,0))) {window}
+ SUM(CAST({x} - TRUNC({x}) AS DECIMAL(28,12))) {window})"""


def total(x: str, window: str = "") -> str:
    """That sum as a double, with what the rows have beyond twelve decimals."""
    fraction = f"({x} - TRUNC({x}))"
    return f"""(CAST({exact(x, window)} AS DOUBLE)
+ SUM({fraction} - CAST(CAST({fraction} AS DECIMAL(28,12)) AS DOUBLE)) {window})"""


def mean(x: str) -> str:
    return f"{total(x)} / COUNT({x})"


RATIO = "(commission / NULLIF(business_value, 0))"


def mean_rate(ratio: str = RATIO) -> str:
    return f"{mean(ratio)} * 100"


COMMISSION, VALUE, RATE = total("commission"), total("business_value"), mean_rate()
MEAN_COMMISSION = mean("commission")


def top_by_commission(key: str) -> str:
    return f"""SELECT {key}, {COMMISSION} AS commission, COUNT(*) AS transactions,
{VALUE} AS volume, {RATE} AS avg_commission_rate
FROM f GROUP BY {key} ORDER BY commission DESC NULLS LAST, {key} NULLS LAST LIMIT 10"""


REFERRERS = f"""SELECT referrer, COUNT(*) AS total_operations, {COMMISSION} AS total_commission,
{VALUE} AS total_volume, {MEAN_COMMISSION} AS avg_commission_per_op,
{total("commission * (pct_ref_sale / 100.0)")}
+ {total("commission * (pct_ref_purchase / 100.0)")} AS referrer_earnings
FROM f WHERE referrer IS NOT NULL AND referrer <> 0 GROUP BY referrer
ORDER BY total_commission DESC NULLS LAST, referrer"""

CHURN = f"""SELECT client_name, MAX(registered_on) AS last_transaction,
DATE_DIFF('day', MAX(registered_on), DATE '2001-08-02') AS days_inactive,
{COMMISSION} AS lifetime_commission, COUNT(*) AS total_transactions
FROM f GROUP BY client_name
HAVING DATE_DIFF('day', MAX(registered_on), DATE '2001-08-02') > 60
ORDER BY lifetime_commission DESC NULLS LAST, client_name NULLS LAST LIMIT 15"""

CROSS_SELL = """SELECT p1.product AS product_a, p2.product AS product_b,
COUNT(DISTINCT p1.buyer_id) AS shared_buyers,
ROUND(COUNT(DISTINCT p1.buyer_id) * CAST(100 AS DOUBLE)
      / (SELECT COUNT(DISTINCT buyer_id) FROM f), 2) AS market_penetration
FROM (SELECT DISTINCT buyer_id, product FROM f) p1
JOIN (SELECT DISTINCT buyer_id, product FROM f) p2
  ON p1.buyer_id = p2.buyer_id AND p1.product < p2.product
GROUP BY p1.product, p2.product HAVING COUNT(DISTINCT p1.buyer_id) >= 3
ORDER BY shared_buyers DESC, product_a, product_b"""

SEGMENTS = f"""SELECT segment, COUNT(*) AS client_count, {total("t")} AS segment_commission,
AVG(n) AS avg_transactions, {mean("mean_commission")} AS avg_commission_per_deal
FROM (SELECT *, CASE WHEN t >= p80 THEN 'VIP' WHEN t >= p50 THEN 'High'
                     WHEN t >= p20 THEN 'Medium' ELSE 'Low' END AS segment
      FROM (SELECT client_name, {COMMISSION} AS t, COUNT(*) AS n,
            {MEAN_COMMISSION} AS mean_commission FROM f GROUP BY client_name) c,
           (SELECT PERCENTILE_CONT(0.8) WITHIN GROUP (ORDER BY t) AS p80,
                   PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY t) AS p50,
                   PERCENTILE_CONT(0.2) WITHIN GROUP (ORDER BY t) AS p20
            FROM (SELECT {COMMISSION} AS t FROM f GROUP BY client_name) v) q) s
GROUP BY segment"""


def hubs(name: str, label: str, partner: str, partners: str) -> str:
    return f"""SELECT {name} AS {label}, COUNT(DISTINCT {partner}) AS {partners},
{COMMISSION} AS total_commission, COUNT(*) AS total_transactions, {VALUE} AS total_volume
FROM f WHERE {name} IS NOT NULL AND {partner} IS NOT NULL GROUP BY {name}
HAVING COUNT(DISTINCT {partner}) >= 2
ORDER BY {partners} DESC, total_commission DESC NULLS LAST, {label} LIMIT 10"""


PRINCIPALS = f"""SELECT CASE WHEN principal = 'V' THEN 'seller_pays'
WHEN principal = 'C' THEN 'buyer_pays' ELSE 'unknown' END AS principal_type,
COUNT(*) AS transactions, {COMMISSION} AS total_commission,
{MEAN_COMMISSION} AS avg_commission, {VALUE} AS total_volume, {RATE} AS avg_commission_rate
FROM f WHERE principal IS NOT NULL GROUP BY 1"""

CLIENTS = """SELECT DISTINCT client_id, client_name FROM f
WHERE client_id IS NOT NULL AND client_name IS NOT NULL"""


def prospects(side: str, partner: str, payer: str) -> str:
    return f"""SELECT * FROM (
SELECT *, ROUND(total_volume * (avg_commission_rate / 100), 0) AS commission_opportunity
FROM (SELECT {side}_id AS prospect_id, {side}_name AS prospect_name,
      COUNT(DISTINCT {partner}_id) AS connections, {VALUE} AS total_volume,
      COUNT(*) AS total_transactions, {RATE} AS avg_commission_rate
      FROM ops
      WHERE {partner}_id IN (SELECT {partner}_id FROM f WHERE principal = '{payer}')
      AND {side}_id IS NOT NULL AND {side}_name IS NOT NULL
      GROUP BY {side}_id, {side}_name)
ORDER BY connections DESC, total_volume DESC NULLS LAST, prospect_id, prospect_name LIMIT 20)
WHERE prospect_id NOT IN (SELECT client_id FROM f WHERE client_id IS NOT NULL AND client_name IS NOT NULL)"""


BUYERS, SELLERS = prospects("buyer", "seller", "V"), prospects("seller", "buyer", "C")
BOTH_SIDES = f"""SELECT *, 'buyer' AS side FROM ({BUYERS})
UNION ALL SELECT *, 'seller' AS side FROM ({SELLERS})"""
BEST = "ORDER BY connections DESC, total_volume DESC NULLS LAST, prospect_id, prospect_name LIMIT 1"

PAIRED = "FROM f WHERE seller_name IS NOT NULL AND buyer_name IS NOT NULL"
PAIRS = f"""SELECT seller_name AS seller, buyer_name AS buyer, COUNT(*) AS transactions,
{COMMISSION} AS total_commission, {VALUE} AS total_volume,
COUNT(CASE WHEN principal = 'V' THEN 1 END) AS seller_paid,
COUNT(CASE WHEN principal = 'C' THEN 1 END) AS buyer_paid
{PAIRED} GROUP BY seller_name, buyer_name HAVING COUNT(*) >= 3
ORDER BY total_commission DESC NULLS LAST, seller, buyer LIMIT 20"""
TYPED_PAIRS = f"""SELECT *, CASE WHEN seller_paid > 0 AND buyer_paid > 0 THEN 'mutual'
WHEN seller_paid > 0 THEN 'seller_pays' ELSE 'buyer_pays' END AS relationship_type
FROM ({PAIRS})"""

ALL_EDGES = f"""SELECT seller_name AS seller, buyer_name AS buyer, COUNT(*) AS transactions,
{COMMISSION} AS commission {PAIRED} GROUP BY seller_name, buyer_name"""
EDGES = f"{ALL_EDGES} ORDER BY commission DESC NULLS LAST, seller, buyer LIMIT 30"


def node_parts(node: str = "node_id") -> str:
    return f"""{node} AS node_id,
CASE WHEN {node} LIKE 'S:%' THEN 'seller' ELSE 'buyer' END AS node_type,
substring({node}, 3) AS node_name"""


def graph_queries(edges: str) -> dict[str, str]:
    nodes = f"""SELECT {node_parts()}, {total("commission")} AS commission, COUNT(*) AS degree
FROM (SELECT 'S:' || seller AS node_id, commission FROM ({edges}) a
      UNION ALL SELECT 'B:' || buyer AS node_id, commission FROM ({edges}) b) ends
GROUP BY ends.node_id"""
    links = f"""SELECT 'S:' || seller AS u, 'B:' || buyer AS v FROM ({edges}) a
UNION ALL SELECT 'B:' || buyer AS u, 'S:' || seller AS v FROM ({edges}) b"""
    # a walk as long as the distance is a shortest path, so counting walks counts paths
    scores = f"""
(WITH RECURSIVE arcs AS ({links}), nodes AS (SELECT DISTINCT u AS node FROM arcs),
walks(s, v, len, walks) AS (
  SELECT node, node, 0, CAST(1 AS DOUBLE) FROM nodes
  UNION ALL
  SELECT w.s, a.v, w.len + 1, SUM(w.walks) FROM walks w JOIN arcs a ON w.v = a.u
  WHERE w.len < (SELECT COUNT(*) FROM nodes) GROUP BY w.s, a.v, w.len + 1),
paths AS (SELECT s, v, MIN(len) AS dist, ARG_MIN(walks, len) AS n FROM walks GROUP BY s, v),
shares AS (SELECT sv.v AS node, SUM(sv.n * vt.n / st.n) AS share
  FROM paths sv JOIN paths vt ON sv.v = vt.s
  JOIN paths st ON st.s = sv.s AND st.v = vt.v AND st.dist = sv.dist + vt.dist
  WHERE sv.s <> sv.v AND vt.s <> vt.v AND st.s <> st.v GROUP BY sv.v)
SELECT nodes.node AS id, ROUND(COALESCE(share, 0)
  / (((SELECT COUNT(*) FROM nodes) - 1) * ((SELECT COUNT(*) FROM nodes) - 2)), 10) AS betweenness
FROM nodes LEFT JOIN shares ON nodes.node = shares.node) scored"""
    bridges = f"SELECT {node_parts('id')}, betweenness FROM {scores}"
    return {
        "q26_network_edges": edges,
        "q27_network_nodes": f"""SELECT *,
CASE WHEN MAX(commission) OVER () > 0 THEN commission / MAX(commission) OVER () ELSE 0.5 END AS commission_share,
CASE WHEN MAX(degree) OVER () > 0 THEN degree / MAX(degree) OVER () ELSE 0.5 END AS degree_share
FROM ({nodes})""",
        "q28_edge_scaling": f"""SELECT seller, buyer,
transactions / MAX(transactions) OVER () AS weight_share,
commission / MAX(commission) OVER () AS commission_share FROM ({edges})""",
        "q29_network_size": f"""SELECT COUNT(DISTINCT seller) + COUNT(DISTINCT buyer) AS nodes,
COUNT(DISTINCT seller) AS sellers, COUNT(DISTINCT buyer) AS buyers FROM ({edges})""",
        "q30_most_connected": f"""SELECT node_id, node_type, node_name, degree FROM ({nodes})
ORDER BY degree DESC, node_id LIMIT 1""",
        "q31_network_health": f"""SELECT 2 * e / (n * (n - 1)) AS density, total_commission,
avg_transactions_per_pair
FROM (SELECT COUNT(*) AS e, COUNT(DISTINCT seller) + COUNT(DISTINCT buyer) AS n,
      COALESCE({total("commission")}, 0) AS total_commission,
      AVG(transactions) AS avg_transactions_per_pair FROM ({edges}))""",
        "q32_betweenness": bridges,
        "q32_bridge_node": f"{bridges} ORDER BY betweenness DESC, node_id LIMIT 1",
        "q33_top_network_hubs": f"""SELECT node_id, node_type, node_name, degree, commission
FROM ({nodes}) ORDER BY degree DESC, commission DESC NULLS LAST, node_id LIMIT 10""",
    }


FIRST_CLIENT = "(SELECT MIN(client_id) FROM ops)"
FIRST_SELLER_CLIENT = "(SELECT MIN(client_id) FROM ops WHERE principal = 'V')"
OWN = f"client_id = {FIRST_CLIENT}"


def market_comparison(extra: str) -> str:
    """Of the first client that trades under the filter."""
    return f"""SELECT *, CASE WHEN client_rate < market_avg_rate THEN 'below_market'
WHEN client_rate > market_avg_rate THEN 'above_market' ELSE 'at_market' END AS vs_market
FROM (SELECT product, COUNT(*) AS client_transactions,
      {mean_rate(f"(CASE WHEN own THEN {RATIO} END)")} AS client_rate,
      {RATE} AS market_avg_rate,
      {total("CASE WHEN own THEN business_value ELSE 0 END")} AS client_volume {extra}
      FROM (SELECT *, client_id = (SELECT MIN(client_id) FROM f) AS own FROM f) GROUP BY product
      HAVING COUNT(CASE WHEN own THEN 1 END) > 0
      ORDER BY client_volume DESC NULLS LAST, product NULLS LAST LIMIT 10)"""


def partners(name: str, payer: str, client: str) -> str:
    return f"""SELECT {name} AS partner, COUNT(*) AS transactions, {VALUE} AS total_volume,
MAX(registered_on) AS last_transaction
FROM ops WHERE client_id = {client} AND principal = '{payer}' GROUP BY {name}
ORDER BY total_volume DESC NULLS LAST, partner NULLS LAST LIMIT 10"""


def weekdays(monday_to_sunday: str) -> str:
    names = " ".join(
        f"WHEN {i} THEN '{name}'" for i, name in enumerate(monday_to_sunday.split(), 1)
    )
    return f"""SELECT CAST(day AS INT) AS day_number, CASE day {names} END AS day_of_week,
operations, commission, avg_commission
FROM (SELECT isodow(registered_on) AS day, COUNT(*) AS operations,
      {COMMISSION} AS commission, {MEAN_COMMISSION} AS avg_commission FROM f GROUP BY 1)"""


def cities(column: str) -> str:
    return f"""SELECT {column} AS city, COUNT(*) AS operations, {COMMISSION} AS commission
FROM f WHERE {column} IS NOT NULL GROUP BY {column}
ORDER BY commission DESC NULLS LAST, city LIMIT 10"""


LISTED = f"""SELECT client_name, {COMMISSION} AS commission FROM f GROUP BY client_name
ORDER BY commission DESC NULLS LAST, client_name NULLS LAST LIMIT 50"""
IN_ORDER = "ORDER BY commission DESC NULLS LAST, client_name NULLS LAST"
SO_FAR = f"OVER ({IN_ORDER} ROWS UNBOUNDED PRECEDING)"

ANOMALIES = f"""SELECT operation_id, client_name, product, business_value AS transaction_value,
{RATIO} * 100 AS actual_rate, market_avg_rate,
ROUND((market_avg_rate - {RATIO} * 100) / market_avg_rate * 100, 1) AS discount_pct
FROM f JOIN (SELECT product AS known, {RATE} AS market_avg_rate FROM f GROUP BY product) m
  ON product = known
WHERE market_avg_rate > 0 AND {RATIO} * 100 < market_avg_rate * CAST(0.7 AS DOUBLE)
ORDER BY discount_pct DESC, operation_id NULLS LAST, product, client_name NULLS LAST,
transaction_value NULLS LAST, actual_rate LIMIT 20"""

BATCH = """(SELECT operation_id, client_name, commission * 2 AS commission, operation_type,
registered_on FROM ops WHERE operation_type = 'REX'
UNION ALL SELECT 'N-' || operation_id, client_name, commission * 2, operation_type,
registered_on FROM ops WHERE operation_type = 'RSG')"""

UPSERTED = f"""SELECT {COLUMNS} FROM ops
WHERE NOT EXISTS (SELECT 1 FROM {BATCH} b WHERE b.operation_id = ops.operation_id)
UNION ALL BY NAME
SELECT operation_id, client_name, commission, operation_type, registered_on FROM {BATCH} n"""

SUMMARY = f"""SELECT (SELECT COUNT(*) FROM {BATCH} a) AS incoming_rows,
(SELECT COUNT(*) FROM ops WHERE operation_id IN (SELECT operation_id FROM {BATCH} b)) AS replaced_rows,
(SELECT COUNT(*) FROM {BATCH} c
 WHERE operation_id NOT IN (SELECT operation_id FROM ops)) AS inserted_rows"""

EVERYTHING = f"SELECT {COLUMNS} FROM ops"

_SENT = ("operation_id", "client_name", "commission", "operation_type", "registered_on")
_REPORTED = [f"SELECT '{c}' AS \"column\", 'matched' AS status, COUNT({c}) AS held FROM {BATCH} b" for c in _SENT]
_REPORTED.append(f"SELECT 'note', 'extra', COUNT(*) FROM {BATCH} b")
_REPORTED += [f"SELECT '{c.strip()}', 'missing', 0" for c in COLUMNS.split(",") if c.strip() not in _SENT]
SCHEMA_REPORT = " UNION ALL ".join(_REPORTED)

# Bodies that read ``ops``, the whole table, and ``f``, the table under the filter if any.
BODIES = {
    "s01_csv_round_trip": f"SELECT {COLUMNS} FROM (SELECT * REPLACE ('Ñ ' || buyer_city AS buyer_city) FROM ops)",
    "s01_quoted_breaks": f"""SELECT {COLUMNS} FROM (SELECT * REPLACE (
CASE WHEN referrer % 5 = 0 THEN buyer_name || chr(10) || '"two", ' || buyer_id || chr(10) || chr(10) || 'lines;'
ELSE buyer_name END AS buyer_name,
CASE WHEN referrer = 7 THEN '5" ' || seller_city ELSE seller_city END AS seller_city) FROM ops)""",
    "s01_decimal_commas": """SELECT operation_id, ROUND(business_value, 2) AS business_value,
ROUND(commission, 2) AS commission FROM ops""",
    "s05_create_operations": EVERYTHING,
    "s07_schema_report": SCHEMA_REPORT,
    "s09_coerce_dates": """SELECT operation_id,
CASE WHEN operation_type IN ('RSG', 'REX') THEN registered_on END AS registered_on FROM ops""",
    "s10_upsert": UPSERTED,
    "s11_published_upsert": UPSERTED,
    "s11_published_whole": UPSERTED,
    "s12_upsert_summary": SUMMARY,
    "s12_stored_upsert_summary": SUMMARY,
    "s13_preview": f"SELECT {COLUMNS} FROM ops ORDER BY operation_id LIMIT 5",
    "s14_template": EVERYTHING,
    "s15_snapshot": EVERYTHING,
    "f03_list_months": "SELECT DISTINCT month_name FROM f WHERE month_name IS NOT NULL",
    "f04_list_years": "SELECT DISTINCT year FROM f WHERE year IS NOT NULL",
    "f05_list_operation_types": """SELECT DISTINCT operation_type FROM f
WHERE operation_type IS NOT NULL""",
    "f06_month_rank": f"""SELECT month_name, {MONTH_RANK} AS rank, COUNT(*) AS operations
FROM f GROUP BY month_name""",
    "q00_total_records": "SELECT COUNT(*) AS total_records FROM f",
    "q01_overview": f"""SELECT COUNT(DISTINCT client_name) AS unique_clients,
COUNT(DISTINCT product) AS unique_products, {VALUE} AS total_volume,
{COMMISSION} AS total_commission, COUNT(*) AS total_operations, {RATE} AS avg_commission_rate
FROM f""",
    "q02_monthly_trend": f"""SELECT month_name, {COMMISSION} AS commission, {VALUE} AS volume,
COUNT(*) AS operations FROM f GROUP BY month_name""",
    "q03_top_clients": top_by_commission("client_name"),
    "q04_referrers": REFERRERS,
    "q05_top_referrers": f"{REFERRERS} LIMIT 10",
    "q06_referrer_summary": f"""SELECT COUNT(*) AS total_referrers,
COALESCE({total("total_commission")}, 0) AS total_commission,
COALESCE({total("referrer_earnings")}, 0) AS total_earnings
FROM ({REFERRERS})""",
    "q07_top_products": top_by_commission("product"),
    "q08_churn_risk": CHURN,
    "q09_churn_at_risk": f"""SELECT COUNT(*) AS clients_at_risk,
COALESCE({total("lifetime_commission")}, 0) AS commission_at_risk FROM ({CHURN})""",
    "q10_cross_sell": f"{CROSS_SELL} LIMIT 10",
    "q10_cross_sell_all_pairs": CROSS_SELL,
    "q10_cross_sell_tiles": f"{CROSS_SELL} LIMIT 40",
    "q11_client_segments": SEGMENTS,
    "q12_vip_share": f"""SELECT vip AS vip_commission,
CASE WHEN everyone > 0 THEN vip / everyone * 100 ELSE 0 END AS vip_percentage
FROM (SELECT COALESCE({total("CASE WHEN segment = 'VIP' THEN segment_commission END")}, 0) AS vip,
      {total("segment_commission")} AS everyone FROM ({SEGMENTS}))""",
    "q13_seller_hubs": hubs("seller_name", "seller", "buyer_id", "unique_buyers"),
    "q14_buyer_hubs": hubs("buyer_name", "buyer", "seller_id", "unique_sellers"),
    "q15_principal_split": PRINCIPALS,
    "q16_principal_share": f"""SELECT *, s / NULLIF(s + b, 0) * 100 AS seller_percentage,
b / NULLIF(s + b, 0) * 100 AS buyer_percentage
FROM (SELECT COALESCE({total("CASE WHEN principal_type = 'seller_pays' THEN total_commission END")}, 0) AS s,
      COALESCE({total("CASE WHEN principal_type = 'buyer_pays' THEN total_commission END")}, 0) AS b
      FROM ({PRINCIPALS}))""",
    "q17_current_clients": CLIENTS,
    "q18_potential_buyers": BUYERS,
    "q19_potential_sellers": SELLERS,
    "q20_prospect_opportunity": f"""SELECT side, COUNT(*) AS prospects,
{total("commission_opportunity")} AS total_opportunity FROM ({BOTH_SIDES}) GROUP BY side""",
    "q21_best_prospect_buyer": f"SELECT * FROM ({BUYERS}) {BEST}",
    "q21_best_prospect_seller": f"SELECT * FROM ({SELLERS}) {BEST}",
    "q22_priority_prospects": f"""SELECT prospect_id, prospect_name, side, connections,
commission_opportunity, total_volume FROM ({BOTH_SIDES})
ORDER BY connections DESC, total_volume DESC NULLS LAST, side, prospect_id, prospect_name LIMIT 10""",
    "q23_relationships": PAIRS,
    "q24_relationship_type": TYPED_PAIRS,
    "q25_relationship_summary": f"""SELECT COUNT(*) AS total_relationships,
COUNT(CASE WHEN relationship_type = 'mutual' THEN 1 END) AS mutual_relationships,
COUNT(CASE WHEN relationship_type <> 'mutual' THEN 1 END) AS one_sided_relationships,
{total("total_commission")} AS total_commission FROM ({TYPED_PAIRS})""",
    **graph_queries(EDGES),
    **{f"{name}_whole": body for name, body in graph_queries(ALL_EDGES).items()},
    "q32_betweenness_100_pairs": graph_queries(EDGES.replace("LIMIT 30", "LIMIT 100"))["q32_betweenness"],
    "q32_betweenness_all_sources": f"""SELECT *, CAST(0 AS DOUBLE) AS standard_error
FROM ({graph_queries(EDGES)["q32_betweenness"]})""",
    "q34_network_metrics": f"""SELECT COUNT(DISTINCT seller) AS unique_sellers,
COUNT(DISTINCT buyer) AS unique_buyers,
COUNT(DISTINCT seller || '-' || buyer) AS unique_relationships,
AVG(transactions) AS avg_transactions_per_relationship FROM ({ALL_EDGES})""",
    "q35_client_list": f"SELECT client_name, client_id FROM ({CLIENTS})",
    "q36_client_stats": f"""SELECT COUNT(*) AS total_transactions, {VALUE} AS total_volume,
{COMMISSION} AS total_commission_paid, MIN(registered_on) AS first_transaction,
MAX(registered_on) AS last_transaction,
COUNT(DISTINCT CASE WHEN principal = 'V' THEN buyer_id END) AS unique_buyers,
COUNT(DISTINCT CASE WHEN principal = 'C' THEN seller_id END) AS unique_sellers,
{RATE} AS avg_commission_rate FROM ops WHERE {OWN}""",
    "q37_market_comparison": market_comparison(""),
    "q37_market_comparison_own": market_comparison(
        ", COUNT(CASE WHEN own THEN 1 END) AS client_only_transactions"
    ),
    "q38_client_trend": f"""SELECT month_name, COUNT(*) AS transactions, {VALUE} AS volume,
{COMMISSION} AS commission_paid FROM ops WHERE {OWN} GROUP BY month_name""",
    "q39_client_top_buyers": partners("buyer_name", "V", FIRST_SELLER_CLIENT),
    "q40_client_top_suppliers": partners("seller_name", "C", FIRST_CLIENT),
    "q41_client_costs": f"""SELECT year, {COMMISSION} AS commission_paid, {VALUE} AS volume,
COUNT(*) AS transactions, {RATE} AS effective_rate FROM ops WHERE {OWN} GROUP BY year""",
    "q42_client_tax_benefit": f"""SELECT c AS total_commission, v AS total_volume,
v * CAST(0.15 AS DOUBLE) AS estimated_tax_benefit,
v * CAST(0.15 AS DOUBLE) - c AS net_benefit,
(v * CAST(0.15 AS DOUBLE) - c) / NULLIF(c, 0) * 100 AS roi_percentage
FROM (SELECT {COMMISSION} AS c, {VALUE} AS v FROM ops WHERE {OWN})""",
    "q43_by_weekday": weekdays("Monday Tuesday Wednesday Thursday Friday Saturday Sunday"),
    "q44_weekday_labels": weekdays("Lunes Martes Miércoles Jueves Viernes Sábado Domingo"),
    "q45_by_operation_type": f"""SELECT operation_type, COUNT(*) AS operations,
{COMMISSION} AS commission, {VALUE} AS volume FROM f GROUP BY operation_type""",
    "q46_buyer_cities": cities("buyer_city"),
    "q47_seller_cities": cities("seller_city"),
    "q48_pareto": f"""SELECT client_name, commission,
{total("commission", SO_FAR)} AS cumulative_commission,
{total("commission", SO_FAR)} / {total("commission", "OVER ()")} * 100 AS cumulative_pct
FROM ({LISTED})""",
    "q49_concentration": f"""SELECT k AS top_clients, share AS top_percentage,
share > 80 AS high_risk
FROM (SELECT MAX(k) AS k, COALESCE({total("CASE WHEN place <= k THEN commission END")}, 0)
      / {total("commission")} * 100 AS share
      FROM (SELECT commission, ROW_NUMBER() OVER ({IN_ORDER}) AS place,
            CAST(FLOOR(COUNT(*) OVER () * CAST(0.2 AS DOUBLE)) AS BIGINT) AS k FROM ({LISTED})))""",
    "q50_pricing_anomalies": ANOMALIES,
    "q51_anomaly_count": f"SELECT COUNT(*) AS anomalies FROM ({ANOMALIES})",
    "q52_size_distribution": f"""SELECT CASE WHEN business_value < 1000000 THEN 'Small'
WHEN business_value < 10000000 THEN 'Medium' WHEN business_value < 50000000 THEN 'Large'
ELSE 'Very large' END AS size_band, COUNT(*) AS transaction_count,
{COMMISSION} AS total_commission, {RATE} AS avg_commission_rate FROM f GROUP BY 1""",
}
BODIES["q16_principal_share"] = f"""SELECT s AS seller_commission, b AS buyer_commission,
seller_percentage, buyer_percentage FROM ({BODIES["q16_principal_share"]})"""

TEXT_DATES = """FROM (SELECT * REPLACE (TRY_CAST(CASE WHEN operation_id LIKE '%1' THEN '31/31/2025'
ELSE strftime(registered_on, '%Y-%m-%d') END AS DATE) AS registered_on) FROM f) f"""
for _name in ("q08_churn_risk", "q09_churn_at_risk", "q43_by_weekday", "q44_weekday_labels"):
    BODIES[f"{_name}_text_dates"] = BODIES[_name].replace("FROM f", TEXT_DATES)
FRACTIONAL = """FROM (SELECT * REPLACE (pct_ref_sale / 7 AS pct_ref_sale,
pct_ref_purchase / 7 AS pct_ref_purchase) FROM f) f"""
BODIES["q04_referrers_fractional"] = REFERRERS.replace("FROM f", FRACTIONAL)


def build(names: Iterable[str]) -> dict[str, str]:
    """The statement of each named query that has one."""
    statements = {}
    for name in names:
        body = BODIES.get(name.removesuffix("_filtered"))
        if body is not None:
            chosen = FILTER if name.endswith("_filtered") else ""
            statements[name] = (
                f"WITH ops AS ({OPERATIONS}), f AS (SELECT * FROM ops {chosen})\n{body}"
            )
    return statements
