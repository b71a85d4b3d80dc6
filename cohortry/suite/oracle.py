"""The registered queries again, as SQL another engine runs on the same files."""

from __future__ import annotations

from .cases import CASES, RULES
from .definitions import DEFINITIONS, JUST_REFRESHED

NOW, EARLIER, BEFORE = "TIMESTAMP '2024-01-31'", "TIMESTAMP '2024-01-01'", "TIMESTAMP '2000-01-01'"
CARTS_BEFORE = "TIMESTAMP '2024-01-25'"
RUNS = ("TIMESTAMP '2024-01-26'", "TIMESTAMP '2024-01-28 09:30:00'", NOW, "TIMESTAMP '2024-02-07'")

_MODES = ", ".join(f"({number}, {active}, '{mode}')" for number, _, active, mode, _, _ in DEFINITIONS)

# The shop's tables over the star-schema files.
TABLES = """
cust AS (
  SELECT c_custkey AS customer_id,
         lower(replace(c_name, '#', '.') || '@' || c_mktsegment || '.example') AS email,
         'First' || CAST(c_custkey % 50 AS VARCHAR) AS firstname,
         c_name AS lastname,
         CASE WHEN c_custkey % 11 <> 0
              THEN CAST(DATE '1950-01-01' + CAST((c_custkey * 37) % 18000 AS INTEGER) AS DATE) END AS dob,
         CAST(c_custkey % 3 + 1 AS INTEGER) AS gender,
         CASE WHEN c_custkey % 4 <> 0 THEN 'VAT' || CAST(c_custkey AS VARCHAR) END AS taxvat,
         CAST(n_regionkey + 1 AS INTEGER) AS website_id,
         CAST(c_nationkey + 1 AS INTEGER) AS store_id,
         CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
              WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END AS INTEGER) AS group_id,
         CAST(DATE '1995-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS TIMESTAMP) AS created_at,
         lpad(CAST(c_custkey % 1000 AS VARCHAR), 5, '0') AS billing_postcode,
         'City' || CAST(c_custkey % 20 AS VARCHAR) AS billing_city,
         r_name AS billing_region,
         n_name AS billing_country_id
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  WHERE c_custkey > 0),
so AS (
  SELECT o_orderkey AS order_id,
         CASE WHEN o_custkey <> 0 THEN o_custkey END AS customer_id,
         CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'processing'
              WHEN o_orderkey % 2 = 0 THEN 'canceled' ELSE 'closed' END AS state,
         CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderkey % 4 = 1 THEN 'holded' ELSE 'pending' END AS status,
         CAST(o_totalprice AS DECIMAL(18,2)) AS base_grand_total,
         total_qty_ordered,
         o_orderdate AS created_at,
         CASE WHEN o_orderkey % 5 = 0 THEN 'SAVE' || CAST(o_orderkey % 3 AS VARCHAR) END AS coupon_code,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'card' WHEN '2' THEN 'paypal' WHEN '3' THEN 'bank'
              WHEN '4' THEN 'cod' WHEN '5' THEN 'gift' END AS payment_method,
         CASE o_orderkey % 3 WHEN 0 THEN 'flatrate' WHEN 1 THEN 'tablerate' ELSE 'freeshipping' END AS shipping_method,
         'NATION_' || CAST(o_orderkey % 25 AS VARCHAR) AS shipping_country_id
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS total_qty_ordered
                         FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
vo AS (SELECT * FROM so WHERE state NOT IN ('canceled', 'closed') AND customer_id IS NOT NULL),
soi AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, p_brand || '-' || CAST(p_partkey AS VARCHAR) AS sku,
         CASE WHEN p_type = 'PROMO' THEN 'bundle' ELSE 'simple' END AS product_type
  FROM lineitem JOIN part ON l_partkey = p_partkey),
cp AS (
  SELECT p_size AS category_id, p_partkey AS product_id FROM part
  UNION ALL SELECT 100 + CAST(replace(p_brand, 'Brand#', '') AS INTEGER), p_partkey FROM part),
ev AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
q AS (
  SELECT event_id AS quote_id, user_id AS customer_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_active,
         CAST(value AS DECIMAL(18,2)) AS subtotal, k % 7 AS items_count, ts AS updated_at
  FROM ev WHERE event_type IN ('click', 'purchase')),
qi AS (
  SELECT event_id AS quote_id, p_brand || '-' || CAST(p_partkey AS VARCHAR) AS sku, CAST(NULL AS BIGINT) AS parent_item_id
  FROM ev JOIN part ON p_partkey = k WHERE event_type IN ('click', 'purchase')
  UNION ALL
  SELECT event_id, 'CHILD-' || CAST(k AS VARCHAR), 1
  FROM ev WHERE event_type IN ('click', 'purchase') AND event_id % 3 = 0),
wi AS (SELECT user_id AS customer_id, k AS product_id FROM ev WHERE event_type = 'signup'),
pv AS (SELECT user_id AS customer_id, k AS product_id, ts AS viewed_at FROM ev WHERE event_type = 'view'),
lc AS (
  SELECT * FROM (SELECT q.*, row_number() OVER (PARTITION BY customer_id ORDER BY updated_at DESC, quote_id DESC) AS nth
                 FROM q WHERE is_active = 1) WHERE nth = 1),
wc AS (SELECT customer_id, count(*) AS n FROM wi GROUP BY customer_id)"""

_AGGREGATES = """
  SELECT customer_id, count(*) AS total_orders, CAST(sum(base_grand_total) AS DOUBLE) AS total_revenue,
         CAST(sum(base_grand_total) AS DOUBLE) / count(base_grand_total) AS average_order_value,
         CAST(sum(total_qty_ordered) AS DOUBLE) AS total_items,
         min(created_at) AS first_order_date, max(created_at) AS last_order_date
  FROM {orders} GROUP BY customer_id"""

_FEATURES = """
  SELECT cust.*, coalesce(total_orders, 0) AS total_orders, total_revenue, average_order_value, total_items,
         first_order_date, last_order_date,
         coalesce(CAST(lc.subtotal AS DOUBLE), 0) AS cart_subtotal, coalesce(lc.items_count, 0) AS cart_items_count,
         CAST(date_diff('second', lc.updated_at, {now}) // 86400 AS INTEGER) AS cart_last_activity,
         lc.customer_id IS NOT NULL AS has_active_cart, coalesce(wc.n, 0) AS wishlist_items_count
  FROM cust LEFT JOIN {facts} f ON f.customer_id = cust.customer_id
  LEFT JOIN lc ON lc.customer_id = cust.customer_id
  LEFT JOIN wc ON wc.customer_id = cust.customer_id"""

FACTS = f"""{TABLES},
ofacts AS ({_AGGREGATES.format(orders="vo")}),
feat AS ({_FEATURES.format(facts="ofacts", now=NOW)})"""

# The segment definitions, as predicates over feat; {vo} is the valid orders then.
_ITEMS = "SELECT {vo}.customer_id FROM {vo} JOIN soi ON {vo}.order_id = soi.order_id"
SEGMENTS: dict[int, str] = {
    1: "total_orders >= 10",
    2: "contains(email, '@household')",
    3: "group_id = 1",
    4: "total_revenue >= 2000000",
    5: "group_id = 1 AND total_orders >= 5",
    6: "total_revenue >= 2000000 OR total_orders >= 10",
    7: "group_id = 1 AND total_orders >= 3 AND (cart_subtotal > 10 OR last_order_date > TIMESTAMP '2001-01-01')",
    8: "cart_subtotal > 5 AND cart_last_activity > 1",
    9: "customer_id IN (SELECT customer_id FROM {vo} WHERE coupon_code = 'SAVE1')",
    10: f"customer_id IN ({_ITEMS} WHERE product_type = 'simple' AND contains(lower(sku), 'brand#12-'))",
    11: f"customer_id IN ({_ITEMS} JOIN cp ON cp.product_id = soi.product_id WHERE category_id IN (10, 20))",
    12: "wishlist_items_count >= 14",
    13: "true",
    14: "false",
    15: "false",
    18: "total_orders > 100000",
    19: "has_active_cart AND customer_id IN (SELECT pv.customer_id FROM pv JOIN cp ON cp.product_id = pv.product_id "
    "WHERE category_id IN (10, 20))",
    20: "customer_id IN (SELECT customer_id FROM {vo} WHERE payment_method IN ('card', 'paypal')) AND customer_id IN "
    "(SELECT lc.customer_id FROM lc JOIN qi ON qi.quote_id = lc.quote_id WHERE parent_item_id IS NULL "
    "AND contains(lower(sku), 'brand#1'))",
}
LIVE: dict[int, str] = {
    31: "total_orders < 5",
    32: "average_order_value < 150000",
    33: "last_order_date < TIMESTAMP '2000-06-01'",
    34: "cart_last_activity < 3",
    35: "cart_last_activity = 7",
    36: "total_orders >= 15 OR (cart_subtotal > 5 AND cart_last_activity >= 5)",
    37: "customer_id IN (SELECT customer_id FROM {vo} WHERE payment_method = 'card') AND total_orders <= 8",
    38: "total_orders < 5",
}
# The ages in days at which some of these changes its answer.
AGES = "(3), (5), (7), (8)"
INACTIVE = {16: "total_orders >= 1"}
REALTIME = "(4, 5, 6, 8, 9, 12, 18, 19)"


def _union(parts: list[tuple[int, str]], feat: str = "feat") -> str:
    return "\n  UNION ALL ".join(
        f"SELECT CAST({number} AS INTEGER) AS segment_id, customer_id FROM {feat} WHERE {test}" for number, test in parts
    )


def _now_members(ids: list[int] | None = None, segments: dict[int, str] = SEGMENTS) -> str:
    chosen = [(i, test.format(vo="vo")) for i, test in segments.items() if ids is None or i in ids]
    return f"m AS ({_union(chosen)})"


def _earlier_members(now: str = NOW, segments: dict[int, str] = SEGMENTS) -> str:
    """Members by the orders of an earlier day, with ages as of ``now``."""
    chosen = [(i, test.format(vo="vo0")) for i, test in segments.items()]
    return f"""vo0 AS (SELECT * FROM vo WHERE created_at < {BEFORE}),
of0 AS ({_AGGREGATES.format(orders="vo0")}),
feat0 AS ({_FEATURES.format(facts="of0", now=now)}),
m0 AS ({_union(chosen, "feat0")})"""


def _earlier_carts(now: str) -> str:
    """Members of the live segments by the carts of an earlier day."""
    features = _FEATURES.format(facts="ofacts", now=now).replace("LEFT JOIN lc ON lc.", "LEFT JOIN lc0 lc ON lc.")
    return f"""lc0 AS (SELECT * FROM (SELECT q.*, row_number() OVER (PARTITION BY customer_id ORDER BY updated_at DESC, quote_id DESC) AS nth
  FROM q WHERE is_active = 1 AND updated_at < {CARTS_BEFORE}) WHERE nth = 1),
feat0 AS ({features}),
m0 AS ({_union([(i, test.format(vo="vo")) for i, test in LIVE.items()], "feat0")})"""


def _due(carts: str) -> str:
    """Customers whose cart reaches some age after the earlier day and up to now."""
    return f"""SELECT customer_id FROM {carts} c, (VALUES {AGES}) AS a(age)
  WHERE updated_at + to_days(CAST(age AS INTEGER)) > {EARLIER} AND updated_at + to_days(CAST(age AS INTEGER)) <= {NOW}"""


def _live_stream(earlier: str, touched: str) -> str:
    """Earlier members of the live segments after the realtime ones were evaluated again for some customers."""
    return _with(
        _now_members(segments=LIVE).replace("m AS (", "m AS MATERIALIZED (", 1),
        earlier.replace("m0 AS (", "m0 AS MATERIALIZED (", 1),
        f"t AS MATERIALIZED (SELECT DISTINCT customer_id FROM ({touched}) AS x)",
        "fresh AS (SELECT segment_id, m.customer_id FROM m JOIN t ON t.customer_id = m.customer_id WHERE segment_id <> 38)",
        "old AS (SELECT segment_id, m0.customer_id, t.customer_id IS NOT NULL AND segment_id <> 38 AS again FROM m0 LEFT JOIN t ON t.customer_id = m0.customer_id)",
        f"""SELECT segment_id, customer_id, {EARLIER} AS assigned_at FROM old WHERE NOT again
UNION ALL
SELECT fresh.segment_id, fresh.customer_id, CASE WHEN old.segment_id IS NULL THEN {NOW} ELSE {EARLIER} END
FROM fresh LEFT JOIN old ON old.segment_id = fresh.segment_id AND old.customer_id = fresh.customer_id""",
    )


def _time_flips() -> str:
    """Everybody evaluated at each of the times; members are assigned when they joined last."""
    states, features = [], []
    for run, now in enumerate(RUNS):
        features.append(f"f{run} AS ({_FEATURES.format(facts='ofacts', now=now)})")
        union = _union([(i, test.format(vo="vo")) for i, test in LIVE.items()], f"f{run}")
        states.append(f"SELECT segment_id, customer_id, CAST({run} AS INTEGER) AS run FROM ({union}) AS x")
    return _with(
        *features,
        "s AS (" + "\nUNION ALL ".join(states) + ")",
        "island AS (SELECT *, run - row_number() OVER (PARTITION BY segment_id, customer_id ORDER BY run) AS k FROM s)",
        f"times AS (SELECT * FROM (VALUES {', '.join(f'({n}, {now})' for n, now in enumerate(RUNS))}) AS v(run, at_time))",
        """joined AS (SELECT segment_id, customer_id, run, min(run) OVER (PARTITION BY segment_id, customer_id, k) AS first FROM island)""",
        "SELECT segment_id, customer_id, at_time AS assigned_at, joined.run AS run FROM joined JOIN times ON times.run = joined.first",
    )


def _with(*parts: str) -> str:
    *tables, select = parts
    return f"WITH {', '.join([FACTS, *tables])}\n{select}"


BUYERS = """b AS (
  SELECT CAST(l_partkey + 1000 AS INTEGER) AS segment_id, customer_id, max(created_at) AS assigned_at
  FROM vo JOIN lineitem ON l_orderkey = order_id JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""
PAIRS = "pairs AS (SELECT DISTINCT user_id AS customer_id, CAST(k + 1000 AS INTEGER) AS segment_id FROM ev)"
CATALOG = """cat AS (
  SELECT CAST(p_partkey + 1000 AS INTEGER) AS segment_id,
         'Buyers of ' || p_brand || '-' || CAST(p_partkey AS VARCHAR) AS name,
         CASE WHEN p_size > 25 THEN p_name END AS description,
         p_partkey % 5 <> 0 AS is_active,
         CASE p_size % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'cron' ELSE 'realtime' END AS refresh_mode,
         CASE p_partkey % 4 WHEN 1 THEN '*/5 ' || CAST(p_partkey % 24 AS VARCHAR) || ' * * *'
              WHEN 2 THEN 'no schedule' END AS cron_expression,
         CAST(floor(p_retailprice) AS BIGINT) AS customer_count,
         CASE WHEN p_partkey % 7 <> 0
              THEN TIMESTAMP '2024-01-31' - to_minutes(CAST(p_partkey % 180 AS INTEGER)) END AS last_refreshed,
         TIMESTAMP '2023-01-01' + to_days(CAST(p_partkey % 365 AS INTEGER)) AS created_at,
         TIMESTAMP '2023-01-01' + to_days(CAST(p_partkey % 365 + p_size AS INTEGER)) AS updated_at
  FROM part)"""
CHANGES = """ch AS (SELECT CAST(p_partkey + CASE WHEN p_type = 'PROMO' THEN 10000000 ELSE 1000 END AS INTEGER) AS segment_id, 'Fans of ' || p_name AS name,
  CASE WHEN p_size % 2 = 0 THEN 'realtime' END AS refresh_mode, CASE WHEN p_size % 3 = 0 THEN false END AS is_active
  FROM part WHERE p_type = 'PROMO' OR p_size > 45)"""
_EXPORTED = "SELECT customer_id, email, firstname AS first_name, lastname AS last_name"


def _registered() -> str:
    """Earlier members, and the matches of the realtime segments for those who signed up."""
    return _with(
        _now_members(),
        _earlier_members(EARLIER),
        f"t AS ({_touched('signup')})",
        f"""SELECT segment_id, customer_id, {EARLIER} AS assigned_at FROM m0
UNION ALL
SELECT segment_id, customer_id, {NOW} FROM m
WHERE segment_id IN {REALTIME} AND customer_id IN (SELECT customer_id FROM t)
  AND (segment_id, customer_id) NOT IN (SELECT segment_id, customer_id FROM m0)""",
    )


def _touched(kind: str) -> str:
    return f"SELECT DISTINCT user_id AS customer_id FROM ev WHERE event_type = '{kind}'"


def oracle_sql() -> dict[str, str]:
    found = {
        "src_population": _with("SELECT customer_id, email, created_at FROM cust"),
        "src_eav_pivot": _with(
            "SELECT customer_id AS entity_id, firstname, lastname, dob, gender, taxvat FROM cust"
        ),
        "src_valid_orders": _with(
            """SELECT order_id, customer_id, state, status, CAST(base_grand_total AS DOUBLE) AS base_grand_total,
  CAST(total_qty_ordered AS DOUBLE) AS total_qty_ordered, created_at, coupon_code, payment_method, shipping_method,
  shipping_country_id FROM vo"""
        ),
        "src_active_carts": _with(
            """SELECT quote_id, customer_id, CAST(is_active AS INTEGER) AS is_active, CAST(subtotal AS DOUBLE) AS subtotal,
  CAST(items_count AS INTEGER) AS items_count, updated_at FROM q WHERE is_active = 1"""
        ),
        "src_cart_items": _with("SELECT quote_id, sku FROM qi WHERE parent_item_id IS NULL"),
        "src_active_segments": _with(
            CATALOG, "SELECT segment_id, name, refresh_mode FROM cat WHERE is_active AND refresh_mode = 'realtime'"
        ),
        "export_csv": _with(
            _now_members([6]),
            f"{_EXPORTED}, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM cust JOIN m USING (customer_id)",
        ),
        "feature_table": _with(
            """SELECT customer_id, email, firstname, lastname, dob, gender, taxvat, website_id, store_id, group_id, created_at,
  total_orders, total_revenue, average_order_value, total_items, first_order_date, last_order_date, cart_subtotal,
  CAST(cart_items_count AS INTEGER) AS cart_items_count, cart_last_activity, has_active_cart, wishlist_items_count
FROM feat"""
        ),
        "agg_order_summary": _with("SELECT * FROM ofacts"),
        "agg_having": _with(
            "SELECT customer_id, total_orders, total_revenue FROM ofacts WHERE total_orders >= 5 AND total_revenue < 1500000"
        ),
        "agg_purchased_items": _with(
            """SELECT customer_id, count(*) AS purchased_items FROM vo JOIN soi USING (order_id)
WHERE product_type = 'simple' AND contains(lower(sku), 'brand#1') GROUP BY customer_id"""
        ),
        "agg_distinct_products": _with(
            """SELECT customer_id, count(DISTINCT soi.product_id) AS distinct_products
FROM vo JOIN soi USING (order_id) JOIN cp ON cp.product_id = soi.product_id
WHERE category_id IN (10, 20, 112) GROUP BY customer_id"""
        ),
        "agg_segment_counts": _with(
            BUYERS, "SELECT segment_id, count(*) AS customer_count FROM b GROUP BY segment_id"
        ),
        "cart_latest": _with(
            """SELECT customer_id, quote_id, updated_at, CAST(subtotal AS DOUBLE) AS subtotal,
  CAST(items_count AS INTEGER) AS items_count FROM lc"""
        ),
        "cart_matching_items": _with(
            """SELECT lc.customer_id, lc.quote_id, count(*) AS items FROM lc JOIN qi ON qi.quote_id = lc.quote_id
WHERE parent_item_id IS NULL AND contains(lower(sku), 'brand#1') GROUP BY 1, 2"""
        ),
        "refresh_segment": _with(
            _now_members([1]), f"SELECT segment_id, customer_id, {NOW} AS assigned_at FROM m"
        ),
        "refresh_all": _with(_now_members(), f"SELECT segment_id, customer_id, {NOW} AS assigned_at FROM m"),
        "mass_refresh": _with(
            _now_members([4, 5, 9, 18]),
            f"""SELECT CAST(i AS INTEGER) AS segment_id, (SELECT count(*) FROM m WHERE segment_id = i) AS customer_count,
  {NOW} AS last_refreshed, (SELECT count(*) FROM m) AS total FROM (VALUES (4), (5), (9), (18)) AS s(i)""",
        ),
        "refresh_log": _with(
            _now_members([1, 4, 18]),
            f"""SELECT CAST(i AS INTEGER) AS segment_id, 'saved' AS action, n AS details, {EARLIER} AS created_at
FROM (VALUES (1, 'Gold'), (4, 'Revenue'), (17, 'Unknown leaf'), (18, 'Nobody')) AS s(i, n)
UNION ALL SELECT CAST(i AS INTEGER), 'refresh_before', NULL, {NOW} FROM (VALUES (1), (4), (17), (18)) AS s(i)
UNION ALL SELECT CAST(i AS INTEGER), 'refresh_after',
  'assigned_count=' || CAST((SELECT count(*) FROM m WHERE segment_id = i) AS VARCHAR), {NOW} FROM (VALUES (1), (4), (18)) AS s(i)
UNION ALL SELECT 17, 'refresh_failed', 'unknown condition Weather.rain', {NOW}
UNION ALL SELECT DISTINCT 18, 'assigned', 'customer_id=' || CAST(user_id AS VARCHAR), {NOW} FROM ev WHERE user_id > 0""",
        ),
        "stale_after_refresh": f"""WITH d(segment_id, is_active, refresh_mode) AS (VALUES {_MODES}),
r AS (SELECT *, CASE WHEN NOT is_active OR segment_id = 17 THEN NULL WHEN segment_id IN {JUST_REFRESHED} THEN {NOW} ELSE {EARLIER} END AS last_refreshed FROM d)
SELECT CAST(segment_id AS INTEGER) AS segment_id, refresh_mode, last_refreshed FROM r
WHERE is_active AND (refresh_mode = 'cron' OR (refresh_mode = 'realtime' AND (last_refreshed IS NULL OR last_refreshed < TIMESTAMP '2024-01-30 23:00:00')))""",
        "list_after_refresh": _with(
            _now_members(),
            f"""c AS (SELECT CAST(segment_id AS INTEGER) AS segment_id, 'Active' AS status_label,
  (SELECT count(*) FROM m WHERE m.segment_id = d.segment_id) AS customer_count,
  CASE WHEN segment_id <> 17 THEN {NOW} END AS last_refreshed
  FROM (VALUES {_MODES}) AS d(segment_id, is_active, refresh_mode) WHERE is_active)""",
            """SELECT *, (SELECT count(*) FROM c) AS total FROM c ORDER BY customer_count DESC, segment_id LIMIT 10""",
        ),
        "forget_stored": _with(
            _now_members(), f"SELECT segment_id, customer_id, {NOW} AS assigned_at FROM m JOIN cust USING (customer_id) WHERE group_id IS DISTINCT FROM 3"
        ),
        "refresh_status": _with(
            _now_members(),
            f"""SELECT CAST(i AS INTEGER) AS segment_id, i <> 16 AS is_active,
  (SELECT count(*) FROM m WHERE segment_id = i) AS customer_count,
  CASE WHEN i NOT IN (16, 17) THEN {NOW} END AS last_refreshed FROM range(1, 21) AS s(i)""",
        ),
        "segment_growth": _with(
            _now_members(),
            _earlier_members(EARLIER),
            "s AS (SELECT i FROM range(1, 21) AS r(i) WHERE i NOT IN (16, 17))",
            f"""SELECT CAST(i AS INTEGER) AS segment_id, {EARLIER} AS refreshed_at,
  (SELECT count(*) FROM m0 WHERE segment_id = i) AS customer_count, CAST(NULL AS BIGINT) AS growth FROM s
UNION ALL SELECT CAST(i AS INTEGER), {NOW}, (SELECT count(*) FROM m WHERE segment_id = i),
  (SELECT count(*) FROM m WHERE segment_id = i) - (SELECT count(*) FROM m0 WHERE segment_id = i) FROM s""",
        ),
        "match_check": _with(
            _now_members(),
            """SELECT DISTINCT user_id AS customer_id, CAST(k % 22 + 1 AS INTEGER) AS segment_id,
  (CAST(k % 22 + 1 AS INTEGER), user_id) IN (SELECT segment_id, customer_id FROM m) AS matches FROM ev""",
        ),
        "validate_batch": _with(
            "u AS (SELECT DISTINCT user_id AS customer_id FROM ev)",
            """SELECT CAST(1 AS INTEGER) AS check_id, customer_id FROM cust JOIN u USING (customer_id)
WHERE contains(email, '@household')
UNION ALL SELECT 2, customer_id FROM ofacts JOIN u USING (customer_id) JOIN cust USING (customer_id) WHERE total_orders < 8
UNION ALL SELECT 4, customer_id FROM ofacts JOIN u USING (customer_id) JOIN cust USING (customer_id)
WHERE last_order_date > TIMESTAMP '2001-01-01'""",
        ),
        "custom_condition": _with(
            """SELECT CAST(30 AS INTEGER) AS segment_id, customer_id FROM feat JOIN customer ON c_custkey = customer_id
WHERE c_acctbal >= 5000 AND total_orders >= 5"""
        ),
        "custom_rows": _with(
            """e AS (SELECT user_id AS customer_id, count(*) FILTER (event_type = 'error') AS errors, max(value) - min(value) AS spread, max(ts) AS seen
  FROM ev GROUP BY user_id)""",
            """SELECT CAST(41 AS INTEGER) AS segment_id, customer_id FROM feat JOIN e USING (customer_id) WHERE errors >= 14
UNION ALL SELECT 42, customer_id FROM feat JOIN e USING (customer_id) WHERE seen >= TIMESTAMP '2024-01-20' AND spread > 90 AND group_id <> 3
UNION ALL SELECT 43, feat.customer_id FROM feat LEFT JOIN e ON e.customer_id = feat.customer_id WHERE coalesce(errors, 0) = 0 OR total_orders >= 18""",
        ),
        "delta_added": _with(
            _now_members(segments=SEGMENTS | LIVE), _earlier_members(segments=SEGMENTS | LIVE), "SELECT * FROM m EXCEPT SELECT * FROM m0"
        ),
        "delta_removed": _with(
            _now_members(segments=SEGMENTS | LIVE), _earlier_members(segments=SEGMENTS | LIVE), "SELECT * FROM m0 EXCEPT SELECT * FROM m"
        ),
        "assign_customers": _with(
            BUYERS,
            PAIRS,
            f"""SELECT segment_id, customer_id, assigned_at FROM b
WHERE (segment_id, customer_id) NOT IN (SELECT segment_id, customer_id FROM pairs)
UNION ALL SELECT segment_id, customer_id, {NOW} FROM pairs""",
        ),
        "remove_customers": _with(
            BUYERS,
            PAIRS,
            """SELECT segment_id, customer_id, assigned_at FROM b
WHERE (segment_id, customer_id) NOT IN (SELECT segment_id, customer_id FROM pairs)""",
        ),
        "assign_stored": _with(
            _now_members([9, 10, 11, 13]),
            "p AS (SELECT DISTINCT user_id AS customer_id, CAST(k % 3 + 9 AS INTEGER) AS segment_id FROM ev WHERE user_id > 0)",
            "r AS (SELECT DISTINCT user_id AS customer_id, CAST(k % 3 + 9 AS INTEGER) AS segment_id FROM ev WHERE event_type = 'error')",
            f"""SELECT segment_id, customer_id, {EARLIER} AS assigned_at FROM m
WHERE (segment_id, customer_id) NOT IN (SELECT segment_id, customer_id FROM p)
UNION ALL SELECT segment_id, customer_id, {NOW} FROM p
WHERE (segment_id, customer_id) NOT IN (SELECT segment_id, customer_id FROM r)""",
        ),
        "customer_segments": _with(
            BUYERS, CATALOG, "SELECT customer_id, segment_id, name, description FROM b JOIN cat USING (segment_id)"
        ),
        "customer_segment_ids": _with(
            BUYERS,
            """SELECT cust.customer_id, coalesce(string_agg(CAST(segment_id AS VARCHAR), ',' ORDER BY segment_id), '') AS segment_ids,
  count(segment_id) AS segments FROM cust LEFT JOIN b ON b.customer_id = cust.customer_id GROUP BY cust.customer_id""",
        ),
        "membership_check": _with(
            BUYERS,
            PAIRS,
            """SELECT customer_id, segment_id, (segment_id, customer_id) IN (SELECT segment_id, customer_id FROM b) AS in_segment
FROM pairs""",
        ),
        "export_members": _with(
            BUYERS, f"{_EXPORTED}, created_at FROM cust JOIN b USING (customer_id) WHERE segment_id = 1005"
        ),
        "matched_customers": _with(
            BUYERS,
            """SELECT customer_id, firstname || ' ' || lastname AS name, email, billing_postcode, billing_city, billing_region, billing_country_id,
  created_at, (SELECT count(*) FROM b JOIN cust USING (customer_id) WHERE segment_id = 1010) AS total
FROM cust JOIN b USING (customer_id) WHERE segment_id = 1010 ORDER BY customer_id LIMIT 20""",
        ),
        "customers_in_segment": _with(
            BUYERS, "SELECT customer_id, email, group_id FROM cust JOIN b USING (customer_id) WHERE segment_id = 1003"
        ),
        "rule_quote_eligible": _with(
            BUYERS,
            """SELECT quote_id, customer_id FROM q
WHERE customer_id IN (SELECT customer_id FROM b WHERE segment_id IN (1003, 1005, 1010))""",
        ),
        "rule_quote_not_in": _with(
            BUYERS,
            """SELECT quote_id, customer_id FROM q
WHERE customer_id NOT IN (SELECT customer_id FROM b WHERE segment_id IN (1003, 1005, 1010))""",
        ),
        "segment_profile": _with(
            BUYERS,
            """SELECT segment_id, count(*) AS customers, CAST(sum(total_orders) AS BIGINT) AS orders,
  CAST(sum(CAST(coalesce(total_revenue, 0) AS DECIMAL(38,2))) AS DOUBLE) AS revenue,
  CAST(sum(CAST(coalesce(total_items, 0) AS DECIMAL(38,2))) AS DOUBLE) AS items,
  count(*) FILTER (total_revenue >= 2000000) AS high_value_customers,
  CAST(sum(CAST(coalesce(total_revenue, 0) AS DECIMAL(38,2))) AS DOUBLE) / count(*) AS revenue_per_customer,
  CAST(sum(CAST(coalesce(total_revenue, 0) AS DECIMAL(38,2))) AS DOUBLE) / CAST(sum(total_orders) AS BIGINT) AS revenue_per_order
FROM b JOIN feat USING (customer_id) GROUP BY segment_id""",
        ),
        "segment_list": _with(
            CATALOG,
            """c AS (SELECT * FROM cat WHERE segment_id >= 1010 AND customer_count BETWEEN 900 AND 5000
  AND contains(lower(name), 'brand#1') AND is_active AND last_refreshed <= TIMESTAMP '2024-01-31')""",
            """SELECT segment_id, name, 'Active' AS status_label,
  CASE refresh_mode WHEN 'manual' THEN 'Manual' WHEN 'cron' THEN 'Cron Schedule' ELSE 'Real-time' END AS mode_label,
  customer_count, last_refreshed, (SELECT count(*) FROM c) AS total FROM c ORDER BY segment_id LIMIT 20 OFFSET 20""",
        ),
        "segment_list_after": _with(
            CATALOG,
            """SELECT segment_id, name, created_at FROM cat WHERE refresh_mode = 'cron' AND segment_id > 1100
ORDER BY segment_id LIMIT 50""",
        ),
        "stored_segments": _with(
            CATALOG,
            CHANGES,
            f"""SELECT segment_id, coalesce(ch.name, cat.name) AS name, coalesce(ch.is_active, cat.is_active, true) AS is_active,
  coalesce(ch.refresh_mode, cat.refresh_mode, 'manual') AS refresh_mode,
  CASE WHEN cat.name IS NULL THEN {NOW} ELSE {EARLIER} END AS created_at,
  CASE WHEN ch.name IS NULL THEN {EARLIER} ELSE {NOW} END AS updated_at
FROM cat FULL JOIN ch USING (segment_id) WHERE coalesce(ch.refresh_mode, cat.refresh_mode, 'manual') <> 'cron'""",
        ),
        "upsert_segments": _with(
            CATALOG,
            CHANGES,
            f"""SELECT segment_id, coalesce(ch.name, cat.name) AS name, cat.description,
  coalesce(ch.is_active, cat.is_active, true) AS is_active,
  coalesce(ch.refresh_mode, cat.refresh_mode, 'manual') AS refresh_mode,
  coalesce(cat.customer_count, 0) AS customer_count, coalesce(cat.created_at, {NOW}) AS created_at,
  CASE WHEN ch.name IS NOT NULL THEN {NOW} ELSE cat.updated_at END AS updated_at
FROM cat FULL JOIN ch USING (segment_id)""",
        ),
        "delete_segments": _with(
            BUYERS,
            CATALOG,
            "gone AS (SELECT segment_id FROM cat WHERE refresh_mode = 'manual')",
            """SELECT segment_id, count(*) AS left_rows, 'segments' AS table_name FROM cat
WHERE segment_id NOT IN (SELECT segment_id FROM gone) GROUP BY segment_id
UNION ALL SELECT segment_id, count(*), t FROM b, (VALUES ('members'), ('log')) AS s(t)
WHERE segment_id NOT IN (SELECT segment_id FROM gone) GROUP BY segment_id, t""",
        ),
        "forget_customers": _with(
            BUYERS, "SELECT segment_id, customer_id, assigned_at FROM b JOIN cust USING (customer_id) WHERE group_id <> 3"
        ),
        "segments_due": _with(
            CATALOG,
            """ticks AS (SELECT DISTINCT '*/5 ' || CAST(hour(ts) AS VARCHAR) || ' * * *' AS cron_expression,
  time_bucket(INTERVAL 5 MINUTE, ts) AS due_at FROM events)""",
            """SELECT segment_id, refresh_mode, cron_expression FROM cat
WHERE is_active AND refresh_mode IN ('cron', 'realtime') AND (cron_expression IS NULL
  OR cron_expression NOT IN (SELECT cron_expression FROM ticks)
  OR cron_expression IN (SELECT cron_expression FROM ticks WHERE due_at = TIMESTAMP '2024-01-15 12:35:00'))""",
        ),
        "segments_stale": _with(
            CATALOG,
            """SELECT segment_id, refresh_mode, last_refreshed FROM cat WHERE is_active AND (refresh_mode = 'cron'
  OR (refresh_mode = 'realtime' AND (last_refreshed IS NULL OR last_refreshed < TIMESTAMP '2024-01-30 23:00:00')))""",
        ),
        "segments_need_refresh": _with(
            CATALOG,
            """SELECT segment_id, refresh_mode, last_refreshed FROM cat WHERE is_active AND refresh_mode <> 'manual'
  AND (last_refreshed IS NULL OR last_refreshed < TIMESTAMP '2024-01-30 23:00:00')""",
        ),
        "stream_register": _registered(),
        "stream_customer_save": _live_stream(
            _earlier_members(EARLIER, LIVE), "SELECT c_custkey AS customer_id FROM customer WHERE c_acctbal < 0"
        ),
        "stream_order_placed": _live_stream(
            _earlier_members(EARLIER, LIVE), f"SELECT customer_id FROM so WHERE created_at >= {BEFORE} UNION ALL {_due('lc')}"
        ),
        "stream_cart_change": _live_stream(
            _earlier_carts(EARLIER), f"SELECT customer_id FROM q WHERE updated_at >= {CARTS_BEFORE} UNION ALL {_due('lc0')}"
        ),
        "time_flips": _time_flips(),
        "refresh_catalog": _with(
            CATALOG,
            f"""SELECT DISTINCT CAST(product_id + 1000 AS INTEGER) AS segment_id, vo.customer_id, {NOW} AS assigned_at
FROM vo JOIN soi ON soi.order_id = vo.order_id JOIN cust ON cust.customer_id = vo.customer_id
JOIN cat ON cat.segment_id = product_id + 1000 WHERE product_type = 'simple' AND is_active""",
        ),
        "stream_changelog": _with(
            _now_members(),
            _earlier_members(EARLIER),
            f"t AS ({_touched('view')})",
            "s AS (SELECT DISTINCT k % 10 + 1 AS segment_id FROM ev WHERE event_type = 'error')",
            f"""SELECT segment_id, customer_id, {NOW} AS assigned_at FROM m WHERE segment_id IN (SELECT segment_id FROM s)
UNION ALL SELECT segment_id, customer_id, {EARLIER} FROM m0 WHERE segment_id NOT IN (SELECT segment_id FROM s)
  AND (segment_id NOT IN {REALTIME} OR customer_id NOT IN (SELECT customer_id FROM t)
       OR (segment_id, customer_id) IN (SELECT segment_id, customer_id FROM m))
UNION ALL SELECT segment_id, customer_id, {NOW} FROM m WHERE segment_id NOT IN (SELECT segment_id FROM s)
  AND segment_id IN {REALTIME} AND customer_id IN (SELECT customer_id FROM t)
  AND (segment_id, customer_id) NOT IN (SELECT segment_id, customer_id FROM m0)""",
        ),
        "stream_login_lookup": _with(
            BUYERS,
            """SELECT event_id, user_id AS customer_id, coalesce(n, 0) AS segment_count
FROM ev LEFT JOIN (SELECT customer_id, count(*) AS n FROM b GROUP BY customer_id) c ON c.customer_id = user_id
WHERE event_type = 'error'""",
        ),
    }
    found["export_xml"] = found["export_csv"]
    for key, cases in CASES.items():
        found[key] = _with(_union([(number, test) for number, (_, _, _, test) in enumerate(cases, 1)]))
    for key, trees in RULES.items():
        found[key] = _with(_union([(number, test) for number, (_, test) in enumerate(trees, 1)]))
    return found
