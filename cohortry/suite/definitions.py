"""Segment definitions and parameters used by the registered queries."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..functions.values import instant_literal
from ..plans.rules import group, leaf
from ..session import small_table

NOW = dt.datetime(2024, 1, 31)
BEFORE = "2000-01-01 00:00:00"  # the earlier state membership deltas start from
CARTS_BEFORE = "2024-01-25 00:00:00"
EARLIER = dt.datetime(2024, 1, 1)  # when that earlier state was assigned
TICK = dt.datetime(2024, 1, 15, 12, 35)

JUST_REFRESHED = (4, 6, 7, 9, 16, 17)

ALL, ANY = "all", "any"

# (id, name, active, refresh mode, schedule, rule document or raw text)
DEFINITIONS: list[tuple[int, str, bool, str, str | None, object]] = [
    (1, "Gold", True, "cron", "0 2 * * *", group(ALL, leaf("Order.total_orders", ">=", "10"))),
    (2, "Household mail", True, "manual", None, group(ALL, leaf("Customer.email", "{}", "@household"))),
    (3, "Group one", True, "cron", None, group(ALL, leaf("Customer.group_id", "==", "1"))),
    (4, "Revenue", True, "realtime", None, group(ALL, leaf("Order.total_revenue", ">=", "2000000"))),
    (
        5,
        "Loyal group one",
        True,
        "realtime",
        None,
        group(ALL, leaf("Customer.group_id", "==", "1"), leaf("Order.total_orders", ">=", "5")),
    ),
    (
        6,
        "Big or frequent",
        True,
        "realtime",
        None,
        group(ANY, leaf("Order.total_revenue", ">=", "2000000"), leaf("Order.total_orders", ">=", "10")),
    ),
    (
        7,
        "Nested",
        True,
        "cron",
        "*/5 12 * * *",
        group(
            ALL,
            leaf("Customer.group_id", "==", "1"),
            leaf("Order.total_orders", ">=", "3"),
            group(ANY, leaf("Cart.cart_subtotal", ">", "10"), leaf("Order.last_order_date", ">", "2001-01-01")),
        ),
    ),
    (
        8,
        "Abandoned cart",
        True,
        "realtime",
        None,
        group(ALL, leaf("Cart.cart_subtotal", ">", "5"), leaf("Cart.cart_last_activity", ">", "1")),
    ),
    (9, "Coupon users", True, "realtime", None, group(ALL, leaf("Order.used_coupon", "==", "SAVE1"))),
    (10, "Brand 12", True, "manual", None, group(ALL, leaf("Product.purchased_products", "{}", "Brand#12-"))),
    (11, "Categories", True, "manual", None, group(ALL, leaf("Product.purchased_categories", "==", "10,20"))),
    (12, "Wishful", True, "realtime", None, group(ALL, leaf("Product.wishlist_items_count", ">=", "14"))),
    (13, "Everyone", True, "manual", None, {}),
    (14, "Never written", True, "manual", None, None),
    (15, "Unreadable", True, "manual", None, "{not json"),
    (16, "Switched off", False, "realtime", None, group(ALL, leaf("Order.total_orders", ">=", "1"))),
    (17, "Unknown leaf", True, "manual", None, group(ALL, leaf("Weather.rain", "==", "1"))),
    (18, "Nobody", True, "realtime", None, group(ALL, leaf("Order.total_orders", ">", "100000"))),
    (
        19,
        "Window shoppers",
        True,
        "realtime",
        None,
        group(ALL, leaf("Cart.has_active_cart", "==", "1"), leaf("Product.viewed_categories", "==", "10,20")),
    ),
    (
        20,
        "Card payers with parts",
        True,
        "cron",
        None,
        group(ALL, leaf("Order.payment_method", "()", "card,paypal"), leaf("Cart.cart_products", "{}", "brand#1")),
    ),
]


#: Segments that customers leave as well: by more orders, by other orders, and by time alone.
LIVE: list[tuple[int, str, bool, str, str | None, object]] = [
    (31, "Newcomers", True, "realtime", None, group(ALL, leaf("Order.total_orders", "<", "5"))),
    (32, "Small orders", True, "realtime", None, group(ALL, leaf("Order.average_order_value", "<", "150000"))),
    (33, "Not back since", True, "realtime", None, group(ALL, leaf("Order.last_order_date", "<", "2000-06-01"))),
    (34, "Fresh cart", True, "realtime", None, group(ALL, leaf("Cart.cart_last_activity", "<", "3"))),
    (35, "Week-old cart", True, "realtime", None, group(ALL, leaf("Cart.cart_last_activity", "==", "7"))),
    (
        36,
        "Frequent or forgotten",
        True,
        "realtime",
        None,
        group(
            ANY,
            leaf("Order.total_orders", ">=", "15"),
            group(ALL, leaf("Cart.cart_subtotal", ">", "5"), leaf("Cart.cart_last_activity", ">=", "5")),
        ),
    ),
    (37, "Card payers", True, "realtime", None, group(ALL, leaf("Order.payment_method", "==", "card"), leaf("Order.total_orders", "<=", "8"))),
    (38, "Orders by hand", True, "manual", None, group(ALL, leaf("Order.total_orders", "<", "5"))),
]
DAY_0 = dt.datetime(2024, 1, 26)
RUNS = (dt.datetime(2024, 1, 28, 9, 30), NOW, dt.datetime(2024, 2, 7))


def rule_text(rule: object) -> str | None:
    return rule if rule is None or isinstance(rule, str) else json.dumps(rule)


def segments(spark: SparkSession, *ids: int) -> DataFrame:
    """The first definitions above as a ``segments`` table, or some of all of them."""
    created = dt.datetime(2023, 1, 1)
    rows = [
        (sid, name, None, active, rule_text(rule), mode, schedule, 0, None, created, created)
        for sid, name, active, mode, schedule, rule in (*DEFINITIONS, *LIVE)
        if (sid in ids if ids else sid < LIVE[0][0])
    ]
    return small_table(spark, rows, schemas.SEGMENTS)


def live(spark: SparkSession) -> DataFrame:
    return segments(spark, *[row[0] for row in LIVE])


def one_segment(spark: SparkSession, rule: object, segment_id: int = 1) -> DataFrame:
    created = dt.datetime(2023, 1, 1)
    row = (segment_id, "Probe", None, True, rule_text(rule), "manual", None, 0, None, created, created)
    return small_table(spark, [row], schemas.SEGMENTS)


def catalog(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """A large segment catalogue derived from the products: "Buyers of <sku>"."""
    sku = "concat_ws('-', p_brand, CAST(p_partkey AS STRING))"
    rule = rule_text(group(ALL, leaf("Product.purchased_products", "==", "<sku>")))
    before, after = rule.split("<sku>")
    created = "TIMESTAMP_NTZ '2023-01-01 00:00:00' + make_dt_interval(CAST(p_partkey % 365 AS INT))"
    return parts.selectExpr(
        "CAST(p_partkey + 1000 AS INT) AS segment_id",
        f"concat('Buyers of ', {sku}) AS name",
        "if(p_size > 25, p_name, NULL) AS description",
        "p_partkey % 5 <> 0 AS is_active",
        f"concat('{before}', {sku}, '{after}') AS conditions_serialized",
        "CASE p_size % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'cron' ELSE 'realtime' END AS refresh_mode",
        "CASE p_partkey % 4 WHEN 1 THEN concat('*/5 ', CAST(p_partkey % 24 AS STRING), ' * * *') "
        "WHEN 2 THEN 'no schedule' END AS cron_expression",
        "CAST(floor(p_retailprice) AS BIGINT) AS customer_count",
        f"if(p_partkey % 7 <> 0, {instant_literal(NOW)} - make_dt_interval(0, 0, CAST(p_partkey % 180 AS INT)), NULL) "
        "AS last_refreshed",
        f"{created} AS created_at",
        f"{created} + make_dt_interval(p_size) AS updated_at",
    )
