"""The star-schema test tables, seen as a shop.

Pure SQL expressions over the Parquet files; nothing is generated. Every table is lazy,
so a query pays only for the columns and tables it reads.
"""

from __future__ import annotations

from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.joins import lookup_join
from .shop import Shop

ADDRESS_OFFSET = 5_000_000
WISHLIST_OFFSET = 1_000_000
K = "CAST(get_json_object(props, '$.k') AS BIGINT)"
SKU = "concat_ws('-', p_brand, CAST(p_partkey AS STRING))"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(schemas.SOURCE_FILES[table]).parquet(f"{folder}/{table}.parquet")


def row_count(spark: SparkSession, folder: str, table: str) -> int:
    """Rows of a file table, from the Parquet footers; counted once per application."""
    return _row_count(spark.sparkContext.applicationId, folder, table)


@cache
def _row_count(application: str, folder: str, table: str) -> int:
    return read(SparkSession.active(), folder, table).count()


def _located(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with nation and region, NULL where unknown.

    Grouping the places by key lets Catalyst see that they are unique, so plans that use nothing of them drop the join.
    """
    regions = read(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    places = lookup_join(read(spark, folder, "nation"), regions, "n_regionkey", row_count(spark, folder, "region"), "left")
    columns = [F.first(c).alias(c) for c in ("n_regionkey", "n_name", "r_name")]
    places = places.withColumnRenamed("n_nationkey", "c_nationkey").groupBy("c_nationkey").agg(*columns)
    return read(spark, folder, "customer").join(places, "c_nationkey", "left")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return _located(spark, folder).selectExpr(
        "c_custkey AS customer_id",
        "lower(concat(replace(c_name, '#', '.'), '@', c_mktsegment, '.example')) AS email",
        "concat('First', CAST(c_custkey % 50 AS STRING)) AS firstname",
        "c_name AS lastname",
        "if(c_custkey % 11 <> 0, date_add(DATE '1950-01-01', CAST((c_custkey * 37) % 18000 AS INT)), NULL) AS dob",
        "CAST(c_custkey % 3 + 1 AS INT) AS gender",
        "if(c_custkey % 4 <> 0, concat('VAT', CAST(c_custkey AS STRING)), NULL) AS taxvat",
        "n_regionkey + 1 AS website_id",
        "c_nationkey + 1 AS store_id",
        "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 "
        "WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END AS group_id",
        "CAST(date_add(DATE '1995-01-01', CAST(c_custkey % 2000 AS INT)) AS TIMESTAMP_NTZ) AS created_at",
        f"c_custkey + {ADDRESS_OFFSET} AS default_billing",
    )


def customer_addresses(spark: SparkSession, folder: str) -> DataFrame:
    return _located(spark, folder).selectExpr(
        f"c_custkey + {ADDRESS_OFFSET} AS address_id",
        "lpad(CAST(c_custkey % 1000 AS STRING), 5, '0') AS postcode",
        "concat('City', CAST(c_custkey % 20 AS STRING)) AS city",
        "r_name AS region",
        "n_name AS country_id",
    )


def sales_orders(spark: SparkSession, folder: str, raw: DataFrame | None = None) -> DataFrame:
    """All orders, or those of ``raw``, which may be a stream."""
    quantities = (
        read(spark, folder, "lineitem")
        .selectExpr("l_orderkey AS order_id", "CAST(l_quantity AS DECIMAL(18,2)) AS quantity")
        .groupBy("order_id")
        .agg(F.expr("sum(quantity) AS total_qty_ordered"))
    )
    orders = (read(spark, folder, "orders") if raw is None else raw).selectExpr(
        "o_orderkey AS order_id",
        "if(o_custkey <> 0, o_custkey, NULL) AS customer_id",
        "CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'processing' "
        "WHEN o_orderkey % 2 = 0 THEN 'canceled' ELSE 'closed' END AS state",
        "CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderkey % 4 = 1 THEN 'holded' ELSE 'pending' END AS status",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS base_grand_total",
        "o_orderdate AS created_at",
        "if(o_orderkey % 5 = 0, concat('SAVE', CAST(o_orderkey % 3 AS STRING)), NULL) AS coupon_code",
        "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'card' WHEN '2' THEN 'paypal' WHEN '3' THEN 'bank' "
        "WHEN '4' THEN 'cod' WHEN '5' THEN 'gift' END AS payment_method",
        "CASE o_orderkey % 3 WHEN 0 THEN 'flatrate' WHEN 1 THEN 'tablerate' ELSE 'freeshipping' END AS shipping_method",
        "concat('NATION_', CAST(o_orderkey % 25 AS STRING)) AS shipping_country_id",
    )
    return orders.join(quantities, "order_id", "left")


def sales_order_items(spark: SparkSession, folder: str) -> DataFrame:
    parts = read(spark, folder, "part").selectExpr(
        "p_partkey AS product_id",
        f"{SKU} AS sku",
        "if(p_type = 'PROMO', 'bundle', 'simple') AS product_type",
    )
    return lookup_join(item_keys(spark, folder), parts, "product_id", row_count(spark, folder, "part"))


def item_keys(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").selectExpr("l_orderkey AS order_id", "l_partkey AS product_id")


def category_products(spark: SparkSession, folder: str) -> DataFrame:
    """Two categories per product: one by size, one by brand."""
    brand = "100 + CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT)"
    return read(spark, folder, "part").selectExpr(
        f"explode(array(p_size, {brand})) AS category_id", "p_partkey AS product_id"
    )


_IS_CART = "event_type IN ('click', 'purchase')"


def _cart_events(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").where(_IS_CART)


def quotes(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """All carts, or those of ``events``, which may be a stream."""
    return (_cart_events(spark, folder) if events is None else events.where(_IS_CART)).selectExpr(
        "event_id AS quote_id",
        "user_id AS customer_id",
        "CAST(event_type = 'click' AS INT) AS is_active",
        "CAST(value AS DECIMAL(18,2)) AS subtotal",
        f"CAST({K} % 7 AS INT) AS items_count",
        "ts AS updated_at",
    )


def quote_items(spark: SparkSession, folder: str) -> DataFrame:
    carts = _cart_events(spark, folder).selectExpr("event_id AS quote_id", f"{K} AS product_id")
    parts = read(spark, folder, "part").selectExpr("p_partkey AS product_id", f"{SKU} AS sku")
    top = lookup_join(carts, parts, "product_id", row_count(spark, folder, "part")).selectExpr(
        "quote_id", "sku", "CAST(NULL AS BIGINT) AS parent_item_id"
    )
    children = carts.where("quote_id % 3 = 0").selectExpr(
        "quote_id", "concat('CHILD-', CAST(product_id AS STRING)) AS sku", "1L AS parent_item_id"
    )
    return top.unionByName(children)


def _wishes(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").where("event_type = 'signup'")


def wishlists(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _wishes(spark, folder)
        .selectExpr(f"user_id + {WISHLIST_OFFSET} AS wishlist_id", "user_id AS customer_id")
        .distinct()
    )


def wishlist_items(spark: SparkSession, folder: str) -> DataFrame:
    return _wishes(spark, folder).selectExpr(f"user_id + {WISHLIST_OFFSET} AS wishlist_id", f"{K} AS product_id")


def product_views(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read(spark, folder, "events")
        .where("event_type = 'view'")
        .selectExpr("user_id AS customer_id", f"{K} AS product_id", "ts AS viewed_at")
    )


def shop(spark: SparkSession, folder: str) -> Shop:
    builders = {
        "customer": customers,
        "customer_address": customer_addresses,
        "sales_order": sales_orders,
        "sales_order_item": sales_order_items,
        "item_keys": item_keys,
        "category_product": category_products,
        "quote": quotes,
        "quote_item": quote_items,
        "wishlist": wishlists,
        "wishlist_item": wishlist_items,
        "product_view": product_views,
    }
    return Shop(
        {name: partial(build, spark, folder) for name, build in builders.items()},
        count_catalog=lambda: row_count(spark, folder, "part"),
        count_orders=lambda: row_count(spark, folder, "orders"),
        count_items=lambda: row_count(spark, folder, "lineitem"),
    )
