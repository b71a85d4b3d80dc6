"""Partial facts: what is known of a customer's orders and carts, in a form that can be added up.

A row of partial facts stands for some facts of one customer. Rows of disjoint facts merge into one by sums, minima,
maxima and bit-wise or, so new facts are added without reading the old ones. Nothing can be taken back: a minimum does
not know what came second. Where a fact ceases to count, the customer's rows are computed again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shop import Shop, population
from .features import Feature, Wanted, assembled, cart_readings, custom_facts, fact_tables, flagged_carts, order_facts

_SUM = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DECIMAL(38,2))"
# name -> (over orders, how rows merge)
ORDER_PARTS = {
    "__orders": ("count(*)", "sum"),
    "__revenue": (_SUM.format("base_grand_total"), "sum"),
    "__priced": ("count(base_grand_total)", "sum"),
    "__items": (_SUM.format("total_qty_ordered"), "sum"),
    "__first": ("min(created_at)", "min"),
    "__last": ("max(created_at)", "max"),
}
ORDER_READINGS = {
    "total_orders": "__orders",
    "total_revenue": "CAST(__revenue AS DOUBLE)",
    "average_order_value": "CAST(__revenue AS DOUBLE) / __priced",
    "total_items": "CAST(__items AS DOUBLE)",
    "first_order_date": "__first",
    "last_order_date": "__last",
}
_CART = "__cart"
_CART_COLUMNS = ("updated_at", "quote_id", "subtotal", "items_count")  # newest first: the order carts are compared in

#: Kinds of facts that can be kept, and the sources of features that they cover. Category links change without an order,
#: so what follows from them is not kept.
KINDS = {"orders": ("orders", "order_rows", "order_items"), "carts": ("cart", "cart_items")}


def kept_features(features: Iterable[Feature], kinds: Iterable[str]) -> list[Feature]:
    sources = {source for kind in kinds for source in KINDS[kind]}
    return [feature for feature in features if feature.source in sources]


def partial_facts(shop: Shop, kept: Wanted) -> DataFrame:
    """Rows of partial facts over the facts of ``shop``: at most one per customer and kind of fact."""
    sources = kept.by_source.keys()
    parts = []
    if sources & set(KINDS["orders"]):
        parts.append(order_facts(shop, kept, {name: test for name, (test, _) in ORDER_PARTS.items()}))
    if sources & set(KINDS["carts"]):
        carts = flagged_carts(shop, kept.cart_items, "left")
        parts.append(carts.select("customer_id", F.struct(*_CART_COLUMNS, *kept.cart_items.columns).alias(_CART)))
    if not parts:
        return shop.customer.select("customer_id").where("false")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merged(rows: DataFrame, kept: Wanted) -> DataFrame:
    """One row of partial facts per customer."""
    merges: list[Column] = [merge for flags in (kept.order_rows, kept.order_items) if flags for merge in flags.merged()]
    if "__orders" in rows.columns:
        for name, (test, how) in ORDER_PARTS.items():
            merge = f"CAST({how}({name}) AS DECIMAL(38,2))" if "DECIMAL(38,2)" in test else f"{how}({name})"
            merges.append(F.expr(f"{merge} AS {name}"))
    if _CART in rows.columns:
        merges.append(F.expr(f"max({_CART}) AS {_CART}"))
    return rows.groupBy("customer_id").agg(*merges) if merges else rows.select("customer_id").distinct()


def feature_table_of(
    shop: Shop,
    parts: DataFrame,
    kept: Wanted,
    features: Iterable[Feature],
    now: dt.datetime,
    custom: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """What ``feature_table`` gives, with merged partial facts in place of the facts they were made of.

    The customers, and the facts that are not kept, are those of ``shop``.
    """
    wanted = Wanted(features)
    columns = ["customer_id", *kept.order_rows.columns, *kept.order_items.columns]
    columns += [f"{ORDER_READINGS[feature.name]} AS {feature.name}" for feature in kept.of("orders")]
    # a customer without a cart has no facts about it, not even that there is none
    pairs = (reading.rsplit(" AS ", 1) for reading in cart_readings(kept, now))
    columns += [f"if({_CART} IS NULL, NULL, {reading}) AS {name}" for reading, name in pairs]
    columns += [f"{_CART}.{name} AS {name}" for name in kept.cart_items.columns]
    cart = [f"{_CART}.{name} AS {name}" for name in _CART_COLUMNS] if kept.of("cart") else []
    known = parts.selectExpr("*", *cart).selectExpr(*columns)
    own = {feature.name for feature in kept.features}
    rest = [feature for feature in wanted.features if feature.name not in own]
    table = population(shop.customer).select("customer_id", *[feature.name for feature in wanted.of("customer")])
    return assembled(table, wanted, [known, *fact_tables(shop, Wanted(rest), now), *custom_facts(wanted, custom)], [kept, Wanted(rest)])
