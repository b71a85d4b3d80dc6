"""The per-customer feature table: one row per customer, only the columns asked for.

Every fact table is read once, whatever the number of segments. EXISTS leaves are
aggregates beside the sums (see ``flags``), and rows that satisfy no leaf are filtered
out before the shuffle where nothing else needs them. All aggregations on the
way combine map-side, so a customer, order, cart or category that owns a third of all
rows still reaches the shuffle as one row per map task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import any_of, instant_literal, text_literal
from ..sources.shop import Shop, latest_carts, population, top_level_items, valid_orders
from .flags import Feature, Flags
from .joins import lookup_join


# Sums are exact decimals, so they do not depend on the order of the rows.
_REVENUE = "CAST(sum(CAST(base_grand_total AS DECIMAL(18,2))) AS DOUBLE)"
ORDER_AGGREGATES = {
    "total_orders": "count(*)",
    "total_revenue": _REVENUE,
    "average_order_value": f"{_REVENUE} / count(base_grand_total)",
    "total_items": "CAST(sum(CAST(total_qty_ordered AS DECIMAL(18,2))) AS DOUBLE)",
    "first_order_date": "min(created_at)",
    "last_order_date": "max(created_at)",
}
ORDER_FEATURES = {
    name: Feature(name, "orders", default="0" if name == "total_orders" else None) for name in ORDER_AGGREGATES
}
CART_FEATURES = {
    "cart_subtotal": Feature("cart_subtotal", "cart", default="0D"),
    "cart_items_count": Feature("cart_items_count", "cart", default="0"),
    "cart_last_activity": Feature("cart_last_activity", "cart"),
    "has_active_cart": Feature("has_active_cart", "cart", default="false"),
}
CART_MOMENT = Feature("cart_updated_at", "cart")  # what the age of a cart is counted from
WISHLIST_COUNT = Feature("wishlist_items_count", "wishlist", default="0")


class Wanted:
    """The requested features, by the fact they come from."""

    def __init__(self, features: Iterable[Feature]) -> None:
        distinct = {feature.name: feature for feature in features}
        self.features = [distinct[name] for name in sorted(distinct)]
        self.by_source: dict[str, list[Feature]] = {}
        for feature in self.features:
            self.by_source.setdefault(feature.source, []).append(feature)
        self.order_rows = self._flags("order_rows")
        self.order_items = self._flags("order_items")
        self.order_categories = self._flags("order_categories")
        self.cart_items = self._flags("cart_items")
        self.view_categories = self._flags("view_categories")

    def _flags(self, source: str) -> Flags:
        return Flags(self.by_source.get(source, []))

    def of(self, source: str) -> list[Feature]:
        return self.by_source.get(source, [])

    @property
    def order_aggregates(self) -> dict[str, str]:
        return {feature.name: ORDER_AGGREGATES[feature.name] for feature in self.of("orders")}

    @property
    def readings(self) -> dict[str, str]:
        parts = (self.order_rows, self.order_items, self.order_categories, self.cart_items, self.view_categories)
        return {name: reading for flags in parts for name, reading in flags.readings().items()}


def category_flags(shop: Shop, flags: Flags) -> DataFrame:
    """Per product: is some category of it wanted? Products with no flag are left out."""
    links = flags.prepare(shop.category_product).where(flags.raised_by_row())
    return links.groupBy("product_id").agg(*flags.aggregates()).where(flags.raised())


def _flagged_orders(shop: Shop, skus: Flags, categories: Flags) -> DataFrame:
    """Per order: which item-level leaves does some item satisfy?"""
    items = skus.prepare(shop.sales_order_item) if skus else shop.item_keys
    hits = [skus.raised_by_row()] if skus else []
    if categories:
        flagged = category_flags(shop, categories)
        how = "left" if skus else "inner"
        items = lookup_join(items, flagged, "product_id", shop.catalog_rows, how, shop.item_keys, repeats=False)
        hits.append(categories.raised())
    return items.where(any_of(hits)).groupBy("order_id").agg(*skus.aggregates(), *categories.merged())


def order_facts(shop: Shop, wanted: Wanted, aggregates: dict[str, str] | None = None) -> DataFrame:
    """One row per customer: the wanted order aggregates, or ``aggregates`` in their place, and the flags."""
    totals, history = wanted.of("orders"), wanted.order_rows
    skus, categories = wanted.order_items, wanted.order_categories
    orders = history.prepare(valid_orders(shop.sales_order))
    if skus or categories:
        # order_id is unique on both sides here, so this join cannot be skewed.
        how = "left" if totals or history else "inner"
        orders = orders.join(_flagged_orders(shop, skus, categories), "order_id", how)
    elif history and not totals:
        orders = orders.where(history.raised_by_row())
    return orders.groupBy("customer_id").agg(
        *[F.expr(f"{test} AS {name}") for name, test in (aggregates or wanted.order_aggregates).items()],
        *history.aggregates(),
        *skus.merged(),
        *categories.merged(),
    )


def order_summary(shop: Shop) -> DataFrame:
    """All order aggregates of the customers that have valid orders."""
    return order_facts(shop, Wanted(ORDER_FEATURES.values()))


def purchased_item_counts(shop: Shop, test: str) -> DataFrame:
    """Valid-order items per customer that satisfy a row-level test.

    Counted per order first: the join to the orders is one row to one row.
    """
    per_order = shop.sales_order_item.where(test).groupBy("order_id").agg(F.expr("count(*) AS items"))
    orders = valid_orders(shop.sales_order).select("order_id", "customer_id")
    return orders.join(per_order, "order_id").groupBy("customer_id").agg(F.expr("sum(items) AS purchased_items"))


def order_products(shop: Shop) -> DataFrame:
    """(order_id, product_id, customer_id, created_at) of the items of valid orders; a product may come several times.

    An order may hold very many products, so its rows are spread over the join.
    """
    orders = valid_orders(shop.sales_order).select("order_id", "customer_id", "created_at")
    return lookup_join(shop.item_keys, orders, "order_id", shop.order_rows, keys=shop.item_keys)


def distinct_products(shop: Shop, category_test: str) -> DataFrame:
    """Distinct purchased products per customer with some matching category link.

    The links become one row per product before the join, and the distinct count is
    exact: Spark shuffles on (customer, product) first, then adds up per customer.
    """
    linked = shop.category_product.where(category_test).select("product_id").distinct()
    bought = lookup_join(
        order_products(shop), linked, "product_id", shop.catalog_rows, "left_semi", shop.item_keys, repeats=False
    )
    return bought.groupBy("customer_id").agg(F.expr("count(DISTINCT product_id) AS distinct_products"))


def flagged_carts(shop: Shop, flags: Flags, how: str) -> DataFrame:
    """The latest cart of each customer, with the flags its items raise."""
    carts = latest_carts(shop.quote)
    if not flags:
        return carts
    items = flags.prepare(top_level_items(shop.quote_item)).where(flags.raised_by_row())
    return carts.join(items.groupBy("quote_id").agg(*flags.aggregates()), "quote_id", how)


def cart_readings(wanted: Wanted, now: dt.datetime) -> list[str]:
    """The wanted cart features over the columns of a latest cart."""
    columns = {
        "cart_subtotal": "coalesce(CAST(subtotal AS DOUBLE), 0D)",
        "cart_items_count": "coalesce(items_count, 0)",
        # whole days, cut towards zero
        "cart_last_activity": f"CAST(timestampdiff(SECOND, updated_at, {instant_literal(now)}) / 86400 AS INT)",
        CART_MOMENT.name: "updated_at",
        "has_active_cart": "true",
    }
    return [f"{columns[feature.name]} AS {feature.name}" for feature in wanted.of("cart")]


def _cart_facts(shop: Shop, wanted: Wanted, now: dt.datetime) -> DataFrame:
    carts = flagged_carts(shop, wanted.cart_items, "left" if wanted.of("cart") else "inner")
    return carts.selectExpr("customer_id", *cart_readings(wanted, now), *wanted.cart_items.columns)


def wishlist_counts(shop: Shop) -> DataFrame:
    """Items are counted per wishlist first, so the join is one row to one row."""
    per_list = shop.wishlist_item.groupBy("wishlist_id").agg(F.expr("count(*) AS items"))
    lists = shop.wishlist.join(per_list, "wishlist_id")
    return lists.groupBy("customer_id").agg(F.expr("sum(items) AS wishlist_items_count"))


def view_facts(shop: Shop, flags: Flags) -> DataFrame:
    views = shop.product_view.select("customer_id", "product_id")
    seen = lookup_join(views, category_flags(shop, flags), "product_id", shop.catalog_rows, repeats=False)
    return seen.groupBy("customer_id").agg(*flags.merged())


def _one_row_each(facts: DataFrame, source: str) -> DataFrame:
    """The facts, or an error when read: two rows of one customer would make it a member twice."""
    columns = [F.first(c).alias(c) for c in facts.columns if c != "customer_id"]
    each = facts.where("customer_id IS NOT NULL").groupBy("customer_id").agg(F.expr("count(*) AS __rows"), *columns)
    problem = text_literal(f"{source} has several rows for one customer")
    return each.where(f"if(__rows = 1, true, raise_error({problem}))").drop("__rows")


def feature_table(
    shop: Shop,
    features: Iterable[Feature],
    now: dt.datetime,
    custom: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """``customer_id`` plus one column per feature, for the whole population."""
    wanted = Wanted(features)
    table = population(shop.customer).select("customer_id", *[feature.name for feature in wanted.of("customer")])
    return assembled(table, wanted, [*fact_tables(shop, wanted, now), *custom_facts(wanted, custom)], [wanted])


def fact_tables(shop: Shop, wanted: Wanted, now: dt.datetime) -> list[DataFrame]:
    """Per kind of fact that is wanted a table with one row per customer."""
    sources = wanted.by_source.keys()
    facts: list[DataFrame] = []
    if sources & {"orders", "order_rows", "order_items", "order_categories"}:
        facts.append(order_facts(shop, wanted))
    if sources & {"cart", "cart_items"}:
        facts.append(_cart_facts(shop, wanted, now))
    if "wishlist" in sources:
        facts.append(wishlist_counts(shop))
    if wanted.view_categories:
        facts.append(view_facts(shop, wanted.view_categories))
    return facts


def custom_facts(wanted: Wanted, custom: dict[str, DataFrame] | None) -> list[DataFrame]:
    """The facts of conditions that a user registered, as far as they are wanted."""
    found = []
    for source in sorted(wanted.by_source):
        if source.startswith("custom:"):
            columns = [feature.name for feature in wanted.of(source)]
            found.append(_one_row_each((custom or {})[source].select("customer_id", *columns), source))
    return found


def assembled(table: DataFrame, wanted: Wanted, facts: list[DataFrame], carriers: list[Wanted]) -> DataFrame:
    """Customers with their own attributes, and facts of one row per customer: the feature table.

    ``carriers`` say in which columns the facts carry the flags.
    """
    # Every fact table is already hash-partitioned by customer_id after its
    # aggregation, so these joins add one exchange: that of the population.
    for fact in facts:
        table = table.join(fact, "customer_id", "left")

    readings = {name: reading for carrier in carriers for name, reading in carrier.readings.items()}
    columns = {feature.name: readings.get(feature.name, feature.name) for feature in wanted.features}
    for feature in wanted.features:
        if feature.default is not None:
            columns[feature.name] = f"coalesce({columns[feature.name]}, {feature.default})"
    return table.selectExpr("customer_id", *[f"{reading} AS {name}" for name, reading in columns.items()])
