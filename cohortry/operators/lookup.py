"""Questions about stored memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import number_literal
from ..sources.shop import Shop, population
from .lifecycle import Page, page_of
from .joins import lookup_join
from .membership import KEYS

BROADCAST_PAGE = 100_000


def customers_in_segment(customers: DataFrame, members: DataFrame, segment_id: int) -> DataFrame:
    chosen = members.where(f"segment_id = {int(segment_id)}")
    return customers.join(chosen, "customer_id", "left_semi")


def export_members(shop: Shop, members: DataFrame, segment_id: int) -> DataFrame:
    """The member rows of an export; nothing is collected."""
    return customers_in_segment(population(shop.customer), members, segment_id).selectExpr(
        "customer_id", "email", "firstname AS first_name", "lastname AS last_name", "created_at"
    )


def matched_customers(shop: Shop, members: DataFrame, segment_id: int, page: int = 1, size: int = 20) -> Page:
    """One page of a segment's members with their billing address.

    The page is cut before the address join, and the addresses are reduced to those of the page (``size`` ids are
    broadcast) before they are shuffled.
    """
    chosen = customers_in_segment(population(shop.customer), members, segment_id)
    people = chosen.select("customer_id", "firstname", "lastname", "email", "default_billing", "created_at")
    found = page_of(people, "customer_id", page, size)
    address = shop.customer_address.selectExpr(
        "address_id AS default_billing",
        "postcode AS billing_postcode",
        "city AS billing_city",
        "region AS billing_region",
        "country_id AS billing_country_id",
    )
    wanted = found.rows.select("default_billing")
    address = address.join(F.broadcast(wanted) if size <= BROADCAST_PAGE else wanted, "default_billing", "left_semi")
    rows = found.rows.join(address, "default_billing", "left").selectExpr(
        "customer_id",
        "concat_ws(' ', firstname, lastname) AS name",
        "email",
        "billing_postcode",
        "billing_city",
        "billing_region",
        "billing_country_id",
        "created_at",
    )
    return Page(rows, found.total)


def customer_segments(members: DataFrame, segments: DataFrame) -> DataFrame:
    """Each customer's segments; memberships of deleted segments are left out.

    A segment of nearly everyone is one hot key; the definitions are counted, and broadcast or spread accordingly.
    """
    known = segments.select("segment_id", "name", "description")
    return lookup_join(members, known, "segment_id", known.count()).select("customer_id", "segment_id", "name", "description")


def membership_check(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """For distinct (customer_id, segment_id) pairs: is the customer in the segment?"""
    held = members.selectExpr(*KEYS, "true AS in_segment")
    asked = pairs.select(*KEYS).distinct()
    return asked.join(held, KEYS, "left").selectExpr(*KEYS, "coalesce(in_segment, false) AS in_segment")


def segment_profile(members: DataFrame, features: DataFrame, high_value: float) -> DataFrame:
    """Order metrics per segment, to compare segments and find high-value groups.

    ``features`` needs total_orders, total_revenue and total_items. The sums combine
    map-side, so a segment that holds most customers is no hot group.
    """
    # exact sums; the casts run once per customer, below the join
    per_customer = features.selectExpr(
        "customer_id",
        "total_orders",
        "CAST(coalesce(total_revenue, 0D) AS DECIMAL(38,2)) AS revenue",
        "CAST(coalesce(total_items, 0D) AS DECIMAL(38,2)) AS items",
        f"total_revenue >= {number_literal(high_value)} AS high_value",
    )
    joined = members.join(per_customer, "customer_id")
    metrics = {
        "customers": "count(*)",
        "orders": "sum(total_orders)",
        "revenue": "CAST(sum(revenue) AS DOUBLE)",
        "items": "CAST(sum(items) AS DOUBLE)",
        "high_value_customers": "count_if(high_value)",
    }
    totals = joined.groupBy("segment_id").agg(*[F.expr(f"{metric} AS {name}") for name, metric in metrics.items()])
    return totals.selectExpr(
        "*",
        "revenue / customers AS revenue_per_customer",
        "if(orders > 0, revenue / orders, NULL) AS revenue_per_order",
    )
