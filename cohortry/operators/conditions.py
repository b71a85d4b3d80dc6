"""Rule leaves: (family, attribute) -> features needed and a predicate on them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compare as cmp
from ..functions.values import RuleError, as_text
from .features import CART_FEATURES, CART_MOMENT, ORDER_FEATURES, WISHLIST_COUNT, Feature

Comparison = Callable[[str, str, object], str]

# Only simple products count as purchased; others have no SKU here, and NULL matches nothing.
SIMPLE_SKU = "if(product_type = 'simple', sku, NULL)"


@dataclass(frozen=True)
class Leaf:
    """A compiled leaf: a SQL predicate over feature columns; NULL means no match.

    Rules combine leaves by AND and OR only, where NULL and false lead to the same
    members, so NULL need not be folded and plain comparisons can reach the scan.
    ``flips`` are SQL instants at which time alone may change the answer, over ``moments``.
    """

    features: tuple[Feature, ...]
    predicate: str
    moments: tuple[Feature, ...] = ()
    flips: tuple[str, ...] = ()


Builder = Callable[[str, object], Leaf]


def _check(op: str, accepted: tuple[str, ...], attribute: str) -> None:
    if op not in accepted:
        raise RuleError(f"operator {op!r} does not apply to {attribute}")


def _on_feature(feature: Feature, comparison: Comparison, accepted: tuple[str, ...]) -> Builder:
    def build(op: str, value: object) -> Leaf:
        _check(op, accepted, feature.name)
        return Leaf((feature,), comparison(feature.name, op, value))

    return build


def _on_age(feature: Feature, moment: Feature) -> Builder:
    """A number of days since ``moment``."""

    def build(op: str, value: object) -> Leaf:
        _check(op, cmp.ORDERING, feature.name)
        flips = tuple(cmp.reached_at(moment.name, age) for age in cmp.age_steps(op, value))
        return Leaf((feature,), cmp.compare_number(feature.name, op, value), (moment,) if flips else (), flips)

    return build


def _on_rows(
    attribute: str, source: str, column: str, comparison: Comparison, accepted: tuple[str, ...]
) -> Builder:
    """EXISTS over fact rows: the comparison runs on rows, a flag column reaches the rule.

    The flag is named after the test, so equal leaves of different segments share it.
    """

    def build(op: str, value: object) -> Leaf:
        _check(op, accepted, attribute)
        test = comparison(column, op, value)
        name = f"{attribute}__{hashlib.sha1(test.encode()).hexdigest()[:16]}"
        key, values = cmp.listed_values(comparison, column, op, value)
        return Leaf((Feature(name, source, test, "false", key, values),), name)

    return build


def _has_cart(op: str, value: object) -> Leaf:
    """The operator plays no part; only 1 / true asks for customers with a cart."""
    feature = CART_FEATURES["has_active_cart"]
    return Leaf((feature,), feature.name if as_text(value) == "1" else f"NOT {feature.name}")


def _builders() -> dict[tuple[str, str], Builder]:
    table: dict[tuple[str, str], Builder] = {}

    def customer(comparison: Comparison, *attributes: str) -> None:
        for attribute in attributes:
            feature = Feature(attribute, "customer")
            table["Customer", attribute] = _on_feature(feature, comparison, cmp.ALL_OPERATORS)

    customer(cmp.compare_text, "email", "firstname", "lastname", "taxvat")
    customer(cmp.compare_code, "gender", "website_id", "store_id", "group_id")
    customer(cmp.compare_day, "dob")
    customer(cmp.compare_at_midnight, "created_at")

    ranged = (*cmp.ORDERING, cmp.BETWEEN)
    for name, feature in ORDER_FEATURES.items():
        comparison = cmp.compare_order_date if name.endswith("_date") else cmp.compare_number
        table["Order", name] = _on_feature(feature, comparison, ranged)
    listed = (cmp.EQ, cmp.NEQ, cmp.IN, cmp.NOT_IN, cmp.CONTAINS, cmp.NOT_CONTAINS)
    for attribute, column in {
        "used_coupon": "coupon_code",
        "payment_method": "payment_method",
        "shipping_method": "shipping_method",
        "shipping_country": "shipping_country_id",
        "order_status": "status",
    }.items():
        table["Order", attribute] = _on_rows(attribute, "order_rows", column, cmp.compare_order_text, listed)

    for name in ("cart_subtotal", "cart_items_count"):
        table["Cart", name] = _on_feature(CART_FEATURES[name], cmp.compare_number, cmp.ORDERING)
    table["Cart", "cart_last_activity"] = _on_age(CART_FEATURES["cart_last_activity"], CART_MOMENT)
    skus = (cmp.EQ, cmp.NEQ, cmp.CONTAINS, cmp.NOT_CONTAINS)
    table["Cart", "cart_products"] = _on_rows("cart_products", "cart_items", "sku", cmp.compare_cart_sku, skus)
    table["Cart", "has_active_cart"] = _has_cart

    table["Product", "wishlist_items_count"] = _on_feature(WISHLIST_COUNT, cmp.compare_number, ranged)
    table["Product", "purchased_products"] = _on_rows(
        "purchased_products", "order_items", SIMPLE_SKU, cmp.compare_sku_list, skus
    )
    for attribute, source in {
        "purchased_categories": "order_categories",
        "viewed_categories": "view_categories",
    }.items():
        table["Product", attribute] = _on_rows(
            attribute, source, "category_id", cmp.compare_category, (cmp.EQ, cmp.NEQ)
        )
    return table


class ConditionRegistry:
    """The leaves a rule may use: the built-in ones plus those a user registers."""

    def __init__(self) -> None:
        self._builders = _builders()
        self.facts: dict[str, DataFrame] = {}

    def attributes(self, family: str) -> list[str]:
        return [name for owner, name in self._builders if owner == family]

    def register(
        self,
        family: str,
        attribute: str,
        facts: DataFrame,
        predicate: Callable[[str, object], str],
        columns: tuple[str, ...],
        defaults: dict[str, str] | None = None,
        flips: Callable[[str, object], tuple[str, ...]] | None = None,
    ) -> None:
        """Add a leaf of your own.

        ``facts`` holds at most one row per ``customer_id`` and the given ``columns``;
        ``predicate(op, value)`` returns a SQL predicate over them (see ``compare``).
        NULL counts as no match. ``defaults`` are SQL literals for customers without facts. Where the predicate looks
        at the time, ``flips(op, value)`` returns SQL instants over the columns at which its answer may change.
        """
        source = f"custom:{family}.{attribute}"
        self.facts[source] = facts
        features = tuple(Feature(c, source, default=(defaults or {}).get(c)) for c in columns)

        def build(op: str, value: object) -> Leaf:
            instants = flips(op, value) if flips else ()
            return Leaf(features, predicate(op, value), features if instants else (), tuple(instants))

        self._builders[family, attribute] = build

    def register_rows(
        self,
        family: str,
        attribute: str,
        rows: DataFrame,
        aggregates: Mapping[str, str],
        predicate: Callable[[str, object], str],
        defaults: dict[str, str] | None = None,
        flips: Callable[[str, object], tuple[str, ...]] | None = None,
    ) -> None:
        """Add a leaf over facts of any number of rows per ``customer_id``.

        ``aggregates`` are SQL aggregates by name, the columns that ``predicate`` compares ("count(*)", "max(ts)",
        "sum(if(kind = 'return', amount, 0))"); own functions must merge, as Spark's do. Equal partial results are
        combined before the shuffle, so a customer with a third of all rows is one row per map task. Rows without a
        customer are left out; customers without rows have the ``defaults``, else NULL.
        """
        known = rows.where("customer_id IS NOT NULL")
        facts = known.groupBy("customer_id").agg(*[F.expr(f"{test} AS `{name}`") for name, test in aggregates.items()])
        self.register(family, attribute, facts, predicate, tuple(aggregates), defaults, flips)

    def leaf(self, family: str, attribute: str, op: str, value: object) -> Leaf:
        try:
            build = self._builders[family, attribute]
        except KeyError:
            raise RuleError(f"unknown condition {family}.{attribute}") from None
        return build(op, value)
