"""A small random shop, and rules evaluated on it by plain loops."""

from __future__ import annotations

import datetime as dt
import random
from dataclasses import dataclass, field

from cohortry.session import small_table
from cohortry.sources.shop import Shop

NOW = dt.datetime(2024, 3, 1, 12)
DAY = dt.timedelta(days=1)

SCHEMAS = {
    "customer": "customer_id bigint, email string, firstname string, lastname string, dob date, gender int, "
    "taxvat string, website_id int, store_id int, group_id int, created_at timestamp_ntz, default_billing bigint",
    "customer_address": "address_id bigint, postcode string, city string, region string, country_id string",
    "sales_order": "order_id bigint, customer_id bigint, state string, status string, base_grand_total decimal(18,2), "
    "total_qty_ordered decimal(18,2), created_at timestamp_ntz, coupon_code string, payment_method string, "
    "shipping_method string, shipping_country_id string",
    "sales_order_item": "order_id bigint, product_id bigint, sku string, product_type string",
    "category_product": "category_id int, product_id bigint",
    "quote": "quote_id bigint, customer_id bigint, is_active int, subtotal decimal(18,2), items_count int, "
    "updated_at timestamp_ntz",
    "quote_item": "quote_id bigint, sku string, parent_item_id bigint",
    "wishlist": "wishlist_id bigint, customer_id bigint",
    "wishlist_item": "wishlist_id bigint, product_id bigint",
    "product_view": "customer_id bigint, product_id bigint, viewed_at timestamp_ntz",
}


def names(table: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SCHEMAS[table]).names


@dataclass
class SmallShop:
    rows: dict[str, list[tuple]] = field(default_factory=dict)

    def records(self, table: str) -> list[dict]:
        return [dict(zip(names(table), row)) for row in self.rows.get(table, [])]

    def shop(self, spark) -> Shop:
        tables = {name: small_table(spark, self.rows.get(name, []), SCHEMAS[name]) for name in SCHEMAS}
        return Shop(tables, lambda: len(self.rows.get("category_product", [])) + 100, lambda: len(self.rows["sales_order"]))


def random_shop(seed: int, people: int = 40) -> SmallShop:
    """Customer 1 owns about a third of everything; product 1 and order 1 are hot too."""
    rnd = random.Random(seed)

    def maybe(value, chance=0.25):
        return None if rnd.random() < chance else value

    def owner(known=True):
        if rnd.random() < 0.33:
            return 1
        return rnd.randint(0 if known else 1, people + 3)

    def when():
        return dt.datetime(2023, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 600_000))

    def product():
        return 1 if rnd.random() < 0.33 else rnd.randint(1, 12)

    def sku(p):
        return f"Sku-{p}"

    from decimal import Decimal

    def money():
        return Decimal(rnd.randint(0, 30_000)) / 100

    rows: dict[str, list[tuple]] = {}
    rows["customer"] = [
        (
            i,
            f"User{i}@{rnd.choice(['acme', 'Home'])}.example",
            f"First{i % 4}",
            rnd.choice(["O'Neil", "Back\\slash", "Doe, Jr.", 'Q"uote', "$Dollar"]),
            maybe((dt.datetime(1980, 1, 1) + i * 97 * DAY).date()),
            rnd.randint(1, 3),
            maybe(f"VAT{i}"),
            1,
            rnd.randint(1, 4),
            rnd.randint(1, 3),
            dt.datetime(2022, 1, 1) + i * DAY,
            maybe(500 + i),
        )
        for i in range(0, people + 1)
    ]
    orders = range(1, 4 * people)
    rows["sales_order"] = [
        (
            o,
            maybe(owner(), 0.15),
            maybe(rnd.choice(["complete", "processing", "canceled", "closed"]), 0.05),
            rnd.choice(["pending", "complete", "holded"]),
            maybe(money(), 0.05),
            maybe(money(), 0.1),
            when(),
            maybe(rnd.choice(["SAVE1", "SAVE2"]), 0.7),
            rnd.choice(["card", "paypal", "bank"]),
            rnd.choice(["flatrate", "freeshipping"]),
            maybe(rnd.choice(["DE", "FR"])),
        )
        for o in orders
    ]
    rows["sales_order_item"] = []
    for _ in range(12 * people):
        order, p = (1 if rnd.random() < 0.33 else rnd.choice(orders)), product()
        rows["sales_order_item"].append((order, p, sku(p), rnd.choice(["simple", "simple", "bundle"])))
    rows["category_product"] = [(rnd.randint(1, 6), p) for p in range(1, 11) for _ in range(2)]
    quotes = range(1, 3 * people)
    rows["quote"] = [
        (q, maybe(owner(), 0.1), rnd.randint(0, 1), maybe(money(), 0.1), maybe(rnd.randint(0, 9), 0.1), when())
        for q in quotes
    ]
    rows["quote_item"] = [
        ((1 if rnd.random() < 0.33 else rnd.choice(quotes)), sku(product()), maybe(7, 0.7)) for _ in range(6 * people)
    ]
    rows["wishlist"] = [(1000 + i, i) for i in range(0, people + 1, 2)]
    rows["wishlist_item"] = [(1000 + owner(), product()) for _ in range(3 * people)]
    rows["product_view"] = [(owner(), product(), when()) for _ in range(5 * people)]
    return SmallShop(rows)


# -- the same rules by loops ---------------------------------------------------------


def _number(text):
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def _items(value):
    return [str(v).strip() for v in (value if isinstance(value, list) else str(value).split(","))]


def _holds(actual, op, value, kind=lambda v: v):
    """One comparison of a non-NULL scalar."""
    if op == "between":
        low, high = map(kind, _items(value))
        return low <= actual <= high
    if op in ("()", "!()"):
        return (actual in [kind(v) for v in _items(value)]) == (op == "()")
    text, needle = str(actual).lower(), str(value).lower()
    if op in ("{}", "!{}"):
        return (needle in text) == (op == "{}")
    if op == "^=":
        return text.startswith(needle)
    if op == "$=":
        return text.endswith(needle)
    value = kind(value)
    return {
        "==": actual == value,
        "!=": actual != value,
        ">": actual > value,
        "<": actual < value,
        ">=": actual >= value,
        "<=": actual <= value,
    }[op]


class Loops:
    def __init__(self, small: SmallShop, now: dt.datetime = NOW) -> None:
        self.t = {name: small.records(name) for name in SCHEMAS}
        self.now = now

    def members(self, rule: dict) -> set[int]:
        people = [c for c in self.t["customer"] if c["customer_id"] > 0]
        return {c["customer_id"] for c in people if self.tree(rule, c)}

    def tree(self, node, customer) -> bool:
        children = node.get("conditions") or []
        if not children:
            return True
        results = [
            self.tree(child, customer)
            if "Combine" in child["type"]
            else self.leaf(child["type"], child["attribute"], child["operator"], child["value"], customer)
            for child in children
        ]
        return all(results) if node.get("aggregator", "all") == "all" else any(results)

    def orders(self, cid):
        return [
            o
            for o in self.t["sales_order"]
            if o["customer_id"] == cid and o["state"] is not None and o["state"] not in ("canceled", "closed")
        ]

    def cart(self, cid):
        carts = [q for q in self.t["quote"] if q["customer_id"] == cid and q["is_active"] == 1]
        return max(carts, key=lambda q: (q["updated_at"], q["quote_id"]), default=None)

    def leaf(self, family, attribute, op, value, customer) -> bool:
        cid = customer["customer_id"]
        if family == "Customer":
            actual = customer[attribute]
            if actual is None:
                return False
            if attribute == "dob":
                return _holds(actual, op, value, lambda v: dt.datetime.fromisoformat(v).date())
            if attribute == "created_at":
                return _holds(
                    actual, op, value, lambda v: dt.datetime.combine(dt.datetime.fromisoformat(v).date(), dt.time())
                )
            return _holds(actual, op, value, float if isinstance(actual, int) else str)
        orders = self.orders(cid)
        if family == "Order":
            column = {
                "used_coupon": "coupon_code",
                "payment_method": "payment_method",
                "shipping_method": "shipping_method",
                "shipping_country": "shipping_country_id",
                "order_status": "status",
            }.get(attribute)
            if column:
                first = value if op in ("()", "!()") else _items(value)[0]
                return any(o[column] is not None and _holds(o[column], op, first, str) for o in orders)
            totals = [float(o["base_grand_total"]) for o in orders if o["base_grand_total"] is not None]
            items = [float(o["total_qty_ordered"]) for o in orders if o["total_qty_ordered"] is not None]
            dates = [o["created_at"] for o in orders]
            actual = {
                "total_orders": len(orders),
                "total_revenue": round(sum(totals), 2) if totals else None,
                "average_order_value": sum(totals) / len(totals) if totals else None,
                "total_items": round(sum(items), 2) if items else None,
                "first_order_date": min(dates, default=None),
                "last_order_date": max(dates, default=None),
            }[attribute]
            if actual is None:
                return False
            if attribute.endswith("_date"):
                if op in ("==", "!="):
                    return _holds(actual.date(), op, dt.datetime.fromisoformat(value).date())
                return _holds(actual, op, value, dt.datetime.fromisoformat)
            return _holds(float(actual), op, value, float)
        if family == "Cart":
            cart = self.cart(cid)
            if attribute == "has_active_cart":
                return (cart is not None) == (str(value) == "1")
            if attribute == "cart_products":
                if cart is None:
                    return False
                skus = [
                    i["sku"].lower()
                    for i in self.t["quote_item"]
                    if i["quote_id"] == cart["quote_id"] and i["parent_item_id"] is None
                ]
                needle = value.strip().lower()
                return any(_holds(s, op, needle) for s in skus)
            if attribute == "cart_last_activity":
                if cart is None:
                    return False
                actual = int((self.now - cart["updated_at"]).total_seconds() / 86400)
            else:
                column = {"cart_subtotal": "subtotal", "cart_items_count": "items_count"}[attribute]
                actual = float((cart or {}).get(column) or 0)
            return _holds(float(actual), op, value, float)
        if attribute == "wishlist_items_count":
            lists = {w["wishlist_id"] for w in self.t["wishlist"] if w["customer_id"] == cid}
            return _holds(float(sum(i["wishlist_id"] in lists for i in self.t["wishlist_item"])), op, value, float)
        ids = {o["order_id"] for o in orders}
        bought = [i for i in self.t["sales_order_item"] if i["order_id"] in ids]
        if attribute == "purchased_products":
            skus, wanted = [i["sku"] for i in bought if i["product_type"] == "simple"], _items(value)
            if op in ("==", "!="):
                return any((s in wanted) == (op == "==") for s in skus)
            found = [any(w.lower() in s.lower() for w in wanted) for s in skus]
            return any(f == (op == "{}") for f in found)
        products = {i["product_id"] for i in bought}
        if attribute == "viewed_categories":
            products = {v["product_id"] for v in self.t["product_view"] if v["customer_id"] == cid}
        wanted = {int(v) for v in _items(value)}
        links = [c["category_id"] for c in self.t["category_product"] if c["product_id"] in products]
        return any((c in wanted) == (op == "==") for c in links)
