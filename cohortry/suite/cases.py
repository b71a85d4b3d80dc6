"""Leaf cases: what a rule leaf says, and the SQL predicate that must agree with it.

Every case runs over the whole population. The SQL side is written by hand against the
common table expressions of ``oracle.py``; it shares no code with the engine.
"""

from __future__ import annotations

from ..plans.rules import group, leaf

# key -> [(leaf path, operator, value, SQL predicate over feat)]
Case = tuple[str, str, object, str]


def _some_order(test: str) -> str:
    return f"customer_id IN (SELECT customer_id FROM vo WHERE {test})"


def _some_item(test: str) -> str:
    return (
        "customer_id IN (SELECT vo.customer_id FROM vo JOIN soi ON vo.order_id = soi.order_id "
        f"WHERE soi.product_type = 'simple' AND {test})"
    )


def _some_category(test: str) -> str:
    return (
        "customer_id IN (SELECT vo.customer_id FROM vo JOIN soi ON vo.order_id = soi.order_id "
        f"JOIN cp ON cp.product_id = soi.product_id WHERE {test})"
    )


def _some_view(test: str) -> str:
    return (
        "customer_id IN (SELECT pv.customer_id FROM pv JOIN cp ON cp.product_id = pv.product_id "
        f"WHERE {test})"
    )


def _some_cart_sku(test: str) -> str:
    return (
        "customer_id IN (SELECT lc.customer_id FROM lc JOIN qi ON qi.quote_id = lc.quote_id "
        f"WHERE qi.parent_item_id IS NULL AND {test})"
    )


CASES: dict[str, list[Case]] = {
    # comparison operators
    "cmp_eq": [
        ("Customer.lastname", "==", "Customer#000000007", "lastname = 'Customer#000000007'"),
        ("Customer.group_id", "==", "3", "group_id = 3"),
        ("Customer.dob", "==", "1950-02-07", "dob = DATE '1950-02-07'"),
        ("Order.total_orders", "==", 7, "total_orders = 7"),
    ],
    "cmp_neq": [
        ("Customer.taxvat", "!=", "VAT1", "taxvat <> 'VAT1'"),
        ("Customer.group_id", "!=", "3", "group_id <> 3"),
        ("Order.total_orders", "!=", "7", "total_orders <> 7"),
    ],
    "cmp_gt": [
        ("Customer.created_at", ">", "1996-05-05", "created_at > TIMESTAMP '1996-05-05'"),
        ("Customer.email", ">", "customer.0000005", "email > 'customer.0000005'"),
        ("Order.total_revenue", ">", "2000000", "total_revenue > 2000000"),
    ],
    "cmp_lt": [
        ("Customer.dob", "<", "1970-01-01", "dob < DATE '1970-01-01'"),
        ("Customer.store_id", "<", "5", "store_id < 5"),
        ("Order.total_items", "<", "100", "total_items < 100"),
    ],
    "cmp_gte": [
        ("Customer.dob", ">=", "1970-01-01", "dob >= DATE '1970-01-01'"),
        ("Customer.website_id", ">=", 3, "website_id >= 3"),
        ("Order.total_orders", ">=", "10", "total_orders >= 10"),
    ],
    "cmp_lte": [
        ("Customer.created_at", "<=", "1996-05-05 13:00:00", "created_at <= TIMESTAMP '1996-05-05'"),
        ("Customer.firstname", "<=", "First3", "firstname <= 'First3'"),
        ("Order.average_order_value", "<=", "250000", "average_order_value <= 250000"),
    ],
    "cmp_contains": [
        ("Customer.email", "{}", "@HouseHold", "contains(email, '@household')"),
        ("Customer.taxvat", "{}", "vat12", "contains(lower(taxvat), 'vat12')"),
        ("Customer.store_id", "{}", "1", "contains(CAST(store_id AS VARCHAR), '1')"),
        ("Customer.dob", "{}", "1950-02-07", "dob = DATE '1950-02-07'"),
    ],
    "cmp_not_contains": [
        ("Customer.email", "!{}", "@household", "NOT contains(email, '@household')"),
        ("Customer.taxvat", "!{}", "1", "NOT contains(taxvat, '1')"),
    ],
    "cmp_starts_with": [
        ("Customer.firstname", "^=", "first1", "starts_with(lower(firstname), 'first1')"),
        ("Customer.taxvat", "^=", "VAT9", "starts_with(taxvat, 'VAT9')"),
    ],
    "cmp_ends_with": [
        ("Customer.email", "$=", "machinery.EXAMPLE", "suffix(email, 'machinery.example')"),
        ("Customer.lastname", "$=", "00", "suffix(lastname, '00')"),
    ],
    "cmp_in": [
        ("Customer.group_id", "()", "1, 4", "group_id IN (1, 4)"),
        ("Customer.firstname", "()", ["First1", " First2 "], "firstname IN ('First1', 'First2')"),
        ("Customer.dob", "()", "1950-02-07,1950-03-16", "dob IN (DATE '1950-02-07', DATE '1950-03-16')"),
    ],
    "cmp_not_in": [
        ("Customer.store_id", "!()", [1, 2, 3], "store_id NOT IN (1, 2, 3)"),
        ("Customer.taxvat", "!()", "VAT1,VAT2", "taxvat NOT IN ('VAT1', 'VAT2')"),
    ],
    "cmp_between": [
        ("Customer.dob", "between", "1960-01-01,1969-12-31", "dob BETWEEN DATE '1960-01-01' AND DATE '1969-12-31'"),
        ("Customer.store_id", "between", [5, 9], "store_id BETWEEN 5 AND 9"),
        ("Customer.firstname", "between", "First2, First4", "firstname BETWEEN 'First2' AND 'First4'"),
        ("Order.average_order_value", "between", "200000,300000", "average_order_value BETWEEN 200000 AND 300000"),
    ],
    # customer attributes
    "cust_email": [
        ("Customer.email", "==", "customer.000000008@furniture.example", "email = 'customer.000000008@furniture.example'"),
        ("Customer.email", "!=", "customer.000000008@furniture.example", "email <> 'customer.000000008@furniture.example'"),
        ("Customer.email", "$=", "@building.example", "suffix(email, '@building.example')"),
    ],
    "cust_firstname": [
        ("Customer.firstname", "==", "First7", "firstname = 'First7'"),
        ("Customer.firstname", "!{}", "4", "NOT contains(firstname, '4')"),
    ],
    "cust_lastname": [
        ("Customer.lastname", "{}", "#00000001", "contains(lastname, '#00000001')"),
        ("Customer.lastname", "^=", "customer#0000000", "starts_with(lastname, 'Customer#0000000')"),
    ],
    "cust_dob": [
        ("Customer.dob", "<", "1970-01-01", "dob < DATE '1970-01-01'"),
        ("Customer.dob", "!=", "1950-02-07 10:00:00", "dob <> DATE '1950-02-07'"),
    ],
    "cust_gender": [
        ("Customer.gender", "==", "2", "gender = 2"),
        ("Customer.gender", "()", "1,3", "gender IN (1, 3)"),
    ],
    "cust_taxvat": [
        ("Customer.taxvat", "!=", "VAT1", "taxvat <> 'VAT1'"),
        ("Customer.taxvat", "==", "VAT1", "taxvat = 'VAT1'"),
    ],
    "cust_website": [("Customer.website_id", "==", 2, "website_id = 2"), ("Customer.website_id", "!()", "2,3", "website_id NOT IN (2, 3)")],
    "cust_store": [("Customer.store_id", "()", "1,2,25", "store_id IN (1, 2, 25)")],
    "cust_group": [("Customer.group_id", "==", "1", "group_id = 1"), ("Customer.group_id", "!=", "1", "group_id <> 1")],
    "cust_created_at": [
        ("Customer.created_at", "==", "1995-02-01 17:30:00", "created_at = TIMESTAMP '1995-02-01'"),
        ("Customer.created_at", ">=", "1998-01-01", "created_at >= TIMESTAMP '1998-01-01'"),
        (
            "Customer.created_at",
            "between",
            "1996-01-01,1996-12-31",
            "created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'",
        ),
    ],
    # order history
    "ord_total_orders": [
        ("Order.total_orders", ">=", "10", "total_orders >= 10"),
        ("Order.total_orders", "==", "0", "total_orders = 0"),
        ("Order.total_orders", "<", "5", "total_orders < 5"),
        ("Order.total_orders", "between", "3,5", "total_orders BETWEEN 3 AND 5"),
    ],
    "ord_total_revenue": [
        ("Order.total_revenue", ">=", "2000000", "total_revenue >= 2000000"),
        ("Order.total_revenue", "<", "500000", "total_revenue < 500000"),
    ],
    "ord_avg_value": [
        ("Order.average_order_value", "between", "200000,300000", "average_order_value BETWEEN 200000 AND 300000"),
        ("Order.average_order_value", ">", 300000, "average_order_value > 300000"),
    ],
    "ord_first_date": [
        ("Order.first_order_date", "<", "1995-06-01", "first_order_date < TIMESTAMP '1995-06-01'"),
        ("Order.first_order_date", "!=", "1995-01-05 09:00:00", "CAST(first_order_date AS DATE) <> DATE '1995-01-05'"),
        (
            "Order.first_order_date",
            "between",
            ["1996-01-01", "1996-06-30 12:00:00"],
            "first_order_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30 12:00:00'",
        ),
    ],
    "ord_last_date": [
        ("Order.last_order_date", ">", "2001-01-01", "last_order_date > TIMESTAMP '2001-01-01'"),
        ("Order.last_order_date", "==", "2001-05-05", "CAST(last_order_date AS DATE) = DATE '2001-05-05'"),
        ("Order.last_order_date", "<=", "2000-01-01", "last_order_date <= TIMESTAMP '2000-01-01'"),
    ],
    "ord_total_items": [
        ("Order.total_items", ">", "1000", "total_items > 1000"),
        ("Order.total_items", "<=", "200", "total_items <= 200"),
    ],
    "ord_used_coupon": [
        ("Order.used_coupon", "==", "SAVE1", _some_order("coupon_code = 'SAVE1'")),
        ("Order.used_coupon", "!=", "SAVE1", _some_order("coupon_code <> 'SAVE1'")),
        ("Order.used_coupon", "!{}", "save2", _some_order("NOT contains(lower(coupon_code), 'save2')")),
    ],
    "ord_payment_method": [
        ("Order.payment_method", "()", "card,paypal", _some_order("payment_method IN ('card', 'paypal')")),
        ("Order.payment_method", "!()", "card,paypal,bank,cod", _some_order("payment_method = 'gift'")),
    ],
    "ord_shipping_method": [
        ("Order.shipping_method", "==", "flatrate", _some_order("shipping_method = 'flatrate'")),
        ("Order.shipping_method", "{}", "Rate", _some_order("contains(shipping_method, 'rate')")),
    ],
    "ord_shipping_country": [
        ("Order.shipping_country", "==", "NATION_3", _some_order("shipping_country_id = 'NATION_3'")),
        ("Order.shipping_country", "()", ["NATION_1", "NATION_2"], _some_order("shipping_country_id IN ('NATION_1', 'NATION_2')")),
    ],
    "ord_status": [
        ("Order.order_status", "==", "holded", _some_order("status = 'holded'")),
        ("Order.order_status", "!=", "complete", _some_order("status <> 'complete'")),
    ],
    # cart
    "cart_subtotal": [
        ("Cart.cart_subtotal", "<", "50", "cart_subtotal < 50"),
        ("Cart.cart_subtotal", ">=", 20, "cart_subtotal >= 20"),
        ("Cart.cart_subtotal", "==", "0", "cart_subtotal = 0"),
    ],
    "cart_items_count": [
        ("Cart.cart_items_count", ">", "3", "cart_items_count > 3"),
        ("Cart.cart_items_count", "==", "0", "cart_items_count = 0"),
    ],
    "cart_products": [
        ("Cart.cart_products", "{}", " brand#1 ", _some_cart_sku("contains(lower(sku), 'brand#1')")),
        ("Cart.cart_products", "!=", "BRAND#17-1", _some_cart_sku("lower(sku) <> 'brand#17-1'")),
        ("Cart.cart_products", "!{}", "brand#1", _some_cart_sku("NOT contains(lower(sku), 'brand#1')")),
        ("Cart.cart_products", "==", "brand#17-1", _some_cart_sku("lower(sku) = 'brand#17-1'")),
    ],
    "cart_has_active": [
        ("Cart.has_active_cart", "==", "1", "has_active_cart"),
        ("Cart.has_active_cart", "!=", True, "has_active_cart"),
        ("Cart.has_active_cart", "==", "0", "NOT has_active_cart"),
    ],
    "cart_last_activity": [
        ("Cart.cart_last_activity", "<", "3", "cart_last_activity < 3"),
        ("Cart.cart_last_activity", ">=", "1", "cart_last_activity >= 1"),
        ("Cart.cart_last_activity", "!=", "0", "cart_last_activity <> 0"),
    ],
    # product interactions
    "prod_purchased_sku": [
        ("Product.purchased_products", "{}", "Brand#12-", _some_item("contains(lower(sku), 'brand#12-')")),
        ("Product.purchased_products", "==", "Brand#17-1, Brand#4-2", _some_item("sku IN ('Brand#17-1', 'Brand#4-2')")),
        ("Product.purchased_products", "!=", "Brand#17-1", _some_item("sku NOT IN ('Brand#17-1')")),
        (
            "Product.purchased_products",
            "!{}",
            "brand#1,brand#2",
            _some_item("NOT contains(lower(sku), 'brand#1') AND NOT contains(lower(sku), 'brand#2')"),
        ),
    ],
    "prod_purchased_category": [
        ("Product.purchased_categories", "==", "10,20", _some_category("category_id IN (10, 20)")),
        ("Product.purchased_categories", "!=", "10,20", _some_category("category_id NOT IN (10, 20)")),
    ],
    "prod_wishlist_count": [
        ("Product.wishlist_items_count", ">=", "14", "wishlist_items_count >= 14"),
        ("Product.wishlist_items_count", "==", "0", "wishlist_items_count = 0"),
        ("Product.wishlist_items_count", "between", "1,10", "wishlist_items_count BETWEEN 1 AND 10"),
    ],
    "prod_viewed_category": [
        ("Product.viewed_categories", "==", "10,20", _some_view("category_id IN (10, 20)")),
        ("Product.viewed_categories", "!=", "10,20", _some_view("category_id NOT IN (10, 20)")),
    ],
}

# Rule trees: key -> [(rule document or raw text, SQL predicate over feat)]
RULES: dict[str, list[tuple[object, str]]] = {
    "rule_all": [
        (
            group("all", leaf("Customer.group_id", "==", "1"), leaf("Order.total_orders", ">=", "5")),
            "group_id = 1 AND total_orders >= 5",
        ),
        (
            group("all", leaf("Customer.taxvat", "!=", "VAT1"), leaf("Cart.cart_last_activity", ">", "0")),
            "coalesce(taxvat <> 'VAT1', false) AND coalesce(cart_last_activity > 0, false)",
        ),
    ],
    "rule_any": [
        (
            group("any", leaf("Order.total_revenue", ">=", "2000000"), leaf("Order.total_orders", ">=", "10")),
            "coalesce(total_revenue >= 2000000, false) OR total_orders >= 10",
        ),
        (
            group("any", leaf("Customer.taxvat", "==", "VAT1"), leaf("Product.wishlist_items_count", ">", "13")),
            "coalesce(taxvat = 'VAT1', false) OR wishlist_items_count > 13",
        ),
    ],
    "rule_nested": [
        (
            group(
                "all",
                leaf("Customer.group_id", "==", "1"),
                leaf("Order.total_orders", ">=", "3"),
                group("any", leaf("Cart.cart_subtotal", ">", "10"), leaf("Order.last_order_date", ">", "2001-01-01")),
            ),
            "group_id = 1 AND total_orders >= 3 AND "
            "(cart_subtotal > 10 OR coalesce(last_order_date > TIMESTAMP '2001-01-01', false))",
        ),
        (
            group(
                "any",
                group("all", leaf("Order.used_coupon", "==", "SAVE1"), group("any", leaf("Customer.gender", "==", "1"))),
                group("all", leaf("Cart.has_active_cart", "==", "1"), leaf("Customer.dob", "<", "1960-01-01")),
            ),
            f"({_some_order("coupon_code = 'SAVE1'")} AND gender = 1) OR "
            "(has_active_cart AND coalesce(dob < DATE '1960-01-01', false))",
        ),
    ],
    "rule_empty_group": [
        ({}, "true"),
        (group("all"), "true"),
        (group("all", leaf("Customer.gender", "==", "1"), group("any")), "gender = 1"),
    ],
    "rule_keyed": [
        (
            {
                "aggregator": "any",
                "conditions": {
                    "1": leaf("Customer.gender", "==", "1"),
                    "1--1": {"type": "Combine", "conditions": {"7": leaf("Customer.group_id", "==", "2"), "x": leaf("Customer.gender", "!=", "2")}},
                },
            },
            "gender = 1 OR (group_id = 2 AND gender <> 2)",
        ),
    ],
    "rule_missing": [(None, "false"), ("", "false"), ("{not json", "false"), ("[]", "true")],
}
