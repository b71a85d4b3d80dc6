"""Random rules on random shops agree with plain loops, on both join ways."""

from __future__ import annotations

import random

import pytest

from cohortry.operators import flags
from cohortry.operators.conditions import ConditionRegistry
from cohortry.plans.evaluate import RuleSet, matches
from cohortry.plans.rules import compile_tree, group, leaf
from cohortry.session import small_table

from .small_shop import NOW, Loops, random_shop

LEAVES = [
    ("Customer.email", ["==", "!=", "{}", "!{}", "^=", "$="], ["@HOME", "user1", "user3@acme.example", ".example"]),
    ("Customer.firstname", ["==", "()", "!()", "between", ">"], ["First1,First2"]),
    ("Customer.lastname", ["==", "!=", "{}", "()"], ["O'Neil", "Back\\slash", '"', "$Dollar", "${user}"]),
    ("Customer.dob", ["==", "!=", ">", "<", ">=", "<="], ["1985-04-23", "1983-03-01 10:00:00"]),
    ("Customer.dob", ["between", "()", "!()"], ["1981-01-01,1986-06-06"]),
    ("Customer.gender", ["==", "!=", "()", "!()"], ["2"]),
    ("Customer.taxvat", ["==", "!=", "{}", "!{}", "!()"], ["VAT3", "1"]),
    ("Customer.store_id", ["between", "()", "!()"], ["2,3"]),
    ("Customer.created_at", ["==", ">", "<=", "!="], ["2022-01-20 08:00:00"]),
    ("Order.total_orders", ["==", "!=", ">", "<", ">=", "<="], ["0", "2", "5"]),
    ("Order.total_orders", ["between"], ["1,3"]),
    ("Order.total_revenue", [">", "<=", "!="], ["200", "500.5"]),
    ("Order.average_order_value", [">=", "<"], ["150"]),
    ("Order.total_items", [">", "<"], ["300"]),
    ("Order.first_order_date", ["==", "!=", "<", ">="], ["2023-03-01"]),
    ("Order.last_order_date", [">", "<=", "!="], ["2023-12-01 15:00:00"]),
    ("Order.used_coupon", ["==", "!=", "()", "!()", "{}", "!{}"], ["SAVE1", "save"]),
    ("Order.payment_method", ["()", "!()"], ["card, bank"]),
    ("Order.shipping_method", ["==", "{}"], ["flatrate", "SHIP"]),
    ("Order.shipping_country", ["==", "!="], ["DE"]),
    ("Order.order_status", ["==", "!="], ["holded"]),
    ("Cart.cart_subtotal", ["<", ">=", "=="], ["0", "120"]),
    ("Cart.cart_items_count", [">", "==", "<="], ["0", "4"]),
    ("Cart.cart_products", ["==", "!=", "{}", "!{}"], [" SKU-1 ", "sku-1", "2"]),
    ("Cart.has_active_cart", ["==", "!="], ["1", "0"]),
    ("Cart.cart_last_activity", ["<", ">=", "!="], ["60", "200"]),
    ("Product.purchased_products", ["==", "!=", "{}", "!{}"], ["Sku-1", "Sku-2, Sku-3", "sku-1"]),
    ("Product.purchased_categories", ["==", "!="], ["1", "2,3"]),
    ("Product.viewed_categories", ["==", "!="], ["1", "4, 5"]),
    ("Product.wishlist_items_count", ["==", ">", "<=", "!="], ["0", "2"]),
    ("Product.wishlist_items_count", ["between"], ["1,2"]),
]


def random_leaf(rnd: random.Random) -> dict:
    path, operators, values = rnd.choice(LEAVES)
    return leaf(path, rnd.choice(operators), rnd.choice(values))


def random_group(rnd: random.Random, depth: int = 0) -> dict:
    children = [
        random_group(rnd, depth + 1) if depth < 2 and rnd.random() < 0.3 else random_leaf(rnd)
        for _ in range(rnd.randint(0 if depth else 1, 3))
    ]
    return group(rnd.choice(["all", "any"]), *children)


def check(spark, small, rules: dict[int, dict]) -> None:
    registry, loops = ConditionRegistry(), Loops(small)
    compiled = RuleSet({n: compile_tree(rule, registry) for n, rule in rules.items()})
    found: dict[int, list[int]] = {n: [] for n in rules}
    for row in matches(small.shop(spark), compiled, NOW, registry).collect():
        found[row.segment_id].append(row.customer_id)
    for n, rule in rules.items():
        assert len(found[n]) == len(set(found[n]))
        assert set(found[n]) == loops.members(rule), rule


def every_leaf() -> dict[int, dict]:
    cases = [leaf(path, op, value) for path, operators, values in LEAVES for op in operators for value in values]
    return {n: group("all", case) for n, case in enumerate(cases, 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_every_leaf(spark, seed):
    check(spark, random_shop(seed), every_leaf())


def test_every_leaf_without_broadcast(spark, spread):
    check(spark, random_shop(3), every_leaf())


@pytest.fixture
def small_words(monkeypatch):
    """Equality leaves always go through the look-up table, three to a word."""
    monkeypatch.setattr(flags, "LOOKUP_FROM", 1)
    monkeypatch.setattr(flags, "WORD_BITS", 3)
    monkeypatch.setattr(flags, "FILTER_UP_TO", 2)


def many_values() -> dict[int, dict]:
    """Leaves that differ only in their values, several of them sharing values."""
    skus = [f"Sku-{i}" for i in range(14)] + ["Sku-1, Sku-2", "Sku-2,Sku-3,nothing", "sku-1"]
    cases = [leaf("Product.purchased_products", "==", sku) for sku in skus]
    cases += [leaf("Cart.cart_products", "==", sku) for sku in skus]
    for path in ("Product.purchased_categories", "Product.viewed_categories"):
        cases += [leaf(path, "==", str(i)) for i in range(8)] + [leaf(path, "==", "1,2"), leaf(path, "!=", "3")]
    for path, values in {
        "Order.used_coupon": ["SAVE1", "SAVE2", "SAVE3"],
        "Order.payment_method": ["card", "paypal", "bank"],
        "Order.shipping_country": ["DE", "FR", "IT"],
    }.items():
        cases += [leaf(path, op, value) for value in values for op in ("==", "()", "!=")]
        cases.append(leaf(path, "()", values))
    return {n: group("all", case) for n, case in enumerate(cases, 1)}


def test_looked_up_values(spark, small_words):
    check(spark, random_shop(7), many_values())
    check(spark, random_shop(8), every_leaf())


def test_looked_up_values_without_broadcast(spark, small_words, spread):
    check(spark, random_shop(9), many_values())


def test_many_leaves_on_one_column(spark):
    rules = {i: group("all", leaf("Product.purchased_products", "==", f"Sku-{i % 14}")) for i in range(1, 150)}
    rules |= {200 + i: group("all", leaf("Product.purchased_products", "==", f"Sku-{i % 12},other{i}")) for i in range(140)}
    check(spark, random_shop(10), rules)


@pytest.mark.parametrize("seed", [4, 5])
def test_random_trees(spark, seed):
    rnd = random.Random(seed)
    check(spark, random_shop(seed), {n: random_group(rnd) for n in range(1, 41)})


def test_only_some_customers(spark, spread):
    """Evaluating some customers gives their part of the full result."""
    small, registry, rnd = random_shop(6), ConditionRegistry(), random.Random(6)
    rules = RuleSet({n: compile_tree(random_group(rnd), registry) for n in range(1, 21)})
    touched = small_table(spark, [(1,), (2,), (7,), (999,)], "customer_id bigint")
    everyone = {tuple(r) for r in matches(small.shop(spark), rules, NOW, registry).collect()}
    some = matches(small.shop(spark).for_customers(touched, 4), rules, NOW, registry)
    assert {tuple(r) for r in some.collect()} == {(s, c) for s, c in everyone if c in (1, 2, 7)}
