"""Many rules through the index give what a loop over customers and rules gives."""

from __future__ import annotations

import random

import pytest

from cohortry.operators.conditions import ConditionRegistry
from cohortry.plans import rule_index
from cohortry.plans.evaluate import RuleSet, matches
from cohortry.plans.rules import compile_tree, group, leaf

from .small_shop import NOW, Loops, random_shop

VALUED = [
    lambda r: leaf("Product.purchased_products", "==", ",".join(f"Sku-{r.randint(1, 12)}" for _ in range(r.randint(1, 2)))),
    lambda r: leaf("Product.purchased_categories", "==", f"{r.randint(1, 7)}"),
    lambda r: leaf("Product.viewed_categories", "==", f"{r.randint(1, 7)},{r.randint(1, 7)}"),
    lambda r: leaf("Order.payment_method", "()", r.choice(["card", "paypal,bank", "cash"])),
    lambda r: leaf("Order.used_coupon", "==", r.choice(["SAVE1", "SAVE2", "SAVE9"])),
    lambda r: leaf("Cart.cart_products", "==", f"Sku-{r.randint(1, 12)}"),
]
OTHER = [
    lambda r: leaf("Customer.gender", "==", str(r.randint(1, 3))),
    lambda r: leaf("Order.total_orders", ">=", str(r.randint(0, 4))),
    lambda r: leaf("Product.purchased_products", "{}", f"sku-{r.randint(1, 12)}"),
    lambda r: leaf("Cart.cart_last_activity", "<", str(r.randint(1, 300))),
]


def random_rule(r: random.Random) -> dict:
    """A clause of values, and what else may be there."""
    key = group("any", *[r.choice(VALUED)(r) for _ in range(r.randint(1, 3))])
    rest = [group(r.choice(["any", "all"]), *[r.choice(VALUED + OTHER)(r) for _ in range(r.randint(1, 3))]) for _ in range(r.randint(0, 2))]
    return group("all", key, *rest)


@pytest.mark.parametrize("spreading", [False, True])
def test_equal_to_loops(spark, setting, request, spreading):
    if spreading:
        request.getfixturevalue("spread")
    setting(spark__cohortry__segmentsPerPass=6)
    rnd, small, registry = random.Random(71), random_shop(71), ConditionRegistry()
    trees = {n: random_rule(rnd) for n in range(1, 41)}
    trees |= {50: group("all", leaf("Customer.gender", "==", "1")), 51: group("all"), 52: group("any", VALUED[0](rnd), OTHER[0](rnd))}
    rules = RuleSet({n: compile_tree(tree, registry) for n, tree in trees.items()})
    indexed = {n for n, rule in rules.rules.items() if rule_index.indexable(rule)}
    assert indexed >= set(range(1, 41)) and not indexed & {50, 51, 52}
    loops = Loops(small)
    expected = sorted((n, c) for n, tree in trees.items() for c in loops.members(tree))
    assert sorted(tuple(r) for r in matches(small.shop(spark), rules, NOW, registry).collect()) == expected


def test_the_rarest_clause_leads_to_a_rule(spark, monkeypatch):
    """A common value in thousands of rules must not make candidates of everybody."""
    small, registry = random_shop(72), ConditionRegistry()
    rules = {
        n: compile_tree(group("all", leaf("Order.payment_method", "()", "card,paypal,bank"), leaf("Product.purchased_products", "==", f"Sku-{n}")), registry)
        for n in range(2, 60)
    }
    loops = Loops(small)
    lists = []
    real = rule_index.small_table
    monkeypatch.setattr(rule_index, "small_table", lambda spark, rows, schema: lists.append(list(rows)) or real(spark, lists[-1], schema))
    found = rule_index.indexed_matches(small.shop(spark), rules, NOW, registry)
    assert sorted(tuple(r) for r in found.collect()) == sorted(
        (n, c) for n in rules for c in loops.members(group("all", leaf("Order.payment_method", "()", "card,paypal,bank"), leaf("Product.purchased_products", "==", f"Sku-{n}")))
    )
    # the payment methods lead to the rules whose product nobody bought at most
    assert all(len(entries) == 1 for _, entries in lists[-1])


def test_clauses_say_what_the_tree_says(spark):
    registry = ConditionRegistry()
    a, b, c = (leaf("Customer.gender", "==", str(n)) for n in (1, 2, 3))
    parts = lambda tree: [sorted(x.predicate[-4] for x in clause) for clause in compile_tree(tree, registry).clauses]
    one = compile_tree(group("all", a), registry).clauses[0]
    assert compile_tree(group("all", a, group("any", b, c), a), registry).clauses[0] == one
    assert len(parts(group("any", group("all", a, b), c))) == 2
    assert compile_tree(group("all"), registry).clauses == ()
    assert compile_tree(group("any", a, group("all")), registry).clauses == ()
    wide = group("any", *[group("all", a, b, leaf("Order.total_orders", ">", str(n))) for n in range(8)])
    assert compile_tree(wide, registry).clauses is None
