"""Own conditions over any number of facts a customer."""

from __future__ import annotations

import random

from cohortry.functions.compare import compare_number
from cohortry.operators.conditions import ConditionRegistry
from cohortry.plans.evaluate import RuleSet, matches
from cohortry.plans.rules import compile_tree, group, leaf
from cohortry.session import small_table

from .small_shop import NOW, random_shop
from .test_layout import plan


def test_equal_to_a_loop_with_one_customer_that_has_a_third(spark, spread):
    rnd, small, registry = random.Random(81), random_shop(81), ConditionRegistry()
    visits = [(None if rnd.random() < 0.05 else 1 if rnd.random() < 0.33 else rnd.randint(0, 45), rnd.choice([None, *range(50)])) for _ in range(140)]
    table = small_table(spark, visits, "customer_id bigint, minutes int").repartition(5)
    registry.register_rows("Visit", "count", table, {"visits": "count(*)"}, lambda op, value: compare_number("visits", op, value), {"visits": "0"})
    registry.register_rows("Visit", "longest", table, {"longest": "max(minutes)"}, lambda op, value: compare_number("longest", op, value))
    rules = {
        1: group("all", leaf("Visit.count", ">=", "5")),
        2: group("all", leaf("Visit.count", "==", "0")),
        3: group("any", leaf("Visit.longest", "<", "40"), group("all", leaf("Visit.longest", ">=", "49"), leaf("Customer.gender", "==", "1"))),
    }
    compiled = RuleSet({n: compile_tree(rule, registry) for n, rule in rules.items()})
    found = matches(small.shop(spark), compiled, NOW, registry)
    expected = []
    for c in small.records("customer"):
        i = c["customer_id"]
        own = [m for who, m in visits if who == i]
        known = [m for m in own if m is not None]
        tests = {1: len(own) >= 5, 2: not own, 3: bool(known) and (max(known) < 40 or max(known) >= 49 and c["gender"] == 1)}
        expected += [(n, i) for n, holds in tests.items() if holds and i > 0]
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected) and len({n for n, _ in expected}) == 3
    # visits are combined before the shuffle, and nothing runs in Python
    assert "partial_count" in plan(found) and "Python" not in plan(found)
